"""Elastic Net for all folds and models from one pass of sums.

Categories are encoded by a table of their levels, numbered by frequency and joined. One pass adds up the products of all columns per
fold; the training sums of a fold are the totals less its own, and a model on fewer columns uses a part of the same sums. The
small penalised problems are solved by coordinate descent. One more pass applies all fitted models to every row and adds up
their errors. Work on the rows is two passes, however many folds and models there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelbase.operators.ordering import numbered

# Widest matrix of products that a task holds: 128 MB for each fold in its rows. Wider designs need an iterative fit on the rows.
MAX_COLUMNS = 4_000
PRECISION, SWEEPS = 1e-12, 100_000


def category_levels(data: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(category, value, position): every level of every category, by category, then most frequent first, then by value."""
    cells = F.array(*[F.struct(F.lit(i).alias("number"), F.lit(c).alias("category"), F.col(c).alias("value")) for i, c in enumerate(categories)])
    counted = data.select(F.inline(cells)).filter("value is not null").groupBy("number", "category", "value").agg((-F.count("*")).alias("rare"))
    return numbered(counted, ["number", "rare", "value"], "position").select("category", "value", F.col("position").cast("int").alias("position"))


@dataclass(frozen=True)
class Design:
    """Rows of (fold, label, positions of the levels, numbers), the number of levels, and means that the sums are taken around."""

    rows: DataFrame
    levels: int
    numbers: int
    means: tuple[float, ...]

    @property
    def columns(self) -> int:
        return self.levels + self.numbers


def design(data: DataFrame, categories: Sequence[str], numbers: Sequence[str], label: str, levels: DataFrame | None = None) -> Design | None:
    """The encoded rows, or None if there are more than MAX_COLUMNS columns. A value without a level has no column and adds nothing."""
    levels = category_levels(data, categories) if levels is None else levels
    n_levels = levels.count()
    if n_levels + len(numbers) > MAX_COLUMNS:
        return None
    encoded = data
    for i, category in enumerate(categories):
        # At most MAX_COLUMNS rows, as counted.
        own = levels.filter(F.col("category") == category).select(F.col("value").alias(f"_v{i}"), F.col("position").alias(f"_p{i}"))
        encoded = encoded.join(F.broadcast(own), F.col(category) == F.col(f"_v{i}"), "left")
    rows = encoded.select(
        F.col("fold").cast("int").alias("fold"), F.col(label).cast("double").alias("label"),
        F.array_compact(F.array(*[F.col(f"_p{i}") for i in range(len(categories))])).alias("positions"),
        F.array(*[F.col(c).cast("double") for c in numbers]).alias("numbers"),
    )
    means = data.agg(*[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate([*numbers, label])]).first()
    return Design(rows, n_levels, len(numbers), tuple(means))


def _matrix(batch: pa.RecordBatch, made: Design) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fold of each row, columns, label), numbers and label less their means."""
    n = batch.num_rows
    x = np.zeros((n, made.columns))
    positions = batch.column("positions")
    lengths = np.diff(positions.offsets.to_numpy())
    x[np.repeat(np.arange(n), lengths), positions.flatten().to_numpy()] = 1.0
    if made.numbers:
        x[:, made.levels:] = batch.column("numbers").flatten().to_numpy(zero_copy_only=False).reshape(n, made.numbers) - np.array(made.means[:-1])
    return batch.column("fold").to_numpy(), x, batch.column("label").to_numpy(zero_copy_only=False) - made.means[-1]


def fold_sums(made: Design) -> dict[int, np.ndarray]:
    """Per fold the products of (1, columns, label) with themselves: one small matrix a fold reaches the driver."""
    rows, bare = made.rows, Design(None, made.levels, made.numbers, made.means)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, x, y = _matrix(batch, bare)
            z = np.column_stack([np.ones(len(y)), x, y])
            for f in np.unique(fold):
                own = z[fold == f]
                sums[int(f)] = sums.get(int(f), 0.0) + own.T @ own
        for f, total in sums.items():
            yield pa.record_batch([pa.array([f] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(list(total))], names=["fold", "i", "row"])

    partial = rows.mapInArrow(add_up, "fold int, i int, row array<double>")
    totals = partial.select("fold", "i", F.posexplode("row").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    whole = totals.groupBy("fold", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row")).select("fold", "i", F.col("row.v").alias("row"))
    found: dict[int, np.ndarray] = {}
    for row in whole.collect():
        found.setdefault(row.fold, np.zeros((made.columns + 2, made.columns + 2)))[row.i] = row.row
    return found


def elastic_net(sums: np.ndarray, used: Sequence[int], penalty: float, mix: float) -> tuple[np.ndarray, float]:
    """(coefficients of all columns, intercept) of the Elastic Net on the ``used`` columns.

    Columns and label are scaled by their deviations, the penalty acts on the scaled problem, as in Spark ML; a constant column has coefficient 0.
    """
    n = sums[0, 0]
    if n <= 0:
        raise ValueError("a training set without rows: one fold holds them all")
    size = len(sums) - 2
    mean = sums[0, 1:] / n
    spread = sums[1:, 1:] / n - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(spread), 0.0))
    weights, label_deviation = np.zeros(size), deviation[-1]
    varied = [j for j in used if deviation[j] > 1e-9 * max(1.0, abs(mean[j]))]
    if varied and label_deviation > 0:
        scale = deviation[varied]
        r = spread[np.ix_(varied, varied)] / np.outer(scale, scale)
        c = spread[varied, -1] / scale
        flat, curve = penalty * mix, penalty * (1 - mix) / label_deviation
        v, rest = np.zeros(len(varied)), c.copy()
        for _ in range(SWEEPS):
            largest = 0.0
            for j in range(len(v)):
                toward = rest[j] + r[j, j] * v[j]
                value = np.sign(toward) * max(abs(toward) - flat, 0.0) / (r[j, j] + curve)
                if value != v[j]:
                    largest = max(largest, abs(value - v[j]))
                    rest -= r[j] * (value - v[j])
                    v[j] = value
            if largest < PRECISION * label_deviation:
                break
        weights[varied] = v / scale
    return weights, float(mean[-1] - weights @ mean[:-1])


ERRORS = ("n", "sse", "sae", "sy", "syy")


def error_sums(made: Design, fits: Sequence[tuple[str, int, np.ndarray, float]]) -> DataFrame:
    """(model, fold, part, n, sse, sae, sy, syy) of every fitted (model, left-out fold, coefficients, intercept) on its training and test rows."""
    rows, bare = made.rows, Design(None, made.levels, made.numbers, made.means)
    held_out = np.array([f for _, f, _, _ in fits])
    weights = np.array([w for _, _, w, _ in fits]).T
    intercepts = np.array([b for *_, b in fits])
    names = [(m, f) for m, f, _, _ in fits]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(names), len(ERRORS)))
        for batch in batches:
            fold, x, y = _matrix(batch, bare)
            error = y[:, None] - (x @ weights + intercepts)
            test = fold[:, None] == held_out[None, :]
            for part, inside in enumerate((~test, test)):
                for k, values in enumerate((np.ones_like(error), error**2, np.abs(error), np.broadcast_to(y[:, None], error.shape), np.broadcast_to(y[:, None] ** 2, error.shape))):
                    total[part, :, k] += np.where(inside, values, 0.0).sum(axis=0)
        out = [(m, f, label, *total[part, i]) for part, label in enumerate(("train", "test")) for i, (m, f) in enumerate(names)]
        yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["model", "fold", "part", *ERRORS])

    schema = "model string, fold long, part string, " + ", ".join(f"{e} double" for e in ERRORS)
    return rows.mapInArrow(add_up, schema).groupBy("model", "fold", "part").agg(*[F.sum(e).alias(e) for e in ERRORS])


def metrics_of(sums: DataFrame) -> DataFrame:
    """(model, fold, part, rmse, mae, r2) from summed errors; the label's sums are around a mean, so their difference is stable."""
    variance = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return sums.filter("n > 0").select(
        "model", "fold", "part", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (F.col("sae") / F.col("n")).alias("mae"), (1 - F.try_divide(F.col("sse"), variance)).alias("r2"))
