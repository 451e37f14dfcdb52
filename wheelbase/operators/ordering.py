"""Ordered computations (ranks, running sums, running minima, row numbers) as a prefix scan over range partitions.

A window over a whole group sorts the group in one task.  Here the rows are dealt over ranges of
(group, order) and stored once, windows run inside a range, and one total per (range, group) is carried
over.  A group of any size is spread over as many ranges as its share of the rows; what is carried over
has one row per range and group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wheelbase.staging import checkpointed

_BEFORE = (Window.unboundedPreceding, -1)


def in_ranges(df: DataFrame, order: Sequence[Column | str], ranges: int | None = None, stage=checkpointed) -> DataFrame:
    """The rows with ``_part``, the number of their range: all rows of a range sort before those of the next.

    There are as many ranges as the session has shuffle partitions. Rows equal in ``order`` share a range.
    The frame is stored, as a range number must not change when a lost task is run again.
    """
    ranges = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stage(df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL equal to NULL; the keys of the left side stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def with_sums_before(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], amounts: Mapping[str, Column], ranges: int | None = None,
    stage=checkpointed,
) -> DataFrame:
    """Add, for every name in ``amounts``, the sum of that amount over all earlier rows of the group.

    ``order`` should be total inside a group; among equal rows the sums follow some order.
    """
    ranged = in_ranges(df.withColumns({f"_a_{n}": a for n, a in amounts.items()}), [*group, *order], ranges, stage)
    keys = ["_part", *group]
    totals = ranged.groupBy(*keys).agg(*[F.sum(f"_a_{n}").alias(f"_t_{n}") for n in amounts])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(*_BEFORE)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in amounts])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_BEFORE)
    local = ranged.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_a_{n}").over(inside), F.lit(0)) for n in amounts})
    found = _same(local, offsets, keys).withColumns({n: F.col(f"_o_{n}") + F.col(f"_l_{n}") for n in amounts})
    return found.drop("_part", *[f"{p}{n}" for n in amounts for p in ("_a_", "_t_", "_o_", "_l_")])


def with_minimum_from(
    df: DataFrame, group: Sequence[str], value: str, measure: Column, name: str, ranges: int | None = None, stage=checkpointed
) -> DataFrame:
    """Add ``name``: the smallest ``measure`` among this value and all larger ones in the group.

    The windows run from the largest value down: a frame that grows keeps one running minimum, one that shrinks is read again for every row.
    """
    ranged = in_ranges(df.withColumn("_measure", measure), [*group, value], ranges, stage)
    keys = ["_part", *group]
    lows = ranged.groupBy(*keys).agg(F.min("_measure").alias("_low"))
    later = Window.partitionBy(*group).orderBy(F.desc("_part")).rowsBetween(*_BEFORE)
    suffix = lows.select(*keys, F.min("_low").over(later).alias("_later"))
    inside = Window.partitionBy(*keys).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_here", F.min("_measure").over(inside))
    # least() skips NULL, so the last range, which has nothing after it, keeps its own minimum.
    return _same(local, suffix, keys).withColumn(name, F.least("_here", "_later")).drop("_part", "_measure", "_here", "_later")


def numbered(
    df: DataFrame, order: Sequence[Column | str], name: str, ranges: int | None = None, stage=checkpointed
) -> DataFrame:
    """Add ``name``: the number (from 0) of the row in the whole frame's order, which should be total."""
    return with_sums_before(df, [], order, {name: F.lit(1).cast("long")}, ranges, stage)


def average_ranks(
    df: DataFrame, group: Sequence[str], value: str, name: str = "rank", ranges: int | None = None, stage=checkpointed, weight: str | None = None
) -> DataFrame:
    """Rank of each distinct value in its group, ties averaged: one row per (group, value).

    Repeated values are counted on the map side, so a frequent value is one row before it is shuffled. With
    ``weight``, each row stands for that many equal rows.
    """
    rows = F.count("*") if weight is None else F.sum(weight)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(rows.alias("n_ties"))
    placed = with_sums_before(counted, group, [value], {"before": F.col("n_ties")}, ranges, stage)
    return placed.select(
        *group, value, (F.col("before") + (F.col("n_ties") + 1) / 2).alias(name), F.col("n_ties")
    )
