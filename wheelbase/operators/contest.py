"""The best items of every request without scoring all items that fit it.

Items that agree in body, energy and tags and lie in one narrow price bucket form a cell, whose summary bounds what any of
its items can score: the price nearest to the wished one, a wished brand if the cell has one, the largest heat. A request is first paired
with cells only. The leaders of its most promising cells are scored; the last place among the best of them is a score that the
answer cannot fall below, so only cells whose bound reaches it hand over their items, and only items that reach it go on to be ranked. Bounds use the scoring expressions
themselves on the best item that the cell could hold, so they are exact upper bounds also after rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wheelbase.operators.bands import HIGHEST, LOWEST, SLICE_ROWS, band_join, sliced
from wheelbase.staging import written

CELL_RATIO = 1.05
# Cells of a request whose leaders are scored for the first threshold, and leaders of a cell.
FIRST_CELLS = 6
LEADERS = 5


def with_cells(items: DataFrame, price: Column) -> DataFrame:
    """Items with ``cell``, 128 bits of price bucket and classes."""
    inside = F.least(F.greatest(price, F.lit(LOWEST)), F.lit(HIGHEST))
    bucket = F.floor(F.log(inside) / F.lit(math.log(CELL_RATIO)))
    classes = [bucket, "body_type", "energy_type", F.to_json(F.array_sort("scenario_tags")), F.col("scenario_tags").isNull()]
    return items.withColumn("cell", F.struct(F.xxhash64(*classes).alias("a"), F.xxhash64(F.lit(1), *classes).alias("b")))


def summaries(items: DataFrame, price: Column) -> DataFrame:
    """One row per cell: its price band, the prices that count for scores, and the best values of its items."""
    return items.groupBy("cell").agg(
        F.min("price_min_wan").alias("price_min_wan"), F.max("price_max_wan").alias("price_max_wan"), F.min(price).alias("cheapest"), F.max(price).alias("dearest"),
        *[F.first(c).alias(c) for c in ("body_type", "energy_type", "scenario_tags")],
        F.collect_set("brand").alias("cell_brands"), F.max("normalized_heat").alias("hottest"), F.max(F.col("normalized_heat").isNull()).alias("some_without_heat"),
        F.max("seats").alias("seats"), F.max("sales").alias("item_sales"), F.max(F.coalesce("data_completeness", F.lit(0.0))).alias("fullest"), F.count("*").alias("n_items"),
    )


def bounded(pairs: DataFrame, score: Callable[[], Column]) -> DataFrame:
    """Pairs of requests and cells with ``bound``: the score of the best item that the cell could hold."""
    middle = (F.col("budget_min_wan") + F.col("budget_max_wan")) / 2
    nearest = F.greatest("cheapest", F.least("dearest", middle))
    wished = F.get(F.array_intersect("brands", "cell_brands"), F.lit(0))
    best = pairs.withColumns({"price_mid_wan": nearest, "brand": wished, "normalized_heat": F.col("hottest")}).withColumn("_hot", score())
    # Without heat the factor drops out of the weights, which may raise a score.
    cold = best.withColumn("normalized_heat", F.lit(None).cast("double")).withColumn("_cold", score())
    return cold.withColumn("bound", F.greatest("_hot", F.when(F.col("some_without_heat"), F.col("_cold")))).drop("_hot", "_cold")


def last_place(scored: DataFrame) -> DataFrame:
    """(sig, least_score, least_fullness): what the last of the wished number of items has, for requests with that many."""
    order = Window.partitionBy("sig").orderBy(F.desc("score"), F.coalesce("data_completeness", F.lit(0.0)).desc(), "car_id")
    ranked = scored.select("sig", "limit", "score", "data_completeness", "car_id").withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= LEADERS)
    return ranked.filter(F.col("_place") == F.col("limit")).select("sig", F.col("score").alias("least_score"), F.coalesce("data_completeness", F.lit(0.0)).alias("least_fullness"))


def contenders(
    items: DataFrame, requests: DataFrame, price: Column, score: Callable[[], Column], fits: Column, cell_fits: Column,
    slice_rows: int = SLICE_ROWS, stage=written,
) -> DataFrame:
    """Pairs of items and requests that fit, among them the best ``limit`` (at most LEADERS) of every request, with ``score``.

    ``requests`` hold sig, band_low, band_high, want_body, want_energy and what ``fits`` and ``score`` read; ``cell_fits`` must hold for a cell if
    ``fits`` holds for one of its items.
    """
    keyed = stage(with_cells(items, price))
    # From here on a cell is a number, as tables of pairs hold it once a row.
    cells = stage(summaries(keyed, price).withColumn("number", F.monotonically_increasing_id()))
    keyed = keyed.join(cells.select("cell", "number"), "cell").withColumn("cell", F.col("number")).drop("number")
    cells = cells.withColumn("cell", F.col("number")).drop("number")
    paired = stage(bounded(band_join(cells, requests, cell_fits, "cell", "sig"), score).select("sig", "cell", "bound", "fullest", "n_items"))
    overlap = (F.col("price_min_wan") <= F.col("band_high")) & (F.col("price_max_wan") >= F.col("band_low"))
    classes = ((F.col("want_body") == "") | (F.col("body_type") == F.col("want_body"))) & ((F.col("want_energy") == "") | (F.col("energy_type") == F.col("want_energy")))
    sold = keyed.withColumnRenamed("sales", "item_sales")

    # A cell that many requests chose is cut into a grid of slices, by the most requests that it can meet.
    sizes = stage(paired.groupBy("cell").agg(
        F.ceil(F.count("*") / F.lit(slice_rows)).cast("int").alias("n_r"), F.ceil(F.first("n_items") / F.lit(slice_rows)).cast("int").alias("n_i")))
    entrants = sliced(sold, sizes, ["cell"], "i", "r", "car_id")

    def met(chosen: DataFrame, some: DataFrame) -> DataFrame:
        """The chosen (sig, cell) with those items of their cells that fit, scored.

        The requests join the chosen cells, so pairs with items are judged where they arise and never dealt out unjudged.
        """
        asked = sliced(chosen, sizes, ["cell"], "r", "i", "sig").join(requests, "sig")
        fitting = some.join(asked, ["cell", "i", "r"]).drop("i", "r", "cell").filter(overlap & classes & fits)
        # As a generated column the score is computed once a pair; conditions on a plain one would repeat it inside the join.
        return fitting.select("*", F.explode(F.array(score())).alias("score"))

    def reaches(value: Column, fullness: Column) -> Column:
        """Whether an item of this score and completeness can come in not after the last place."""
        least_score = F.col("least_score")
        return least_score.isNull() | (value > least_score) | ((value == least_score) & (fullness >= F.col("least_fullness")))

    promising = Window.partitionBy("sig").orderBy(F.desc("bound"), F.desc("n_items"), "cell")
    first = paired.withColumn("_place", F.row_number().over(promising)).filter(F.col("_place") <= FIRST_CELLS).select("sig", "cell")
    hottest = Window.partitionBy("cell", "i", "r").orderBy(F.desc_nulls_last("normalized_heat"), F.desc_nulls_last("data_completeness"), "car_id")
    leaders = entrants.withColumn("_place", F.row_number().over(hottest)).filter(F.col("_place") <= LEADERS).drop("_place")
    least = stage(last_place(met(first, leaders)))
    reaching = paired.join(least, "sig", "left").filter(reaches(F.col("bound"), F.col("fullest"))).select("sig", "cell", "least_score", "least_fullness")
    scored = met(reaching, entrants)
    return scored.filter(reaches(F.col("score"), F.coalesce("data_completeness", F.lit(0.0)))).drop("least_score", "least_fullness")
