"""Batches of requests against the catalog: filter, relax, score, rank, explain.

Requests with the same normalized content are answered once; items that no request can tell apart are
kept as one group with its size and its best few members.  Both reductions are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wheelbase import vocab
from wheelbase.functions.rules import first_match
from wheelbase.operators.bands import band_join
from wheelbase.operators.contest import contenders
from wheelbase.operators.counting import count_in_bands
from wheelbase.operators.requests import SIGNATURE_FIELDS, signature
from wheelbase.operators.ordering import numbered
from wheelbase.staging import written

# What a request can see of an item; items equal in all of these score the same for everybody.
VISIBLE = (
    "price_min_wan", "price_max_wan", "price_mid_wan", "body_type", "energy_type", "brand", "seats", "sales",
    "normalized_heat", "scenario_tags",
)
BEST = vocab.LIMIT_MAX
# What the hard conditions read of a request.
CORE_FIELDS = ("budget_min_wan", "budget_max_wan", "body_type", "energy_type", "min_seats", "min_sales")
# Up to this many distinct requests are shipped to all tasks and tried on every item in one scan, without a shuffle of the catalog.
FEW = 64


def priced(items: DataFrame) -> DataFrame:
    """Items whose missing or zero upper price is the lower one."""
    return items.withColumn("price_max_wan", F.coalesce(F.nullif("price_max_wan", F.lit(0.0)), F.col("price_min_wan")))


def item_groups(items: DataFrame, best: int = BEST) -> DataFrame:
    """The ``best`` leading members of every group of indistinguishable items.

    ``weight`` is the group's size on its first member and 0 on the others, so that summed weights
    count all items.  The row-number filter is applied inside the map tasks first.
    """
    keyed = priced(items).withColumn(
        "group_id", F.sha2(F.to_json(F.struct(*VISIBLE), {"ignoreNullFields": "false"}), 256)
    )
    order = Window.partitionBy("group_id").orderBy(
        F.coalesce("data_completeness", F.lit(0.0)).desc(), "model_name", "car_id"
    )
    sizes = keyed.groupBy("group_id").agg(F.count("*").alias("_size"))
    leading = keyed.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= best)
    return (
        leading.join(sizes, "group_id")
        .withColumn("weight", F.when(F.col("_place") == 1, F.col("_size")).otherwise(F.lit(0)))
        .drop("_place", "_size", "group_id")
    )


def distinct_requests(requests: DataFrame, fields: Sequence[str] = SIGNATURE_FIELDS) -> DataFrame:
    """One row per distinct normalized request, or per distinct ``fields`` of it."""
    return requests.withColumn("sig", signature(fields)).groupBy("sig").agg(*[F.first(c).alias(c) for c in fields])


def raised_ceiling(policy: vocab.RelaxPolicy = vocab.RelaxPolicy()) -> Column:
    return F.round(F.col("budget_max_wan") * policy.ceiling_factor, 2)


def _minimums() -> Column:
    """Requested minimums; an item without the value fails a requested minimum."""
    enough = lambda want, have: F.col(want).isNull() | F.coalesce(F.col(have) >= F.col(want), F.lit(False))
    return enough("min_seats", "seats") & enough("min_sales", "item_sales")


def _brand_hit() -> Column:
    return F.coalesce(F.array_contains("brands", F.col("brand")), F.lit(False))


def _scenario_hit() -> Column:
    return F.coalesce(F.array_contains("scenario_tags", F.col("scenario")), F.lit(False))


def _wanted(sigs: DataFrame, ceiling: Column) -> DataFrame:
    """Requests in the form of the pairing: their band, and the wished classes under names of their own."""
    return sigs.withColumns(
        {
            "band_low": F.col("budget_min_wan"),
            "band_high": ceiling,
            "want_body": F.col("body_type"),
            "want_energy": F.col("energy_type"),
        }
    ).drop("body_type", "energy_type")


def core_matches(items: DataFrame, sigs: DataFrame) -> DataFrame:
    """All (item, distinct request) pairs that satisfy the hard conditions under the plain ceiling."""
    sold = items.withColumnRenamed("sales", "item_sales")
    return band_join(sold, _wanted(sigs, F.col("budget_max_wan")), _minimums(), "car_id", "sig").select("sig", "car_id")


def count_matches(
    items: DataFrame, sigs: DataFrame, policy: vocab.RelaxPolicy = vocab.RelaxPolicy(), stage=written
) -> DataFrame:
    """Per distinct request: core matches, those that also fit brand and/or scenario, and matches under the raised ceiling."""
    return count_in_bands(items, sigs, raised_ceiling(policy), stage)


def _tried(items: DataFrame, wanted: DataFrame, condition: Column) -> DataFrame:
    """Items that fit requests of which there are at most FEW."""
    classes = ((F.col("want_body") == "") | (F.col("body_type") == F.col("want_body"))) & ((F.col("want_energy") == "") | (F.col("energy_type") == F.col("want_energy")))
    overlap = (F.col("price_min_wan") <= F.col("band_high")) & (F.col("price_max_wan") >= F.col("band_low"))
    return items.withColumnRenamed("sales", "item_sales").join(F.broadcast(wanted), overlap & classes & _minimums() & condition)


def count_for_few(items: DataFrame, sigs: DataFrame, policy: vocab.RelaxPolicy = vocab.RelaxPolicy()) -> DataFrame:
    """The counts of ``count_matches`` for at most FEW requests: one scan, summed up in the map tasks."""
    core = F.col("price_min_wan") <= F.col("budget_max_wan")
    total = lambda condition: F.sum(F.when(condition, F.col("weight")).otherwise(F.lit(0)))
    return _tried(items, _wanted(sigs, raised_ceiling(policy)), F.lit(True)).groupBy("sig").agg(
        total(core).alias("n_core"), total(core & _brand_hit()).alias("n_brand"), total(core & _scenario_hit()).alias("n_scenario"),
        total(core & _brand_hit() & _scenario_hit()).alias("n_both"), F.sum("weight").alias("n_raised"),
    )


def relax(sigs: DataFrame, counts: DataFrame, policy: vocab.RelaxPolicy = vocab.RelaxPolicy()) -> DataFrame:
    """Row-wise relaxation decisions from the counts: brand, then scenario, then the ceiling."""
    known = sigs.join(counts, "sig", "left").fillna(
        0, ["n_core", "n_brand", "n_scenario", "n_both", "n_raised"]
    )
    asks_brand, asks_scenario = F.size("brands") > 0, F.col("scenario") != ""
    keep_brand = asks_brand & (F.col("n_brand") >= policy.minimum)
    with_scenario = F.when(F.col("keep_brand"), F.col("n_both")).otherwise(F.col("n_scenario"))
    keep_scenario = asks_scenario & (with_scenario >= policy.minimum)
    fitting = F.when(F.col("keep_scenario"), with_scenario).otherwise(
        F.when(F.col("keep_brand"), F.col("n_brand")).otherwise(F.col("n_core"))
    )
    raised = (F.col("n_fitting") < policy.minimum) & (F.col("n_raised") > F.col("n_fitting"))
    decided = (
        known.withColumn("keep_brand", keep_brand)
        .withColumn("keep_scenario", keep_scenario)
        .withColumn("n_fitting", fitting)
        .withColumn("raised", raised)
    )
    notes = F.array_compact(
        F.array(
            F.when(asks_brand & ~F.col("keep_brand"), vocab.RELAXED_BRAND),
            F.when(asks_scenario & ~F.col("keep_scenario"), vocab.RELAXED_SCENARIO),
            F.when(F.col("raised"), F.format_string(vocab.RELAXED_BUDGET, raised_ceiling(policy))),
        )
    )
    return decided.withColumns(
        {
            "total_candidates": F.when(F.col("raised"), F.col("n_raised")).otherwise(F.col("n_fitting")),
            "relaxed_conditions": notes,
            "ceiling": F.when(F.col("raised"), raised_ceiling(policy)).otherwise(F.col("budget_max_wan")),
            # The raised candidate set drops brand and scenario again.
            "keep_brand": F.col("keep_brand") & ~F.col("raised"),
            "keep_scenario": F.col("keep_scenario") & ~F.col("raised"),
        }
    )


def price_basis() -> Column:
    return F.coalesce(F.nullif("price_mid_wan", F.lit(0.0)), F.col("price_min_wan"))


def price_score() -> Column:
    middle = (F.col("budget_min_wan") + F.col("budget_max_wan")) / 2
    span = F.greatest(F.col("budget_max_wan") - F.col("budget_min_wan"), F.lit(1.0))
    # An endless band has no middle; no price is near to it.
    return F.nanvl(F.greatest(F.lit(0.0), 1 - F.abs(price_basis() - middle) / span), F.lit(0.0))


def price_factor() -> Column:
    low, high, price = F.col("budget_min_wan"), F.col("budget_max_wan"), price_basis()
    third = F.greatest((high - low) / 3, F.lit(0.01))
    return first_match(
        [
            (price.between(low + third, high - third), vocab.LABEL_PRICE_MIDDLE),
            (price.between(low, high), vocab.LABEL_PRICE_INSIDE),
        ],
        F.lit(vocab.LABEL_PRICE_RELAXED),
    )


def factors() -> list[tuple[Column, Column, Column, float]]:
    """(present, label, value, weight) of every scoring factor."""
    w = vocab.WEIGHTS
    hit = lambda condition: F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))
    return [
        (F.lit(True), price_factor(), price_score(), w["price"]),
        (F.col("want_body") != "", F.concat(F.lit("符合"), "want_body", F.lit("车身偏好")), F.lit(1.0), w["body_type"]),
        (F.col("want_energy") != "", F.concat(F.lit("符合"), "want_energy", F.lit("能源偏好")), F.lit(1.0), w["energy_type"]),
        (
            (F.col("scenario") != "") & F.col("scenario_tags").isNotNull(),
            F.concat(F.lit("参数适合"), "scenario"), hit(_scenario_hit()), w["scenario"],
        ),
        (F.size("brands") > 0, F.lit(vocab.LABEL_BRAND), hit(_brand_hit()), w["brand"]),
        (F.col("normalized_heat").isNotNull(), F.lit(vocab.LABEL_HEAT), F.col("normalized_heat"), w["heat"]),
    ]


def weighted_score() -> Column:
    """100 · Σ value·weight / Σ weight over the factors that are present, 1 decimal."""
    parts = factors()
    gained = reduce(lambda a, b: a + b, [F.when(p, v * F.lit(w)).otherwise(F.lit(0.0)) for p, _, v, w in parts])
    possible = reduce(lambda a, b: a + b, [F.when(p, F.lit(w)).otherwise(F.lit(0.0)) for p, _, _, w in parts])
    return F.round(100 * gained / possible, 1)


def matched_factors(limit: int = 3) -> Column:
    """Labels of the contributing factors by contribution, then the known facts; the first ``limit``."""
    scored = F.array(
        *[
            F.when(p & (v > 0), F.struct((-(v * F.lit(w))).alias("order"), label.alias("label")))
            for p, label, v, w in factors()
        ]
    )
    ranked = F.transform(F.array_sort(F.array_compact(scored)), lambda f: f["label"])
    facts = F.array_compact(
        F.array(
            F.when(F.col("range_km").isNotNull(), F.format_string("标注续航 %.0f 公里", F.col("range_km"))),
            F.when(F.col("seats").isNotNull(), F.format_string("提供 %d 座布局", F.col("seats"))),
            F.when(F.col("horsepower").isNotNull(), F.format_string("标注功率 %d 马力", F.col("horsepower"))),
        )
    )
    return F.slice(F.array_distinct(F.concat(ranked, facts)), 1, limit)


def template_reason(name: Column | str, labels: Column) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.when(F.size(labels) == 0, F.concat(name, F.lit("满足当前核心筛选条件，可加入候选清单进一步比较。"))).otherwise(
        F.concat(F.lit("推荐 "), name, F.lit("，因为"), F.array_join(labels, "，并且"), F.lit("。"))
    )


def decisions(
    items: DataFrame, requests: DataFrame, policy: vocab.RelaxPolicy = vocab.RelaxPolicy(), stage=written
) -> tuple[DataFrame, DataFrame, bool]:
    """(items with their weights, relaxation decisions per distinct request ``sig``, whether the requests are few).

    The distinct requests are counted; few of them are tried on the items as they are, many on groups of equal items.
    """
    sigs = stage(distinct_requests(requests))
    few = sigs.count() <= FEW
    weighted = priced(items).withColumn("weight", F.lit(1).cast("long")) if few else stage(item_groups(items))
    counts = count_for_few(weighted, sigs, policy) if few else count_matches(weighted, sigs, policy, stage)
    return weighted, stage(relax(sigs, counts, policy)), few


def ranked_per_signature(weighted: DataFrame, decided: DataFrame, few: bool, stage=written) -> DataFrame:
    """The leading items of every distinct request.

    Filters are decided by now. Few requests meet every item. Many meet cells of items first and then only the items of cells that
    can reach the request's last place. Each task keeps only its own leading rows per request before the ranking shuffles.
    """
    wanted = _wanted(decided.select("sig", *SIGNATURE_FIELDS, "ceiling", "keep_brand", "keep_scenario"), F.col("ceiling"))
    leading = [F.coalesce("data_completeness", F.lit(0.0)).desc(), F.coalesce("normalized_heat", F.lit(0.0)).desc(), "model_name", "car_id"]
    top = lambda *order: F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("score"), *order))
    inside = lambda ranked: ranked.filter(F.col("rank") <= BEST).filter(F.col("rank") <= F.col("limit"))
    scenario = ~F.col("keep_scenario") | _scenario_hit()
    fits = _minimums() & (~F.col("keep_brand") | _brand_hit()) & scenario
    cell_fits = _minimums() & (~F.col("keep_brand") | F.arrays_overlap("brands", "cell_brands")) & scenario
    if few:
        kept = inside(_tried(weighted, wanted, fits).withColumn("score", weighted_score()).withColumn("rank", top(*leading)))
    else:
        # Among equal scores the order is one of the items alone. Items are numbered in it and requests in any, so what is compared and
        # ranked are narrow rows of numbers; only the ranked ones get the items' other columns and the signature back.
        placed = stage(numbered(weighted, leading, "place", stage=stage))
        known = stage(wanted.withColumn("number", F.monotonically_increasing_id()))
        seen = placed.select(F.col("place").alias("car_id"), *VISIBLE, "data_completeness")
        asked = known.withColumn("sig", F.col("number")).drop("number")
        scored = contenders(seen, asked, price_basis(), weighted_score, fits, cell_fits, stage=stage)
        ranked = inside(scored.select("sig", "limit", "score", "car_id").withColumn("rank", top("car_id")))
        shown = ranked.select(F.col("sig").alias("number"), F.col("car_id").alias("place"), "score", "rank")
        kept = shown.join(known, "number").join(placed.withColumnRenamed("sales", "item_sales"), "place")
    explained = kept.withColumn("matched_factors", matched_factors())
    public = [c for c in vocab.PUBLIC_FIELDS if c != "sales"]
    return explained.select(
        "sig", "rank", *public, F.col("item_sales").alias("sales"), "score", "matched_factors",
        template_reason("model_name", F.col("matched_factors")).alias("reason"),
        F.lit("template").alias("reason_source"),
    )


def recommend(
    items: DataFrame,
    requests: DataFrame,
    policy: vocab.RelaxPolicy = vocab.RelaxPolicy(),
    key: str = "request_id",
    stage=written,
) -> tuple[DataFrame, DataFrame]:
    """(ranked rows, one envelope row per request).

    The grouped items, the distinct requests and their decisions are each read by several branches, so
    ``stage`` writes them once; all three are no larger than the catalog or the request table.
    """
    keyed = requests.withColumn("sig", signature())
    weighted, decided, few = decisions(items, requests, policy, stage)
    ranked = keyed.select(key, "sig").join(ranked_per_signature(weighted, decided, few, stage), "sig").drop("sig")
    verdict = decided.select("sig", "total_candidates", "relaxed_conditions")
    envelope = keyed.join(verdict, "sig").drop("sig")
    return ranked, envelope


def public_json(columns=vocab.PUBLIC_FIELDS) -> Column:
    """Public fields as JSON; NULL and blank members are left out."""
    members = [F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull() for c in columns]
    return F.to_json(F.struct(*[F.when(keep, F.col(c)).alias(c) for keep, c in zip(members, columns)]))
