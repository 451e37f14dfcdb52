"""Requests, recommendation and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from wheelbase import vocab
from wheelbase.functions import rules
from wheelbase.operators import compare, ordering, recommend, requests
from wheelbase.staging import written
from workload import views
from workload.ctes import with_ctes
from workload.registry import check


def valid_requests(spark, sf):
    return requests.validate_requests(views.raw_requests(spark, sf))[0]


def joined(column: str):
    return F.array_join(column, "|").alias(column)


def ranked(spark, sf):
    return recommend.recommend(views.items(spark, sf), valid_requests(spark, sf))[0]


@check("recommend_topk", with_ctes(("ranked",), """
SELECT request_id, rank::INT AS rank, car_id, model_name, score FROM ranked"""))
def recommend_topk(spark, sf):
    return ranked(spark, sf).select("request_id", "rank", "car_id", "model_name", "score")


@check("recommend_envelope", with_ctes(("relaxations",), """
SELECT request_id, total_candidates, array_to_string(relaxed_conditions, '|') AS relaxed_conditions, budget_min_wan, budget_max_wan,
  body_type, energy_type, array_to_string(brands, '|') AS brands, scenario, min_seats, min_sales, "limit" FROM relaxations"""))
def recommend_envelope(spark, sf):
    envelope = recommend.recommend(views.items(spark, sf), valid_requests(spark, sf))[1]
    return envelope.select(
        "request_id", "total_candidates", joined("relaxed_conditions"), "budget_min_wan", "budget_max_wan", "body_type",
        "energy_type", joined("brands"), "scenario", "min_seats", "min_sales", "limit",
    )


@check("relax_decisions", with_ctes(("decisions",), """
SELECT request_id, n_core, n_brand, n_scenario, n_both, n_raised, raised, ceiling, keep_brand AND NOT raised AS keep_brand,
  keep_scenario AND NOT raised AS keep_scenario FROM decisions"""))
def relax_decisions(spark, sf):
    valid = valid_requests(spark, sf)
    decided = recommend.decisions(views.items(spark, sf), valid)[1]
    counts = ("n_core", "n_brand", "n_scenario", "n_both", "n_raised", "raised", "ceiling", "keep_brand", "keep_scenario")
    return valid.select("request_id", requests.signature().alias("sig")).join(decided, "sig").select("request_id", *counts)


# One customer's request at a time is the interactive use: it takes the plan for few requests, whatever the size of the catalog.
@check("recommend_one", with_ctes(("ranked",), """
SELECT request_id, rank::INT AS rank, car_id, model_name, score FROM ranked WHERE request_id = (SELECT min(request_id) FROM requests)"""))
def recommend_one(spark, sf):
    valid = valid_requests(spark, sf)
    first = valid.filter(F.col("request_id") == valid.agg(F.min("request_id")).scalar())
    return recommend.recommend(views.items(spark, sf), first)[0].select("request_id", "rank", "car_id", "model_name", "score")


@check("core_match", with_ctes(("items", "requests"), """
SELECT request_id, count(*) AS n_items, min(car_id) AS first_car, max(car_id) AS last_car
FROM requests r JOIN items i ON i.price_min_wan <= r.budget_max_wan
  AND (r.body_type = '' OR i.body_type = r.body_type) AND (r.energy_type = '' OR i.energy_type = r.energy_type)
  AND (r.min_seats IS NULL OR coalesce(i.seats >= r.min_seats, false)) AND (r.min_sales IS NULL OR coalesce(i.sales >= r.min_sales, false))
  AND i.price_max_wan >= r.budget_min_wan
GROUP BY 1"""))
def core_match(spark, sf):
    """Pairs carry the number of the item in the order of car_id: smallest and largest numbers are summed up in place, texts would sort all pairs."""
    valid = valid_requests(spark, sf)
    named = written(ordering.numbered(views.items(spark, sf), ["car_id"], "place"))
    items = named.withColumn("car_id", F.when(F.col("car_id").isNotNull(), F.col("place")))
    pairs = recommend.core_matches(items, recommend.distinct_requests(valid, recommend.CORE_FIELDS))
    per_request = pairs.groupBy("sig").agg(F.count("*").alias("n_items"), F.min("car_id").alias("_first"), F.max("car_id").alias("_last"))
    for end in ("first", "last"):
        per_request = per_request.join(named.select(F.col("place").alias(f"_{end}"), F.col("car_id").alias(f"{end}_car")), f"_{end}", "left").drop(f"_{end}")
    asked = valid.select("request_id", requests.signature(recommend.CORE_FIELDS).alias("sig"))
    return asked.join(per_request, "sig").select("request_id", "n_items", "first_car", "last_car")


@check("request_rejections", with_ctes(("request_errors",), """
SELECT request_id, problem[1] AS code, problem[2] AS message, problem[3] AS field, 400 AS status FROM request_errors WHERE problem IS NOT NULL"""))
def request_rejections(spark, sf):
    return requests.validate_requests(views.raw_requests(spark, sf))[1]


@check("request_normalized", with_ctes(("requests",), """
SELECT request_id, budget_min_wan, budget_max_wan, body_type, energy_type, array_to_string(brands, '|') AS brands, scenario,
  min_seats, min_sales, "limit" FROM requests"""))
def request_normalized(spark, sf):
    return valid_requests(spark, sf).withColumn("brands", joined("brands")).drop("use_llm")


@check("price_labels", with_ctes(("ranked",), """
SELECT request_id, car_id, price_label, round(price_value, 6) AS price_value FROM ranked"""))
def price_labels(spark, sf):
    valid = valid_requests(spark, sf).select("request_id", "budget_min_wan", "budget_max_wan")
    priced = views.items(spark, sf).select("car_id", "price_mid_wan")
    rows = ranked(spark, sf).select("request_id", "car_id", "price_min_wan").join(valid, "request_id").join(priced, "car_id")
    return rows.select(
        "request_id", "car_id", recommend.price_factor().alias("price_label"),
        F.round(recommend.price_score(), 6).alias("price_value"),
    )


@check("matched_factors", with_ctes(("explained",), """
SELECT request_id, rank::INT AS rank, array_to_string(matched_factors, '|') AS matched_factors FROM explained"""))
def matched_factors(spark, sf):
    return ranked(spark, sf).select("request_id", "rank", joined("matched_factors"))


@check("template_reasons", with_ctes(("explained",), """
SELECT request_id, rank::INT AS rank, CASE WHEN len(matched_factors) = 0 THEN model_name || '满足当前核心筛选条件，可加入候选清单进一步比较。'
  ELSE '推荐 ' || model_name || '，因为' || array_to_string(matched_factors, '，并且') || '。' END AS reason, 'template' AS reason_source FROM explained"""))
def template_reasons(spark, sf):
    return ranked(spark, sf).select("request_id", "rank", "reason", "reason_source")


@check("weighted_scores", with_ctes(("ranked",), """
SELECT score, count(*) AS n_rows FROM ranked GROUP BY 1"""))
def weighted_scores(spark, sf):
    return ranked(spark, sf).groupBy("score").agg(F.count("*").alias("n_rows"))


@check("public_fields_json")
def public_fields_json(spark, sf):
    return views.items(spark, sf).select("car_id", recommend.public_json().alias("public"))


@check("compare_lookup", with_ctes(("compared",), """
SELECT set_id, pos::INT AS pos, car_id, model_name, brand, price_min_wan, sales FROM compared"""))
def compare_lookup(spark, sf):
    items = views.items(spark, sf)
    valid, _ = compare.check_sets(views.comparison_sets(spark, sf), items)
    return compare.compare_items(items, valid).select(
        "set_id", "pos", "car_id", "model_name", "brand", "price_min_wan", "sales"
    )


@check("compare_unknown_ids", with_ctes(("set_errors",), """
SELECT set_id, code, CASE code WHEN 'INVALID_COMPARE_COUNT' THEN '请选择 2—3 款车型进行对比' WHEN 'DUPLICATE_CAR' THEN '对比车型不能重复'
  ELSE '车型不存在：' || missing END AS message, 'car_ids' AS field, CASE code WHEN 'CAR_NOT_FOUND' THEN 404 ELSE 400 END AS status
FROM set_errors WHERE code IS NOT NULL"""))
def compare_unknown_ids(spark, sf):
    return compare.check_sets(views.comparison_sets(spark, sf), views.items(spark, sf))[1]


def compared(spark, sf):
    items = views.items(spark, sf)
    return compare.compare_items(items, compare.check_sets(views.comparison_sets(spark, sf), items)[0])


@check("radar_scores", with_ctes(("compared",), """
SELECT set_id, pos::INT AS pos, car_id,
  greatest(0::DOUBLE, least(100::DOUBLE, round(CASE WHEN hi = lo THEN 100 ELSE 30 + 70 * (hi - price_min_wan) / (hi - lo) END, 1))) AS price_score,
  greatest(0::DOUBLE, least(100::DOUBLE, round(coalesce(100.0::DOUBLE * horsepower / greatest(hp, 1), 0), 1))) AS power_score,
  greatest(0::DOUBLE, least(100::DOUBLE, round(coalesce(100.0::DOUBLE * seats / greatest(st, 1), 0), 1))) AS seats_score,
  greatest(0::DOUBLE, least(100::DOUBLE, round(CASE WHEN model_year IS NULL THEN 0 WHEN y0 = y1 THEN 100 ELSE 50 + 50.0::DOUBLE * (model_year - y0) / (y1 - y0) END, 1))) AS freshness_score,
  greatest(0::DOUBLE, least(100::DOUBLE, round(coalesce(100 * normalized_heat, 0), 1))) AS heat_score,
  greatest(0::DOUBLE, least(100::DOUBLE, round(100 * data_completeness, 1))) AS completeness_score
FROM (SELECT *, max(price_min_wan) OVER w AS hi, min(price_min_wan) OVER w AS lo, max(coalesce(horsepower, 0)) OVER w AS hp,
    max(coalesce(seats, 0)) OVER w AS st, min(model_year) OVER w AS y0, max(model_year) OVER w AS y1
  FROM compared WINDOW w AS (PARTITION BY set_id))"""))
def radar_scores(spark, sf):
    return compare.radar_scores(compared(spark, sf))


def _matrix_sql() -> str:
    shown = {
        "price_min_wan": "CASE WHEN printf('%.2f', price_min_wan) = printf('%.2f', price_max_wan) THEN printf('%.2f 万', price_min_wan) ELSE printf('%.2f—%.2f 万', price_min_wan, price_max_wan) END",
        "sales": "format('{:,} 辆', sales)", "seats": "seats || ' 座'", "range_km": "printf('%.0f km', range_km)",
        "horsepower": "horsepower || ' hp'", "data_completeness": "round(data_completeness * 100)::INT || '%'",
    }
    cells = ", ".join(
        f"{{'no': {i}, 'label': '{label}', 'value': CASE WHEN {name} IS NOT NULL THEN ({shown.get(name, name)})::VARCHAR END}}"
        for i, (label, name) in enumerate(vocab.COMPARISON_ATTRIBUTES)
    )
    return with_ctes(("compared",), f"""
SELECT set_id, no::INT AS attribute_no, label AS attribute, coalesce(v1, '—') AS item_1, coalesce(v2, '—') AS item_2,
  CASE WHEN n = 3 THEN coalesce(v3, '—') END AS item_3
FROM (SELECT set_id, c.no AS no, c.label AS label, count(*) AS n, max(c.value) FILTER (pos = 0) AS v1, max(c.value) FILTER (pos = 1) AS v2,
    max(c.value) FILTER (pos = 2) AS v3
  FROM (SELECT set_id, pos, unnest([{cells}]) AS c FROM compared) GROUP BY ALL)
WHERE coalesce(v1, v2, v3) IS NOT NULL""")


@check("comparison_matrix", _matrix_sql())
def comparison_matrix(spark, sf):
    return compare.comparison_matrix(compared(spark, sf))


@check("display_strings", with_ctes(("items",), """
SELECT car_id, CASE WHEN printf('%.2f', price_min_wan) = printf('%.2f', price_max_wan) THEN printf('%.2f 万', price_min_wan)
    ELSE printf('%.2f—%.2f 万', price_min_wan, price_max_wan) END AS price_text,
  CASE WHEN sales IS NULL THEN '月销量暂无数据' ELSE coalesce(sales_period || ' · ', '') || format('月销量 {:,} 辆', sales) END AS sales_text
FROM items"""))
def display_strings(spark, sf):
    return views.items(spark, sf).select(
        "car_id",
        rules.display_price("price_min_wan", "price_max_wan").alias("price_text"),
        rules.display_sales("sales", "sales_period").alias("sales_text"),
    )


@check("requests_from_json", with_ctes(("requests",), """
SELECT request_id, budget_min_wan, budget_max_wan, array_to_string(brands, '|') AS brands, scenario, min_seats, min_sales, "limit" FROM requests"""))
def requests_from_json(spark, sf):
    bodies = views.raw_requests(spark, sf).select("request_id", F.to_json(F.struct(*requests.RAW_FIELDS)).alias("body"))
    valid, _ = requests.validate_requests(requests.requests_from_json(bodies, "body"))
    return valid.select(
        "request_id", "budget_min_wan", "budget_max_wan", joined("brands"), "scenario", "min_seats", "min_sales", "limit"
    )
