"""Cleaning operators, joins and aggregates of the catalog job."""

from __future__ import annotations

from pyspark.sql import functions as F

from wheelbase import vocab
from wheelbase.functions import rules, text
from wheelbase.operators import catalog, summary
from wheelbase.sources import tables
from workload import views
from workload.ctes import COMPLETENESS, half_up, keyword_case, stable_id, tags, with_ctes
from workload.registry import check


@check("class_by_keywords", with_ctes(("trims",), f"""
SELECT energy_type_raw, {keyword_case('lower(trim(energy_type_raw))', vocab.ENERGY_RULES)} AS energy_type,
  {keyword_case('lower(trim(energy_type_raw))', vocab.ENERGY_RULES_PLUG_IN_FIRST)} AS energy_type_plug_in_first, count(*) AS n_rows
FROM trims GROUP BY ALL"""))
def class_by_keywords(spark, sf):
    trims = views.trims(spark, sf)
    return trims.groupBy(
        "energy_type_raw",
        rules.classify_keywords("energy_type_raw", vocab.ENERGY_RULES).alias("energy_type"),
        rules.classify_keywords("energy_type_raw", vocab.ENERGY_RULES_PLUG_IN_FIRST).alias("energy_type_plug_in_first"),
    ).agg(F.count("*").alias("n_rows"))


@check("last_digit_extract", with_ctes(("trims",), """
SELECT seats_raw, try_cast(nullif(regexp_extract(seats_raw, '.*([2-9])', 1), '') AS INT) AS seats, count(*) AS n_rows
FROM trims GROUP BY ALL"""))
def last_digit_extract(spark, sf):
    trims = views.trims(spark, sf)
    return trims.groupBy("seats_raw", text.last_digit_in_range("seats_raw").alias("seats")).agg(F.count("*").alias("n_rows"))


@check("trim_projection", with_ctes(("typed_trims",), "SELECT * FROM typed_trims"))
def trim_projection(spark, sf):
    return catalog.trim_projection(views.trims(spark, sf))


@check("body_classes", with_ctes(("assembled",), """
SELECT level_name, body_structure, CASE WHEN contains(level_name, 'SUV') THEN 'SUV' WHEN contains(level_name, 'MPV') THEN 'MPV'
    WHEN contains(level_name, '跑车') THEN '跑车' WHEN contains(level_name, '轻客') THEN '轻客' WHEN contains(body_structure, '两厢') THEN '两厢车'
    WHEN regexp_matches(level_name, '微型车|小型车|紧凑型车|中型车|中大型车|大型车') THEN '轿车' ELSE trim(body_structure) END AS body_type,
  count(*) AS n_rows FROM assembled GROUP BY ALL"""))
def body_classes(spark, sf):
    return views.assembled(spark, sf).groupBy(
        "level_name", "body_structure", rules.classify_body("level_name", "body_structure").alias("body_type")
    ).agg(F.count("*").alias("n_rows"))


@check("range_nullout", """
SELECT p_partkey, CASE WHEN p_size - 5 BETWEEN 2 AND 9 THEN p_size - 5 END AS seats, CASE WHEN p_size - 25 > 0 THEN p_size - 25 END AS horsepower,
  CASE WHEN p_size / 1.5::DOUBLE BETWEEN 0.1 AND 30 THEN round(p_size / 1.5::DOUBLE, 4) END AS fuel_consumption,
  CASE WHEN 1990 + p_size BETWEEN 2000 AND 2100 THEN 1990 + p_size END AS model_year FROM part""")
def range_nullout(spark, sf):
    size = F.col("p_size")
    return views.table(spark, sf, "part").select(
        "p_partkey",
        rules.null_out_of_range(size - 5, 2, 9).alias("seats"),
        rules.null_out_of_range(size - 25, 0, exclusive_low=True).alias("horsepower"),
        F.round(rules.null_out_of_range(size / 1.5, 0.1, 30), 4).alias("fuel_consumption"),
        rules.null_out_of_range(1990 + size, 2000, 2100).alias("model_year"),
    )


@check("upper_bound_repair", """
SELECT p_partkey, p_retailprice AS low, CASE WHEN high >= p_retailprice THEN high ELSE p_retailprice END AS high
FROM (SELECT *, CASE WHEN p_size % 5 <> 0 THEN 925.0::DOUBLE + p_size END AS high FROM part)""")
def upper_bound_repair(spark, sf):
    high = F.when(F.col("p_size") % 5 != 0, F.lit(925.0) + F.col("p_size"))
    return views.table(spark, sf, "part").select(
        "p_partkey", F.col("p_retailprice").alias("low"), rules.repair_upper_bound(high, "p_retailprice").alias("high")
    )


@check("price_mid", f"""
SELECT p_partkey, {half_up('(p_retailprice + (p_retailprice + p_size)) / 2', 2)} AS price_mid FROM part""")
def price_mid(spark, sf):
    return views.table(spark, sf, "part").select(
        "p_partkey", rules.price_mid("p_retailprice", F.col("p_retailprice") + F.col("p_size")).alias("price_mid")
    )


@check("validity_filter", with_ctes(("valid_catalog",), """
SELECT source_key, model_name, brand, price_min_wan, price_max_wan, body_type, energy_type, seats, horsepower FROM valid_catalog"""))
def validity_filter(spark, sf):
    return catalog.validated(views.assembled(spark, sf)).select(
        "source_key", "model_name", "brand", "price_min_wan", "price_max_wan", "body_type", "energy_type", "seats", "horsepower"
    )


@check("dedupe_latest", """
SELECT user_id, event_type, event_id, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def dedupe_latest(spark, sf):
    events = views.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    newest_first = -F.unix_micros(F.col("ts").cast("timestamp"))
    latest = summary.dedupe_by_key(events, ["user_id", "event_type"], [newest_first, "event_id"])
    return latest.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@check("log_heat", with_ctes(("measures",), """
SELECT series_id, sales_period, CASE WHEN sales > 0 THEN round(ln(sales + 1) / (SELECT max(ln(sales + 1)) FROM measures WHERE sales > 0), 4) END AS heat
FROM measures"""))
def log_heat(spark, sf):
    measures = views.measures(spark, sf)
    return measures.select("series_id", "sales_period", catalog.log_heat(measures).alias("heat"))


@check("stable_ids", with_ctes((), f"SELECT o_orderkey, {stable_id('o_orderkey::VARCHAR')} AS car_id FROM orders"))
def stable_ids(spark, sf):
    orders = views.table(spark, sf, "orders")
    return orders.select("o_orderkey", rules.stable_id(F.col("o_orderkey").cast("string")).alias("car_id"))


@check("source_key", with_ctes(("trim_summary",), "SELECT series_id, energy_type, series_id || '-' || energy_type AS source_key FROM trim_summary"))
def source_key(spark, sf):
    keyed = summary.trim_summary(catalog.trim_projection(views.trims(spark, sf)))
    return keyed.select("series_id", "energy_type", catalog.source_key("series_id", "energy_type").alias("source_key"))


@check("scenario_tags", with_ctes(("item_base",), f"SELECT car_id, array_to_string({tags()}, '|') AS scenario_tags FROM item_base"))
def scenario_tags(spark, sf):
    items = views.items(spark, sf)
    return items.select("car_id", F.array_join(rules.scenario_tags(), "|").alias("scenario_tags"))


@check("completeness", with_ctes(("item_base",), f"SELECT car_id, {COMPLETENESS} AS data_completeness FROM item_base"))
def completeness(spark, sf):
    return views.items(spark, sf).select("car_id", rules.completeness().alias("data_completeness"))


CATALOG_SELECT = ", ".join(
    "array_to_string(scenario_tags, '|') AS scenario_tags" if c == "scenario_tags"
    else "strftime(updated_at, '%Y-%m-%d') AS updated_at" if c == "updated_at" else c
    for c in vocab.CATALOG_COLUMNS
)


@check("catalog_full", with_ctes(("catalog",), f"SELECT {CATALOG_SELECT} FROM catalog"))
def catalog_full(spark, sf):
    cleaned = catalog.clean_catalog(views.assembled(spark, sf))
    return catalog.export_form(cleaned).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd"))


@check("trim_summary", with_ctes(("trim_summary",), "SELECT * FROM trim_summary"))
def trim_summary(spark, sf):
    return summary.trim_summary(catalog.trim_projection(views.trims(spark, sf)))


@check("attr_pivot_agg", with_ctes(("attribute_columns",), "SELECT * FROM attribute_columns"))
def attr_pivot_agg(spark, sf):
    return catalog.attribute_columns(views.attributes(spark, sf), catalog.trim_projection(views.trims(spark, sf)))


@check("j_attr_trim", with_ctes(("attributes", "typed_trims"), """
SELECT energy_type, parameter_name, count(*) AS n_rows, count(DISTINCT trim_id) AS n_trims FROM attributes JOIN typed_trims USING (trim_id, series_id)
WHERE parameter_name IN ('厂商', '级别') GROUP BY ALL"""))
def j_attr_trim(spark, sf):
    typed = catalog.trim_projection(views.trims(spark, sf)).select("trim_id", "series_id", "energy_type")
    named = views.attributes(spark, sf).filter(F.col("parameter_name").isin(vocab.PARAM_BRAND, vocab.PARAM_LEVEL))
    return named.join(typed, ["trim_id", "series_id"]).groupBy("energy_type", "parameter_name").agg(
        F.count("*").alias("n_rows"), F.countDistinct("trim_id").alias("n_trims")
    )


@check("latest_measure", with_ctes(("latest_measure",), "SELECT * FROM latest_measure"))
def latest_measure(spark, sf):
    return summary.latest_measure(views.measures(spark, sf))


@check("latest_period", with_ctes(("measures",), """
SELECT max(sales_period) AS latest_period, count(*) AS n_rows FROM measures WHERE sales IS NOT NULL"""))
def latest_period(spark, sf):
    measures = views.measures(spark, sf)
    return measures.filter(F.col("sales").isNotNull()).agg(
        F.max("sales_period").alias("latest_period"), F.count("*").alias("n_rows")
    )


@check("catalog_assembly", with_ctes(("assembled",), """
SELECT * EXCLUDE (captured_at), strftime(captured_at, '%Y-%m-%d') AS captured_at FROM assembled"""))
def catalog_assembly(spark, sf):
    return views.assembled(spark, sf).withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd"))


@check("distribution_brand", "SELECT p_brand, count(*) AS n_rows FROM part GROUP BY 1 ORDER BY 2 DESC, 1")
def distribution_brand(spark, sf):
    return summary.distribution(views.table(spark, sf, "part"), "p_brand")


@check("price_stats", with_ctes(("items",), """
SELECT round(min(price_min_wan), 2) AS price_min, round(max(price_max_wan), 2) AS price_max, round(avg(price_mid_wan), 2) AS price_average FROM items"""))
def price_stats(spark, sf):
    return summary.price_stats(views.items(spark, sf))


@check("sales_stats", with_ctes(("items",), "SELECT max(sales_period) AS latest_period, max(sales) AS max_monthly_sales FROM items"))
def sales_stats(spark, sf):
    return summary.sales_stats(views.items(spark, sf))


@check("row_accounting", with_ctes(("assembled", "valid_catalog"), """
SELECT (SELECT count(*) FROM assembled) AS input_rows, (SELECT count(*) FROM valid_catalog) AS output_rows,
  (SELECT count(*) FROM assembled) - (SELECT count(*) FROM valid_catalog) AS removed_rows"""))
def row_accounting(spark, sf):
    raw = views.assembled(spark, sf)
    return summary.row_accounting(raw, catalog.validated(raw))


@check("facets", with_ctes(("items",), """
SELECT 'count' AS facet, field, name, count(*) AS n FROM (
  SELECT 'energy_type' AS field, coalesce(nullif(energy_type, ''), '其他') AS name FROM items UNION ALL
  SELECT 'body_type', coalesce(nullif(body_type, ''), '其他') FROM items) GROUP BY ALL
UNION ALL SELECT DISTINCT 'value', field, name, NULL::BIGINT FROM (
  SELECT 'brand' AS field, brand AS name FROM items UNION ALL SELECT 'body_type', body_type FROM items UNION ALL SELECT 'energy_type', energy_type FROM items)
  WHERE name <> ''
UNION ALL SELECT 'total', '', '', count(*) FROM items"""))
def facets(spark, sf):
    rows = summary.facets(
        views.items(spark, sf), ["energy_type", "body_type"], ["brand", "body_type", "energy_type"], vocab.OTHER_LABEL
    )
    return rows.orderBy(*summary.facet_order())


@check("date_fallbacks", """
SELECT o_orderkey, strftime(coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END, DATE '1990-01-01'), '%Y-%m-%d') AS captured_at,
  coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, o_orderkey::DOUBLE) AS price FROM orders""")
def date_fallbacks(spark, sf):
    orders = views.table(spark, sf, "orders")
    day = F.to_date(F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")))
    return orders.select(
        "o_orderkey",
        F.date_format(F.coalesce(day, F.lit("1990-01-01").cast("date")), "yyyy-MM-dd").alias("captured_at"),
        F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")), F.col("o_orderkey").cast("double")).alias("price"),
    )


@check("typed_catalog_load", with_ctes(("items",), """
SELECT car_id, price_min_wan, price_max_wan, seats, horsepower, sales, normalized_heat, len(scenario_tags) AS n_tags FROM items"""))
def typed_catalog_load(spark, sf):
    items = views.items(spark, sf).withColumn("scenario_tags", F.concat_ws("|", "scenario_tags"))
    as_text = items.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in items.columns])
    return tables.typed_catalog(as_text).select(
        "car_id", "price_min_wan", "price_max_wan", "seats", "horsepower", "sales", "normalized_heat",
        F.size("scenario_tags").alias("n_tags"),
    )


@check("table_fingerprint")
def table_fingerprint(spark, sf):
    return tables.table_fingerprint(views.measures(spark, sf))
