"""Text functions, payloads, pages and candidates of the ingest job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wheelbase.functions import text
from wheelbase.operators import ingest
from wheelbase.sources.tables import spread_rows
from wheelbase.staging import written
from workload import views
from workload.ctes import NUMBER_PATTERN, STATE, with_ctes
from workload.registry import check

MARKUP_SQL = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|</?[a-z][^>]*>|<![^>]*>"


def cleaned_sql(column: str) -> str:
    decoded = column
    for entity, char in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"),
                         ("&copy;", "'©'"), ("&middot;", "'·'"), ("&times;", "'×'"), ("&amp;", "'&'")):
        decoded = f"replace({decoded}, '{entity}', {char})"
    untagged = f"CASE WHEN contains(d, '<') AND contains(d, '>') THEN regexp_replace(d, '{MARKUP_SQL}', ' ', 'g') ELSE d END"
    spaced = f"regexp_replace({untagged}, '[\\s\\p{{Z}}]+', ' ', 'g')"
    return f"(SELECT trim({spaced}) FROM (SELECT {decoded} AS d))"


@check("clean_text", f"SELECT page_id, md5({cleaned_sql('html')}) AS digest, length({cleaned_sql('html')}) AS n_chars FROM pages")
def clean_text(spark, sf):
    cleaned = views.table(spark, sf, "pages").select("page_id", text.clean_text("html").alias("clean"))
    return cleaned.select("page_id", F.md5("clean").alias("digest"), F.length("clean").alias("n_chars"))


@check("clean_text_common", f"SELECT doc_id, md5({cleaned_sql('text')}) AS digest FROM documents")
def clean_text_common(spark, sf):
    documents = views.table(spark, sf, "documents")
    return documents.select("doc_id", F.md5(text.clean_text("text", "common")).alias("digest"))


@check("single_number", with_ctes(("attributes",), f"""
SELECT value_text, try_cast(nullif(regexp_extract(value_text, {NUMBER_PATTERN}, 1), '') AS DOUBLE) AS number,
  regexp_extract(value_text, {NUMBER_PATTERN}, 2) AS unit, count(*) AS n_rows FROM attributes GROUP BY ALL"""))
def single_number(spark, sf):
    number, unit = text.parse_single_number("value_text")
    rows = views.attributes(spark, sf).select("value_text")
    return rows.groupBy("value_text", number.alias("number"), unit.alias("unit")).agg(F.count("*").alias("n_rows"))


@check("first_number", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, try_cast(nullif(regexp_extract(replace(t, ',', ''), '\\d+(?:\\.\\d+)?', 0), '') AS DOUBLE) AS number,
  try_cast(nullif(regexp_extract(t, '\\d+(?:\\.\\d+)?', 0), '') AS DOUBLE) AS number_plain
FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN '--' ELSE '约 ' || format('{:,}', floor(l_extendedprice)::BIGINT) || ' 辆' END AS t FROM lineitem)""")
def first_number(spark, sf):
    shown = F.when(F.col("l_linenumber") == 7, "--").otherwise(
        F.concat(F.lit("约 "), F.format_number(F.floor("l_extendedprice"), 0), F.lit(" 辆"))
    )
    return views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        text.first_number(shown).alias("number"), text.first_number(shown, False).alias("number_plain"),
    )


@check("number_range", r"""
SELECT doc_id, list_min(n) AS low, list_max(n) AS high FROM (
  SELECT doc_id, list_transform(regexp_extract_all(text, '\d+(?:\.\d+)?'), lambda x: x::DOUBLE) AS n FROM documents)""")
def number_range(spark, sf):
    low, high = text.number_range("text")
    return views.table(spark, sf, "documents").select("doc_id", low.alias("low"), high.alias("high"))


@check("unit_split", with_ctes(("raw_attributes",), r"""
SELECT parameter_name, CASE WHEN regexp_matches(parameter_name, '\(([^()]*)\)\s*$') THEN trim(regexp_replace(parameter_name, '\(([^()]*)\)\s*$', '')) ELSE parameter_name END AS bare_name,
  trim(regexp_extract(parameter_name, '\(([^()]*)\)\s*$', 1)) AS unit, count(*) AS n_rows FROM raw_attributes GROUP BY ALL"""))
def unit_split(spark, sf):
    bare, unit = text.split_unit("parameter_name")
    rows = views.raw_attributes(spark, sf)
    return rows.groupBy("parameter_name", bare.alias("bare_name"), unit.alias("unit")).agg(F.count("*").alias("n_rows"))


@check("equipment_state", with_ctes(("attributes",), f"""
SELECT parameter_key, {STATE.format('value_text')} AS equipment_state, count(*) AS n_rows FROM attributes GROUP BY ALL"""))
def equipment_state(spark, sf):
    rows = views.attributes(spark, sf)
    return rows.groupBy("parameter_key", text.equipment_state("value_text").alias("equipment_state")).agg(
        F.count("*").alias("n_rows")
    )


@check("definitions", with_ctes(("attributes",), r"""
SELECT DISTINCT parameter_key, group_id, group_name, parameter_name, trim(regexp_extract(parameter_name, '\(([^()]*)\)\s*$', 1)) AS declared_unit FROM attributes"""))
def definitions(spark, sf):
    return ingest.parameter_definitions(views.attributes(spark, sf))


@check("inferred_names", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN coalesce(nullif(CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name END, ''), p_partkey::VARCHAR) ELSE p_name END AS series_name FROM part""")
def inferred_names(spark, sf):
    key = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 2 == 0, key).otherwise(F.col("p_name"))
    trim_name = F.concat(F.when(F.col("p_partkey") % 10 == 0, "").otherwise(F.col("p_name")), F.lit(" 2026款 标准型"))
    return views.table(spark, sf, "part").select(
        "p_partkey", text.inferred_series_name(name, key, trim_name).alias("series_name")
    )


# ------------------------------------------------------------------ payloads: one per line item, three items each


def payloads(spark, sf):
    """JSON responses built row by row; some are not ok, some are cut off, the middle item has no key."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("string"))
    car = lambda suffix, name: F.struct(
        (F.concat(key, F.lit(suffix)) if suffix else F.lit(" ")).alias("car_id"),
        F.concat(F.lit(name), F.lit("&nbsp;2026款 "), F.col("l_returnflag")).alias("car_name"),
        F.year("l_shipdate").cast("string").alias("decade"),
        F.lit("汽油").alias("fueltype"),
    )
    quantity = F.col("l_quantity").cast("bigint").cast("string")
    config = F.create_map(
        F.lit("0"),
        F.create_map(
            F.lit("基本参数"),
            F.create_map(
                F.lit("最大马力(Ps)"), F.array(quantity, F.concat(quantity, F.lit("万"))),
                F.lit("尺寸"), F.array(F.concat(quantity, F.lit("×2"))),
            ),
        ),
        F.lit("6"),
        F.create_map(
            F.lit("安全&amp;装备"), F.create_map(F.lit("气囊"), F.array(F.lit("主：●&nbsp;副：○"), F.lit("-"), F.lit("●")))
        ),
    )
    body = F.to_json(
        F.struct(
            F.when(F.col("l_linenumber") == 7, "error").otherwise("ok").alias("ret"),
            F.struct(F.array(car("a", "甲"), car("", "空"), car("b", "乙")).alias("arrCar"), config.alias("arrConfig")).alias("data"),
        )
    )
    cut = (F.col("l_linenumber") == 6) & (F.col("l_discount") >= 0.095)
    lines = spread_rows(views.table(spark, sf, "lineitem"))
    responses = lines.select(key.alias("series_id"), F.when(cut, F.left(body, F.lit(40))).otherwise(body).alias("body"))
    return ingest.parse_payloads(responses)


PAYLOAD_KEY = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice::VARCHAR"
PAYLOAD_OK = "l_linenumber <> 7 AND NOT (l_linenumber = 6 AND l_discount >= 0.095)"


@check("json_trims", f"""
SELECT k || s.x AS trim_id, k AS series_id, s.n || ' 2026款 ' || l_returnflag AS trim_name, year(l_shipdate)::VARCHAR AS model_year, '汽油' AS energy_type_raw,
  '' AS seats_raw, 'https://catalog.example/trim/' || k || s.x || '/options/' AS options_url
FROM (SELECT *, {PAYLOAD_KEY} AS k, unnest([{{'x': 'a', 'n': '甲'}}, {{'x': 'b', 'n': '乙'}}]) AS s FROM lineitem WHERE {PAYLOAD_OK})""")
def json_trims(spark, sf):
    return ingest.explode_trims(payloads(spark, sf), views.CAPTURED).select(
        "trim_id", "series_id", "trim_name", "model_year", "energy_type_raw", "seats_raw", "options_url"
    )


@check("json_parameters", f"""
SELECT k || c.t AS trim_id, k AS series_id, c.key AS parameter_key, c.v AS value_text, c.num AS value_numeric, c.u AS value_unit, c.st AS equipment_state
FROM (SELECT k, unnest([
    {{'t': 'a', 'key': '0|基本参数|最大马力(Ps)', 'v': q::VARCHAR, 'num': q::DOUBLE, 'u': 'Ps', 'st': 'value'}},
    {{'t': 'b', 'key': '0|基本参数|最大马力(Ps)', 'v': q || '万', 'num': q::DOUBLE, 'u': '万', 'st': 'value'}},
    {{'t': 'a', 'key': '0|基本参数|尺寸', 'v': q || '×2', 'num': NULL, 'u': '', 'st': 'value'}},
    {{'t': 'b', 'key': '0|基本参数|尺寸', 'v': '', 'num': NULL, 'u': '', 'st': 'missing'}},
    {{'t': 'a', 'key': '6|安全&装备|气囊', 'v': '主：● 副：○', 'num': NULL, 'u': '', 'st': 'mixed'}},
    {{'t': 'b', 'key': '6|安全&装备|气囊', 'v': '-', 'num': NULL, 'u': '', 'st': 'missing'}}]) AS c
  FROM (SELECT {PAYLOAD_KEY} AS k, l_quantity::BIGINT AS q FROM lineitem WHERE {PAYLOAD_OK}))""")
def json_parameters(spark, sf):
    return ingest.explode_parameters(payloads(spark, sf), views.CAPTURED).select(
        "trim_id", "series_id", "parameter_key", "value_text", "value_numeric", "value_unit", "equipment_state"
    )


@check("payload_failures", f"""
SELECT {PAYLOAD_KEY} AS series_id, 'load-options' AS failure FROM lineitem WHERE l_linenumber = 6 AND l_discount >= 0.095""")
def payload_failures(spark, sf):
    return ingest.failures(payloads(spark, sf))


@check("manifest_counts", f"""
SELECT 'trims' AS table_name, 2 * count(*) FILTER ({PAYLOAD_OK}) AS n_rows FROM lineitem
UNION ALL SELECT 'trim_parameters', 6 * count(*) FILTER ({PAYLOAD_OK}) FROM lineitem
UNION ALL SELECT 'parameter_definitions', 3 FROM (SELECT 1)
UNION ALL SELECT 'failures', count(*) FILTER (l_linenumber = 6 AND l_discount >= 0.095) FROM lineitem""")
def manifest_counts(spark, sf):
    # Four tables are made of the parsed payloads.
    parsed = written(payloads(spark, sf))
    parameters = ingest.explode_parameters(parsed, views.CAPTURED, "common")
    tables = {
        "trims": ingest.explode_trims(parsed, views.CAPTURED, entities="common"),
        "trim_parameters": parameters,
        "parameter_definitions": ingest.parameter_definitions(parameters),
    }
    return ingest.ingest_manifest(tables, ingest.failures(parsed))


# ------------------------------------------------------------------ pages


def measure_pages(spark, sf):
    """One page per line item: a header row, one monthly row, a total row and a second table."""
    cell = lambda value: F.concat(F.lit("<td> "), value, F.lit("</td>"))
    month = F.date_format("l_shipdate", "yyyy-MM")
    amount = F.format_number(F.floor("l_extendedprice"), 0)
    html = F.concat(
        F.lit("<p>x &lt; y</p><table><tr><th>时间</th><th>月销量</th></tr><tr>"),
        cell(month), cell(amount), cell(F.col("l_linenumber").cast("string")),
        F.when(F.col("l_linenumber") % 2 == 0, cell(F.concat(F.lit("<b>"), F.col("l_returnflag"), F.lit("</b>&amp;")))).otherwise(""),
        F.lit("</tr><tr><td>合计</td><td>1</td></tr></table><table><tr><td>2020-01</td><td>5</td></tr></table>"),
    )
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("string"))
    return spread_rows(views.table(spark, sf, "lineitem")).select(key.alias("series_id"), html.alias("html"))


@check("html_table", f"""
SELECT {PAYLOAD_KEY} AS series_id, strftime(l_shipdate, '%Y-%m') AS sales_period, floor(l_extendedprice)::INT AS sales, l_linenumber::VARCHAR AS overall_rank,
  CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || ' &' ELSE '' END AS manufacturer_share, '' AS manufacturer_rank FROM lineitem
WHERE year(l_shipdate) >= 2000""")
def html_table(spark, sf):
    return ingest.html_table_rows(measure_pages(spark, sf), views.CAPTURED).select(
        "series_id", "sales_period", "sales", "overall_rank", "manufacturer_share", "manufacturer_rank"
    )


ANCHOR_SQL = r"""(?s)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>"""


@check("html_links", f"""
SELECT page_id, (i - 1)::INT AS pos, regexp_extract_all(html, '{ANCHOR_SQL}', 1)[i] AS href, {cleaned_sql(f"regexp_extract_all(html, '{ANCHOR_SQL}', 2)[i]")} AS label
FROM (SELECT *, unnest(range(1, len(regexp_extract_all(html, '{ANCHOR_SQL}', 1)) + 1)) AS i FROM pages)""")
def html_links(spark, sf):
    return ingest.page_links(views.table(spark, sf, "pages"), "page_id")


CATEGORIES = {"SUV": 1, "MPV": 2, "跑车": 100}


def listing_pages(spark, sf):
    """One page per part: its title, its box with three items, an unlisted box and an item without price."""
    key = F.col("p_partkey")
    item = lambda n, price: F.concat(
        F.lit('<li><a href="https://catalog.example/'), (key * 10 + n).cast("string"), F.lit('/"><img src="x"></a>'),
        F.lit('<a href="https://catalog.example/'), (key * 10 + n).cast("string"), F.lit('/">'), F.col("p_name"), F.lit(f" {n}</a>"),
        F.concat(F.lit('<a href="https://catalog.example/price/sr-1">'), price, F.lit("</a>")) if price is not None else F.lit(""),
        F.lit("</li>"),
    )
    size = F.col("p_size").cast("string")
    title = views.by_type(views.BODIES)
    box = lambda head, *items: F.concat(
        F.lit('<div class="brand_title big"><h3>'), head, F.lit('</h3></div><div class="brand_box"><ul>'), *items, F.lit("</ul></div>")
    )
    html = F.concat(
        F.lit("<html><body><ul><li>menu</li></ul>"),
        box(title, item(1, F.concat(size, F.lit("-99.5万"))), item(2, None), item(3, size), item(4, F.concat(F.lit("约"), size))),
        box(F.lit("其他"), item(5, size)),
        F.lit("</body></html>"),
    )
    return spread_rows(views.table(spark, sf, "part")).select(key.alias("page_no"), html.alias("html"))


LISTING_SQL = f"""
SELECT p_partkey AS page_no, category, (p_partkey * 10 + s.n)::VARCHAR AS series_id, p_name || ' ' || s.n AS name,
  CASE s.n WHEN 1 THEN least(p_size, 99.5::DOUBLE) ELSE p_size::DOUBLE END AS list_price_min, CASE s.n WHEN 1 THEN greatest(p_size, 99.5::DOUBLE) ELSE p_size::DOUBLE END AS list_price_max
FROM (SELECT *, CASE p_type WHEN 'ECONOMY' THEN '轿车' WHEN 'LARGE' THEN 'MPV' WHEN 'MEDIUM' THEN 'SUV' WHEN 'PROMO' THEN '跑车' WHEN 'SMALL' THEN '两厢车' ELSE 'SUV' END AS category,
    unnest([{{'n': 1, 'r': 1}}, {{'n': 3, 'r': 2}}, {{'n': 4, 'r': 3}}]) AS s FROM part)
WHERE category IN ('SUV', 'MPV', '跑车') AND s.r <= CASE category WHEN 'SUV' THEN 1 WHEN 'MPV' THEN 2 ELSE 100 END"""


@check("html_listing", LISTING_SQL)
def html_listing(spark, sf):
    return ingest.html_listing(listing_pages(spark, sf), CATEGORIES, "body").select(
        "page_no", "category", "series_id", "name", "list_price_min", "list_price_max"
    )


@check("top_n_per_category", """
SELECT p_brand, p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS rn FROM part)
WHERE rn <= CASE p_type WHEN 'ECONOMY' THEN 3 WHEN 'LARGE' THEN 1 WHEN 'PROMO' THEN 7 ELSE 100000 END""")
def top_n_per_category(spark, sf):
    limits = {"ECONOMY": 3, "LARGE": 1, "PROMO": 7, "SMALL": 100_000, "MEDIUM": 100_000, "STANDARD": 100_000}
    parts = views.table(spark, sf, "part").select("p_brand", "p_type", "p_partkey")
    return ingest.top_n_per_category(parts, limits, ("p_brand", "p_type"), ("p_partkey",), "p_type")


# ------------------------------------------------------------------ candidates


def listing(spark, sf, hint: str) -> "views.DataFrame":
    """A listing of the parts; every third key is repeated."""
    key = F.col("p_partkey")
    return views.table(spark, sf, "part").select(
        (key % 7).cast("int").alias("page_no"), key.alias("pos"), F.col("p_type" if hint == "body" else "p_brand").alias("category"),
        (key - key % 3 % 2).cast("string").alias("series_id"), F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("list_price_min"), (F.col("p_retailprice") + 1).alias("list_price_max"), F.lit(hint).alias("hint_type"),
    )


CANDIDATE_SQL = """
listed AS (
  SELECT 0 AS l, p_partkey % 7 AS page_no, p_partkey AS pos, p_type AS category, (p_partkey - p_partkey % 3 % 2)::VARCHAR AS series_id, p_name AS name, p_retailprice AS lo, 'body' AS hint_type FROM part
  UNION ALL SELECT 1, p_partkey % 7, p_partkey, p_brand, (p_partkey - p_partkey % 3 % 2)::VARCHAR, p_name, p_retailprice, 'energy' FROM part),
candidates AS (
  SELECT series_id, arg_min(name, (l, page_no, pos)) AS name, arg_min(lo, (l, page_no, pos)) AS list_price_min, arg_min(lo, (l, page_no, pos)) + 1 AS list_price_max,
    min((l, page_no, pos)) AS ord, array_to_string(list_sort(list(DISTINCT category) FILTER (hint_type = 'body')), '|') AS body_hints,
    array_to_string(list_sort(list(DISTINCT category) FILTER (hint_type = 'energy')), '|') AS energy_hints FROM listed GROUP BY 1)"""


def candidates(spark, sf):
    return ingest.merge_candidates([listing(spark, sf, "body"), listing(spark, sf, "energy")])


@check("merge_candidates", f"""WITH {CANDIDATE_SQL} SELECT series_id, name, list_price_min, list_price_max, coalesce(body_hints, '') AS body_hints, coalesce(energy_hints, '') AS energy_hints FROM candidates""")
def merge_candidates(spark, sf):
    return candidates(spark, sf).select(
        "series_id", "name", "list_price_min", "list_price_max",
        F.array_join("body_hints", "|").alias("body_hints"), F.array_join("energy_hints", "|").alias("energy_hints"),
    )


@check("limit_candidates", f"WITH {CANDIDATE_SQL} SELECT series_id, name FROM candidates ORDER BY ord LIMIT 25")
def limit_candidates(spark, sf):
    return ingest.limit_candidates(candidates(spark, sf), 25).select("series_id", "name")


@check("has_response", f"""WITH {CANDIDATE_SQL} SELECT series_id FROM candidates WHERE series_id IN (
  SELECT o_custkey::VARCHAR FROM orders UNION SELECT s_suppkey::VARCHAR FROM supplier)""")
def has_response(spark, sf):
    """Ids of the customers who ordered stand for payloads, those of the suppliers for pages."""
    options = views.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("series_id"))
    pages = views.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("series_id"))
    return ingest.has_response(candidates(spark, sf), options, pages).select("series_id")


@check("valid_ids", """
SELECT trim(k) AS series_id, true AS accepted, count(*) AS n_rows FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN ' ' || o_custkey || ' ' WHEN 1 THEN 'x' || o_custkey ELSE o_custkey::VARCHAR END AS k FROM orders) WHERE regexp_matches(trim(k), '^\\d+$') GROUP BY ALL
UNION ALL SELECT k, false, count(*) FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN ' ' || o_custkey || ' ' WHEN 1 THEN 'x' || o_custkey ELSE o_custkey::VARCHAR END AS k FROM orders) WHERE NOT regexp_matches(trim(k), '^\\d+$') GROUP BY ALL""")
def valid_ids(spark, sf):
    customer, kind = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    key = F.when(kind == 0, F.concat(F.lit(" "), customer, F.lit(" "))).when(kind == 1, F.concat(F.lit("x"), customer)).otherwise(customer)
    good, bad = ingest.valid_id_filter(views.table(spark, sf, "orders").select(key.alias("series_id")))
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.groupBy("series_id", "accepted").agg(F.count("*").alias("n_rows"))


@check("series_rows", f"""WITH {CANDIDATE_SQL} SELECT series_id, name AS series_name, list_price_min AS list_price_min_wan, list_price_max AS list_price_max_wan,
  coalesce(body_hints, '') AS body_hints, coalesce(energy_hints, '') AS energy_hints, 'https://catalog.example/' || series_id || '/' AS source_url,
  'https://catalog.example/' || series_id || '/options/' AS options_url, 'https://catalog.example/sales/' || series_id || '/' AS sales_url, '2026-07-10' AS captured_at FROM candidates""")
def series_rows(spark, sf):
    return ingest.series_rows(candidates(spark, sf), None, views.CAPTURED)
