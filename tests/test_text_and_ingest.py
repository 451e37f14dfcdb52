import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wheelbase import staging, vocab
from wheelbase.functions import rules, text
from wheelbase.operators import ingest
from wheelbase import schemas
from wheelbase.plans import ingest_job
from workload import ingest_checks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(value):
    return F.lit(value)


def test_clean_text_cases(spark):
    for raw, want in {
        "主：●&nbsp;副：○": "主：● 副：○", "a<b>b</b>c": "a b c", " x  　 y ": "x y", "5 < 6 > 4": "5 < 6 > 4",
        "caf&eacute; &#8364;": "café €", "<script>var t='</p>'</script>ok<br>": "ok", None: "",
    }.items():
        assert one(spark, text.clean_text(lit(raw).cast("string"))) == want
    assert one(spark, text.clean_text(lit("A&amp;B&nbsp;C"), "common")) == "A&B C"
    assert one(spark, text.clean_texts(F.array(lit("a&nbsp;b"), lit(None), lit("<i>c</i>\u001fd")))) == ["a b", "", "c d"]
    assert one(spark, text.clean_texts(F.array().cast("array<string>"))) == []


def test_numbers_units_and_states(spark):
    def parsed(value):
        number, unit = text.parse_single_number(lit(value))
        return one(spark, number), one(spark, unit)

    assert parsed("32.29万") == (32.29, "万")
    assert parsed("5038×1886×1475") == (None, "")
    assert parsed("9.5L/100km") == (9.5, "L/100km")
    assert one(spark, text.first_number(lit("8,709"))) == 8709 and one(spark, text.first_number(lit("8,709"), False)) == 8
    assert [one(spark, c) for c in text.number_range(lit("12.5-20.8万"))] == [12.5, 20.8]
    assert [one(spark, c) for c in text.split_unit(lit("最高车速(km/h)"))] == ["最高车速", "km/h"]
    states = {"主：● 副：○": "mixed", "●": "standard", "○": "optional", "-": "missing", " - -": "missing", "": "missing", "5": "value"}
    for value, want in states.items():
        assert one(spark, text.equipment_state(lit(value))) == want
    assert one(spark, text.last_digit_in_range(lit("●5/7座"))) == 7
    assert one(spark, text.last_digit_in_range(lit("10"))) is None


def test_energy_rules_order_is_data(spark):
    value = lit("非插电式混合电动车")
    assert one(spark, rules.classify_keywords(value, vocab.ENERGY_RULES)) == "混动"
    assert one(spark, rules.classify_keywords(value, vocab.ENERGY_RULES_PLUG_IN_FIRST)) == "插混"
    assert one(spark, rules.classify_keywords(lit(" PHEV "), vocab.ENERGY_RULES)) == "插混"
    assert one(spark, rules.classify_keywords(lit("氢"), vocab.ENERGY_RULES)) is None


PAYLOAD = {
    "ret": "ok",
    "data": {
        "arrCar": [
            {"car_id": "51", "car_name": "云雀 2023款 轻享", "decade": "2023", "transmission": 7, "seatnum": "●7"},
            {"car_id": "52", "car_name": "云雀 2023款 悦享"},
            {"car_id": "58", "car_name": "云雀 2024款 尊享", "decade": "none"},
        ],
        "arrConfig": {
            "3": {"车身": {"轴距(mm)": ["2650", "2650", "2710"], "油箱容积(L)": ["48.5", "-", "52"]}},
            "9": {"舒适": {"座椅加热": ["-", "○", "前排：●&nbsp;后排：○"]}, "多媒体": {"中控屏": ["●", "●", "●"]}},
        },
    },
}
PAGE = "<table><tr><th>月份</th><th>销量</th></tr>" + "".join(
    f"<tr><td>2031-{month:02d}</td><td>{measure}</td><td>{month}</td><td>{share}%</td><td>2</td><td>8</td><td>{note}</td></tr>"
    for month, measure, share, note in ((3, 412, 3.5, "甲注"), (2, 0, 0.0, "--"), (1, 1986, 11.25, "乙注"))
) + "</table>"


def test_payload_keeps_every_trim_parameter_pair(spark):
    parsed = ingest.parse_payloads(spark.createDataFrame([("1", json.dumps(PAYLOAD))], "series_id string, body string"))
    trims = {r.trim_id: r for r in ingest.explode_trims(parsed, "d").collect()}
    parameters = ingest.explode_parameters(parsed, "d")
    assert sorted(trims) == ["51", "52", "58"] and trims["51"].transmission == "7" and trims["52"].seats_raw == ""
    assert ingest.parameter_definitions(parameters).count() == 4
    rows = {(r.trim_id, r.parameter_name): r for r in parameters.collect()}
    assert len(rows) == 12
    assert rows["58", "轴距(mm)"].value_numeric == 2710 and rows["58", "轴距(mm)"].value_unit == "mm"
    assert rows["51", "油箱容积(L)"].value_numeric == 48.5
    states = [rows[trim, "座椅加热"].equipment_state for trim in ("51", "52", "58")]
    assert states == ["missing", "optional", "mixed"] and rows["52", "中控屏"].equipment_state == "standard"


def test_positions_count_after_keyless_items_and_bad_payloads_are_isolated(spark):
    shifted = json.loads(json.dumps(PAYLOAD))
    shifted["data"]["arrCar"].insert(0, {"car_id": " ", "car_name": "空"})
    bodies = [
        ("1", json.dumps(shifted)), ("2", "{broken"), ("3", "[]"), ("4", json.dumps({"ret": "fail", "data": 5})),
        ("5", json.dumps({"ret": "ok", "data": {"arrCar": {}, "arrConfig": {}}})), ("6", json.dumps({"ret": "ok"})), ("7", None),
    ]
    parsed = ingest.parse_payloads(spark.createDataFrame(bodies, "series_id string, body string"))
    rows = {(r.trim_id, r.parameter_name): r.value_text for r in ingest.explode_parameters(parsed, "d").collect()}
    assert rows["51", "轴距(mm)"] == "2650" and rows["58", "轴距(mm)"] == "2710"
    assert {r.series_id: r.failure for r in ingest.failures(parsed).collect()} == {
        "2": "load-options", "3": "load-options", "5": "parse-options", "7": "load-options",
    }


def test_monthly_table_rows(spark):
    rows = ingest.html_table_rows(spark.createDataFrame([("1", PAGE), ("2", "<p>none</p>"), ("3", None)], "series_id string, html string"), "d").collect()
    assert [r.sales_period for r in rows] == ["2031-03", "2031-02", "2031-01"]
    assert rows[0].sales == 412 and rows[2].manufacturer_share == "11.25%" and rows[2].registration_related == "乙注"


def test_listing_merge_and_tables(spark, tmp_path):
    box = lambda title, *items: f'<div class="brand_title">{title}</div><div class="brand_box"><ul>{"".join(items)}</ul></div>'
    item = lambda key, name, price: f'<li><a href="https://catalog.example/{key}/">{name}</a>' + (
        f'<a href="/price/sr-{key}">{price}</a>' if price else "") + "</li>"
    body = box("SUV", item(1, "甲", "10.5-12万"), item(2, "乙", ""), item(3, "丙", "20万")) + box("未列", item(9, "x", "1"))
    energy = box("纯电动车", item(3, "丙改", "99万"), item(4, "丁", "暂无"))
    pages = lambda html: spark.createDataFrame([(0, html)], "page_no int, html string")
    by_body = ingest.html_listing(pages(body), vocab.BODY_CATEGORY_LIMITS, "body")
    by_energy = ingest.html_listing(pages(energy), vocab.ENERGY_CATEGORY_LIMITS, "energy")
    merged = ingest.merge_candidates([by_body, by_energy])
    got = {r.series_id: (r.name, r.list_price_min, r.list_price_max, r.body_hints, r.energy_hints) for r in merged.collect()}
    assert got == {"1": ("甲", 10.5, 12.0, ["SUV"], []), "3": ("丙", 20.0, 20.0, ["SUV"], ["纯电动车"])}
    assert [r.series_id for r in ingest.limit_candidates(merged, 1).collect()] == ["1"]

    options = spark.createDataFrame([("1", json.dumps(PAYLOAD))], "series_id string, body string")
    measures = spark.createDataFrame([("3", PAGE)], "series_id string, html string")
    manifest = ingest_job.run(merged, options, measures, "2026-07-10", str(tmp_path / "out"))
    # The catalog job can read what was written.
    assert spark.read.schema(schemas.TRIMS).parquet(str(tmp_path / "out" / "trims.parquet")).filter("model_year = 2023").collect()
    assert {r.table_name: r.n_rows for r in manifest.collect()} == {
        "series": 2, "trims": 3, "trim_parameters": 12, "parameter_definitions": 4, "series_month_sales": 3, "failures": 0,
    }


def test_one_bad_value_stops_nothing(spark, tmp_path):
    merged = spark.createDataFrame([(str(i), f"n{i}", 1.0, 2.0, [], []) for i in range(1, 5)], "series_id string, name string, list_price_min double, "
                                   "list_price_max double, body_hints array<string>, energy_hints array<string>")
    options = spark.createDataFrame([("1", json.dumps(PAYLOAD)), ("2", "{")], "series_id string, body string")
    huge = "<table><tr><td>2026-01</td><td>99999999999</td></tr><tr><td>2026-02</td><td>12</td></tr><tr><td>2026-03</td></tr><tr></tr></table>"
    measures = spark.createDataFrame([("3", PAGE), ("4", huge)], "series_id string, html string")
    counts = {r.table_name: r.n_rows for r in ingest_job.run(merged, options, measures, "2026-07-10", str(tmp_path / "out")).collect()}
    assert counts["series"] == 4 and counts["series_month_sales"] == 5 and counts["failures"] == 2
    written = spark.read.parquet(str(tmp_path / "out" / "series_month_sales.parquet")).filter("series_id = '4'").collect()
    assert {(r.sales_period, r.sales) for r in written} == {("2026-01", None), ("2026-02", 12)}
    record = spark.read.json(str(tmp_path / "out" / "manifest.json")).first()
    assert {(f.failure, f.n, f.first_series) for f in record.failures} == {("load-options", 1, "2"), ("parse-sales", 1, "4")}
    assert record.selected_series == 4 and record.counts.trims == counts["trims"] and record.captured_at == "2026-07-10" and record.build_only


def test_manual_candidates_take_the_inferred_name(spark):
    good, bad = ingest.manual_candidates(spark.createDataFrame([(" 1 ",), ("x",)], "series_id string"))
    assert [r.series_id for r in bad.collect()] == ["x"]
    parsed = ingest.parse_payloads(spark.createDataFrame([("1", json.dumps(PAYLOAD))], "series_id string, body string"))
    row = ingest.series_rows(good, parsed, "d").first()
    assert row.series_name == "云雀" and row.list_price_min_wan is None and row.body_hints == ""


def test_listing_pages_of_one_file_are_parsed_by_all_cores(spark, tmp_path):
    parts = [(k, f"part {k}", f"Brand#{k % 5}", ("LARGE", "MEDIUM", "PROMO")[k % 3], k % 50 + 1, 900.0 + k) for k in range(40)]
    frame = spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    frame.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    pages = ingest_checks.listing_pages(spark, str(tmp_path))
    assert pages.count() == 40 and pages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    found = ingest_checks.html_listing(spark, str(tmp_path)).groupBy("category").count().collect()
    assert {r.category: r["count"] for r in found} == {"MPV": 2 * 14, "SUV": 13, "跑车": 3 * 13}


def test_only_texts_that_may_be_numbers_or_blank_are_looked_at_closely(spark):
    import re

    values = ["12", "-3.5%", "+7", "＋7", "", " ", " - ", "--", "- -", "---", "-●", ".5", "/1", ":", "9:", "●", "○ ●", "12×34", "Brand#12", "1 万", " 1", "é", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.single_number_text("v").alias("number"), text.equipment_state("v").alias("state"))
    # The pattern is tried behind a condition only.
    assert "CASE WHEN" in spark.range(1).select(text.single_number_text(F.lit("7")))._jdf.queryExecution().analyzed().toString()
    for v, number, state in df.collect():
        if v is None:
            assert number is None and state == "value"
            continue
        match, compact = re.match(text.SINGLE_NUMBER, v, re.ASCII), v.replace(" ", "")
        assert number == (match.group(1) if match else ""), v
        marks = ("●" in v, "○" in v)
        expected = "missing" if compact in ("", "-", "--") else {(True, True): "mixed", (True, False): "standard", (False, True): "optional"}.get(marks, "value")
        assert state == expected, v


def test_texts_are_made_of_the_asked_attributes_only(spark, tmp_path):
    from datetime import datetime

    from workload import views

    lines = [(1, 7, 50, n, 4.0 + n, 900.0, 0.0, 0.01, "A", "F", datetime(1995, 3, n)) for n in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, "p", "Brand#1", "LARGE", 3, 900.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    rows = views.attributes(spark, str(tmp_path))
    assert rows.count() == 18 and rows.select("trim_id", "parameter_key").distinct().count() == 18
    prices = rows.filter(F.col("parameter_name") == vocab.PARAM_PRICE)
    assert [r.value_numeric for r in prices.select("value_numeric").collect()] == [0.18, 0.18]
    # The filter stands right above the repeated line items, where no text has been made yet.
    plan = prices.select("value_numeric")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" not in plan and "Generate explode" in plan


def test_plain_pages_are_read_without_the_parser_and_odd_ones_like_before(spark, monkeypatch):
    """Pages of proper tags need no parser; whatever else a page holds, its rows are the parser's."""
    plain = [
        "<table border=\"0\"><tr class='a b'><TD width=3> 2024-01 </td><td><b>8</b>,709 &amp;<br/>x</td></tr><tr><td>2024-02<td>5</table><table><tr><td>2020-01</td></tr></table>",
        "<td>lost</td><table><td>none<tr><td>2024-03<table><tr><td>inner</td></tr></table><td>a > b", "no table", "",
    ]
    odd = [
        "<table><!-- <td>no</td> --><tr><td>2024-04</td><td>1 < 2</td></tr></table>", "<table><tr><td title='a>b'>2024-05</td><td>3</td></tr></table>",
        "<script>if (a<b) '<td>'</script><table><tr><td>2024-06</td><td>4</td></tr></table>",
    ]
    expected = [
        [["2024-01", "8 ,709 & x"], ["2024-02", "5"]], [["2024-03"], ["inner", "a > b"]], [], [],
        [["2024-04", "1 < 2"]], [["2024-05", "3"]], [["2024-06", "4"]],
    ]
    pages = spark.createDataFrame(list(enumerate(plain + odd)), "i int, html string").coalesce(1)
    found = {r.i: r.cells for r in pages.select("i", ingest._table_cells("html").alias("cells")).collect()}
    assert {i: found[i] for i in range(4)} == dict(enumerate(expected[:4]))
    assert {i: found[i] for i in range(4, 7)} == dict(enumerate(expected[4:], 4))
    read = []
    monkeypatch.setattr(ingest.F, "arrow_udf", lambda f, returnType: read.append(f) or (lambda column: column))
    ingest._table_cells("html")
    # Without the parser, plain pages are still read.
    monkeypatch.setattr("html.parser.HTMLParser.feed", lambda self, data: 1 / 0)
    assert read[0](pa.array(plain)).to_pylist() == expected[:4]
    with pytest.raises(ZeroDivisionError):
        read[0](pa.array(odd[:1]))


def test_definitions_clean_no_values_and_the_manifest_parses_once(spark, monkeypatch):
    """The names are cleaned apart from the values, to the same rows; the four counts read stored payloads."""
    body = json.dumps({"ret": "ok", "data": {"arrCar": [{"car_id": "a"}, {"car_id": ""}, {"car_id": "b"}], "arrConfig": {"0": {"g&amp;h": {"n&lt;o": ["1&nbsp;2", None, "<b>3</b>"], "p": []}}}}})
    parsed = ingest.parse_payloads(spark.createDataFrame([("1", body), ("2", "{")], "series_id string, body string"))
    rows = {entities: sorted(map(str, ingest.explode_parameters(parsed, "d", entities).collect())) for entities in ("all", "common")}
    assert rows["all"] == rows["common"] and len(rows["all"]) == 4
    plan = ingest.parameter_definitions(ingest.explode_parameters(parsed, "d", "common"))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(cells" not in plan and "concat(array(raw_group" not in plan
    stored = []
    monkeypatch.setattr(ingest_checks, "payloads", lambda spark, sf: parsed)
    monkeypatch.setattr(ingest_checks, "written", lambda frame: stored.append(1) or staging.written(frame))
    counted = ingest_checks.manifest_counts(spark, "")
    assert {r.table_name: r.n_rows for r in counted.collect()} == {"trims": 2, "trim_parameters": 4, "parameter_definitions": 2, "failures": 1}
    assert stored and "from_json" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_a_whole_attribute_table_makes_its_texts_once(spark, tmp_path, monkeypatch):
    """All columns from one clean text, with the rows of the table that is read in parts."""
    from datetime import datetime

    from workload import source_checks, views

    lines = [(1, 7, 50 * n, n, 4.0 + n, 900.0 * n, 0.05 * (n % 3), 0.01, "ANR"[n % 3], "FO"[n % 2], datetime(1995, 3, n)) for n in range(1, 8)] + [(2, 7, None, 3, None, None, None, None, None, None, None)] * 2
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, "p", "Brand#1", "LARGE", 3, 900.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    by_part, whole = (views.attributes(spark, str(tmp_path), whole=w) for w in (False, True))
    assert whole.columns == by_part.columns
    rows = sorted(map(str, whole.collect()))
    assert rows == sorted(map(str, by_part.collect())) and len(rows) == 81
    made_once = ["Generate inline" in frame._jdf.queryExecution().optimizedPlan().toString() for frame in (by_part, whole)]
    assert made_once == [False, True]
    # The query that writes the whole table takes it so.
    asked = []
    monkeypatch.setattr(views, "attributes", lambda spark, sf, whole=False: asked.append(whole) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        source_checks.source_switch(spark, str(tmp_path))
    assert asked == [True]
