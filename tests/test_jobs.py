import csv
import gzip
import hashlib
import random
import json
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMOKE
from wheelbase import schemas, staging, vocab
from wheelbase.operators import catalog, models, overview, summary
from wheelbase.plans import analysis_job, catalog_job, overview_job, recommend_job
from wheelbase.sources import tables
from workload import views


def write_csv_file(path, columns, rows, opener=open):
    with opener(path, "wt", encoding="utf-8", newline="") as handle:
        writer = csv.writer(handle, lineterminator="\n")
        writer.writerow(columns)
        writer.writerows(rows)


@pytest.fixture(scope="module")
def table_folder(spark, tmp_path_factory):
    """The normalized tables of the smoke data as CSV files, the long one compressed."""
    folder = tmp_path_factory.mktemp("tables")
    sources = {
        "series": views.series(spark, SMOKE).withColumn("energy_hints", F.lit("")),
        "trims": views.trims(spark, SMOKE),
        "parameters": views.attributes(spark, SMOKE),
        "measures": views.measures(spark, SMOKE),
    }
    for name, frame in sources.items():
        file, schema = tables.INPUT_FILES[name]
        columns = [part.split()[0] for part in schema.split(", ")]
        known = [F.col(c) if c in frame.columns else F.lit("").alias(c) for c in columns]
        rows = [["" if v is None else v for v in row] for row in frame.select(*known).collect()]
        write_csv_file(folder / file, columns, rows, gzip.open if file.endswith(".gz") else open)
    return str(folder)


def test_csv_scan_keeps_quotes_line_breaks_and_nulls(spark, tmp_path):
    path = tmp_path / "s.csv"
    write_csv_file(path, ["a", "b", "c"], [['x "q", y', "", "1.5"], ["line\nbreak", "t", "abc"]])
    rows = tables.scan_csv(spark, str(path), "a string, b string, c double", multiline=True).collect()
    assert rows[0].a == 'x "q", y' and rows[0].b is None and rows[0].c == 1.5
    assert rows[1].a == "line\nbreak" and rows[1].c is None
    tables.write_csv_single(spark.createDataFrame([('q "1"', "")], "a string, b string"), str(tmp_path / "out"))
    part = next(p for p in os.listdir(tmp_path / "out") if p.startswith("part-"))
    with open(tmp_path / "out" / part, newline="") as handle:
        assert list(csv.DictReader(handle)) == [{"a": 'q "1"', "b": ""}]


def test_required_inputs_and_source_switch(spark, tmp_path):
    with pytest.raises(tables.MissingInputs, match="trims.csv, series_month_sales.csv"):
        (tmp_path / "series.csv").write_text("series_id\n")
        tables.require_inputs(spark, str(tmp_path), ["series.csv", "trims.csv", "series_month_sales.csv"])
    flat = tmp_path / "flat.csv"
    columns = [part.split()[0] for part in schemas.FLAT_SNAPSHOT.split(", ")]
    row = dict.fromkeys(columns, "")
    row.update(source_key="k", series_id="1", model_name="m", brand="b", price_min_wan="10", level_name="紧凑型SUV", energy_type="纯电",
               seats="5", range_km="520", sales="9", captured_at="2026-07-10")
    twin = {**row, "model_year": "2025"}
    bad = [{**row, "source_key": f"bad{i}", **change} for i, change in enumerate(
        [{"brand": "--"}, {"price_min_wan": "0"}, {"energy_type": "氢"}, {"model_name": ""}])]
    write_csv_file(flat, columns, [list(r.values()) for r in (row, twin, *bad)])
    raw = tables.source_switch(spark, str(flat), None)
    cleaned = catalog.clean_catalog(raw).collect()
    assert len(cleaned) == 1
    car = cleaned[0]
    assert list(car.asDict()) == list(vocab.CATALOG_COLUMNS)
    assert car.body_type == "SUV" and car.price_max_wan == 10 and car.normalized_heat == 1.0
    assert car.scenario_tags == ["城市通勤", "家庭出行", "长途出行"]
    assert car.car_id == "car_" + hashlib.sha256(b"k").hexdigest()[:12]


def test_fingerprints(spark, tmp_path):
    (tmp_path / "b.csv").write_text("2")
    (tmp_path / "a.csv.gz").write_bytes(b"1")
    (tmp_path / "c.txt").write_text("3")
    digest = hashlib.sha256()
    for name in ("a.csv.gz", "b.csv"):
        digest.update(name.encode())
        digest.update(hashlib.sha256((tmp_path / name).read_bytes()).hexdigest().encode())
    assert tables.dataset_fingerprint(spark, str(tmp_path)).first().fingerprint == digest.hexdigest()
    assert tables.dataset_fingerprint(spark, str(tmp_path / "b.csv")).first().fingerprint == hashlib.sha256(b"2").hexdigest()
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    assert tables.table_fingerprint(frame).first() == tables.table_fingerprint(frame.orderBy(F.desc("i"))).first()


def test_catalog_job_end_to_end(spark, table_folder, tmp_path):
    out = str(tmp_path / "out")
    result = catalog_job.run(spark, table_folder, out)
    cleaned = result["catalog"]
    direct = catalog.clean_catalog(views.assembled(spark, SMOKE))
    assert cleaned.count() == direct.count() > 100
    assert cleaned.select("car_id").distinct().count() == cleaned.count()
    assert cleaned.select("car_id", "price_mid_wan", "horsepower").exceptAll(direct.select("car_id", "price_mid_wan", "horsepower")).isEmpty()
    metadata = result["metadata"].first()
    assert metadata.input_rows - metadata.removed_rows == metadata.output_rows == cleaned.count()
    loaded = tables.typed_catalog_load(spark, f"{out}/cars.csv")
    assert loaded.select("car_id", "price_min_wan", "seats", "scenario_tags").exceptAll(
        cleaned.select("car_id", "price_min_wan", "seats", "scenario_tags")
    ).isEmpty()
    raw = views.raw_requests(spark, SMOKE)
    recommend_job.run(loaded, raw, f"{out}/answers")
    answered = spark.read.parquet(f"{out}/answers/envelopes").count() if os.path.isdir(f"{out}/answers/envelopes") else spark.read.parquet(
        f"{out}/answers/envelopes.parquet").count()
    assert answered + spark.read.parquet(f"{out}/answers/rejected.parquet").count() == raw.count()


def test_analysis_job_and_overview_end_to_end(spark, table_folder, tmp_path):
    out = str(tmp_path / "analysis")
    settings = analysis_job.Settings(
        minimum_coverage=0.2, max_features=6, folds=2, fold_method="md5",
        forest=lambda: models.forest_model(numTrees=5, maxDepth=3), impute_in_fold=True,
    )
    result = analysis_job.run(spark, table_folder, out, settings)
    quality = result["parameter_quality"]
    consolidated = result["consolidated_parameter_results"]
    assert consolidated.count() == quality.count() + len(vocab.CONTROL_LABELS)
    assert quality.filter("selected_for_model").count() == result["summary"].first().model_features <= 6
    p_and_q = result["univariate_associations"].filter("p_value IS NOT NULL").orderBy("p_value").collect()
    assert all(r.fdr_q_value >= r.p_value - 1e-12 for r in p_and_q)
    assert [r.fdr_q_value for r in p_and_q] == sorted(r.fdr_q_value for r in p_and_q)

    read = overview_job.load(spark, out, 500)
    assert read["available"].first().available is True
    assert read["top_parameters"].count() == consolidated.count()
    cards = read["cards"].orderBy("card_no").collect()
    assert [c.key for c in cards] == list(vocab.METRIC_LABELS) and all(c.rmse is not None for c in cards)
    indicators = read["indicators"].first()
    assert indicators.parameter_definitions == quality.count() and indicators.sales_period
    assert [r.warning for r in read["warnings"].collect()] == [vocab.INTERPRETATION, vocab.TREND_REASON]


def write_artifacts(folder):
    (folder / "model_metrics.json").write_text(json.dumps({
        "sales_period": "2031-11", "analysis_rows": 3071, "parameter_definitions": 0, "trend_status": "insufficient_history",
        "model_metrics": {"full_elastic_net": {"mean": {"r2": 0.375, "rmse": 0.62, "mae": 0.41}}},
    }))
    write_csv_file(folder / "univariate_associations.csv", ["feature_name", "spearman_rho", "fdr_q_value"],
                   [["f_wheel", "-0.72", "0.004"], ["f_glass", "nan", "0.85"]])
    names = ["feature_name", "group_name", "parameter_name", "parameter_type", "elastic_net_coefficient", "random_forest_importance"]
    write_csv_file(folder / "parameter_importance.csv", names, [["f_glass", "底盘", "轮距", "numeric", "", "0.07"], ["f_wheel", "底盘", "轮径", "numeric", "-1.3", "0.55"]])
    write_csv_file(folder / "parameter_quality.csv", ["feature_name", "selected_for_adapter", "selected_for_model"],
                   [["f_wheel", "True", "True"], ["f_glass", "true", "False"], ["", "False", "False"]])
    more = ["spearman_rho", "fdr_q_value", "evidence_strength", "association_direction", "trend_status"]
    write_csv_file(folder / "consolidated_parameter_results.csv", names + more, [
        ["f_glass", "底盘", "轮距", "numeric", "", "0.07", "", "", "weak", "neutral", ""],
        ["", "车窗", "天幕", "categorical", "", "", "", "", "not_evaluated", "not_evaluated", "x"],
        ["f_wheel", "底盘", "轮径", "numeric", "-1.3", "0.55", "", "", "strong", "negative", "insufficient_history"],
    ])


def test_overview_merges_sorts_and_degrades(spark, tmp_path):
    write_artifacts(tmp_path)
    full = overview_job.load(spark, str(tmp_path), 10)
    rows = full["top_parameters"].collect()
    assert [r.feature_name for r in rows] == ["f_wheel", "f_glass", "raw:车窗|天幕"]
    assert rows[0].spearman_rho == -0.72 and rows[1].spearman_rho is None and rows[1].trend_status == "insufficient_history"
    assert rows[2].evidence_strength == "not_evaluated"
    assert overview_job.load(spark, str(tmp_path), "1")["top_parameters"].count() == 1
    kpi = full["indicators"].first()
    assert (kpi.analysis_rows, kpi.parameter_definitions, kpi.adapter_features, kpi.model_features, kpi.significant_features) == (3071, 3, 2, 1, 1)
    assert [c.r2 for c in full["cards"].orderBy("card_no").collect()] == [None, 0.375, None]

    missing = overview_job.load(spark, str(tmp_path / "none"))
    assert missing["available"].first().available is False and missing["warnings"].count() == 4
    assert missing["top_parameters"].count() == 0
    (tmp_path / "model_metrics.json").write_text("[1]")
    (tmp_path / "parameter_quality.csv").write_text("feature_name\nx\n")
    broken = overview_job.load(spark, str(tmp_path))
    assert broken["available"].first().available is False
    texts = [r.warning for r in broken["warnings"].collect()]
    assert len(texts) == 2 and all(t.startswith(vocab.WARNING_UNREADABLE) for t in texts)


@pytest.mark.parametrize("value", ["0", "501", "abc", "1.5", None])
def test_overview_limit_is_checked(value):
    with pytest.raises(overview.OverviewLimitError) as caught:
        overview.overview_limit(value)
    assert (caught.value.code, caught.value.field) == ("INVALID_LIMIT", "limit")


def test_facets_and_distribution_label_missing_values(spark, items):
    mixed = items.withColumn("body_type", F.when(F.col("car_id") == "car_0", "").otherwise(F.col("body_type")))
    rows = {(r.facet, r.field, r.name): r.n for r in summary.facets(mixed, ["body_type"], ["brand", "body_type"], vocab.OTHER_LABEL).collect()}
    assert rows == {
        ("count", "body_type", "其他"): 1, ("count", "body_type", "轿车"): 5, ("value", "body_type", "轿车"): None,
        ("value", "brand", "云桥"): None, ("value", "brand", "海川"): None, ("total", "", ""): 6,
    }
    assert [(r.brand, r.n_rows) for r in summary.distribution(items, "brand").collect()] == [("云桥", 4), ("海川", 2)]


def test_hot_key_dedupe_is_deterministic(spark):
    hot = spark.range(3000).select((F.col("id") % 3 * 0 + F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), (F.col("id") * 7919 % 3001).alias("v"))
    got = summary.dedupe_by_key(hot, ["k"], ["v"])
    assert got.count() == hot.select("k").distinct().count()
    assert got.filter("k = 0").first().v == hot.filter("k = 0").agg(F.min("v")).first()[0]


def test_entry_and_registry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    queries, oracle = contract.queries(), contract.oracle_sql()
    assert set(oracle) <= set(queries) and len(oracle) >= 90


def test_fingerprints_follow_the_data_of_every_format(spark, tmp_path):
    rows = spark.range(500).selectExpr("id", "concat('v', id) AS v")
    for kind in ("parquet", "csv"):
        found = set()
        for name, frame in (("a", rows), ("b", rows.union(rows.limit(1))), ("c", rows.withColumn("id", F.col("id") + 1))):
            folder = str(tmp_path / kind / name)
            getattr(frame.coalesce(1).write, kind)(f"{folder}/inner")
            # The same table below another folder, hashed whole and by rows.
            found.add(tables.dataset_fingerprint(spark, folder).first()[0])
            by_rows = [tables.file_digests(spark, folder, whole_file_bytes=limit).select("digest").first()[0] for limit in (0, 10)]
            assert by_rows[0] == by_rows[1]
            found.add(by_rows[0])
        assert len(found) == 6
    names = [r.name for r in tables.file_digests(spark, str(tmp_path / "csv" / "a")).collect()]
    assert len(names) == 1 and names[0].startswith("inner/part-")


def test_single_file_is_not_computed_by_its_writer(spark):
    from workload import source_checks

    sums = spark.range(1000).selectExpr("id % 7 AS k", "id AS v").groupBy("k").sum("v")
    one = source_checks.in_one_part(sums)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" in plan and "Coalesce" not in plan
    assert one.rdd.getNumPartitions() == 1 and sorted(tuple(r) for r in one.collect()) == sorted(tuple(r) for r in sums.collect())


def test_streamed_files_have_the_digests_of_whole_ones(spark, tmp_path):
    """Not held by a task, whatever their bytes, ends, names and sub-folders."""
    noise = bytes(random.Random(3).randrange(256) for _ in range(50_000))
    (tmp_path / "in ner").mkdir()
    contents = {
        "a.parquet": noise, "in ner/a%20+b [1].parquet": noise + b"\n", "c.csv": b"\xef\xbb\xbfk,v\r\n1,2", "d.csv": b"\xef\xbb\xbfk,v\n1,2\n", "e.csv.gz": noise[:9_999],
        "f.json": b"\n\n", "g.csv": b"\n", "i.json": b"\xef\xbb\xbf", "in ner/j.csv": noise * 5, "k": noise,
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    expected = {name: hashlib.sha256(content).hexdigest() for name, content in contents.items()}
    for held in (0, 5, 1 << 24):
        found = tables.file_digests(spark, str(tmp_path), "*", held_file_bytes=held)
        assert {r.name: r.digest for r in found.collect()} == expected
        assert ("MapInArrow" in found._jdf.queryExecution().executedPlan().toString()) == (held < 10)
    assert tables.HELD_FILE_BYTES < tables.WHOLE_FILE_BYTES


def test_assembly_works_on_slices_of_the_series(spark, table_folder, monkeypatch):
    """In turns or at once the same rows; the rows of a series are dealt once, and what was dealt out is deleted."""
    frames = [*tables.read_tables(spark, table_folder).values()]
    # A trim that comes twice, one without a series and one of unknown class.
    frames[1] = frames[1].union(frames[1].limit(1)).union(frames[1].limit(1).withColumn("series_id", F.lit(None).cast("string")))
    at_once = sorted(map(str, catalog.assemble(*frames).collect()))
    turns, plans = [], []

    def in_turns(parts, key, work):
        def watched(*some):
            turns.append(1)
            done = work(*some)
            with staging._tidy(spark, **{staging.DEALT_ANEW: "false"}):
                plans.append(done.select("*")._jdf.queryExecution().executedPlan().toString())
            return done

        return staging.in_slices(parts, key, watched, together=1)

    monkeypatch.setattr(catalog, "in_slices", in_turns)
    assert sorted(map(str, catalog.assemble(*frames).collect())) == at_once and at_once
    assert len(turns) > 1
    assert all("ENSURE_REQUIREMENTS" not in line for plan in plans for line in plan.splitlines() if "Exchange hashpartitioning" in line and "trim_id" in line)
    left = [f for f in os.listdir(staging.ensure_checkpoint_dir(spark).removeprefix("file:")) if f.startswith("slices-")]
    folders = [os.path.join(staging.ensure_checkpoint_dir(spark).removeprefix("file:"), f) for f in left]
    assert folders and all([n for n in os.listdir(f) if not n.startswith(".")] == ["done"] for f in folders)


def test_slices_keep_all_rows_and_null_keys(spark):
    rows = spark.range(300).selectExpr("if(id % 10 = 0, null, cast(id % 37 as string)) AS k", "id AS v")
    for together in (1, 100, 10_000):
        found = staging.in_slices([rows], "k", lambda frame: frame.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")), together)
        assert sorted(map(str, found.collect())) == sorted(map(str, rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()))
    empty = staging.in_slices([rows.limit(0)], "k", lambda frame: frame.groupBy("k").agg(F.count("*").alias("n")))
    assert empty.count() == 0 and empty.columns == ["k", "n"]
