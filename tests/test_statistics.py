import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from wheelbase.functions import statistics
from wheelbase.operators import association, evidence, features, models, ordering, quality, summary
from wheelbase.staging import written


def test_erfc_matches_the_standard_library(spark):
    xs = [i / 37 for i in range(0, 400)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", statistics.erfc_nonnegative(F.col("x")).alias("e"))
    for row in rows.collect():
        assert row.e == pytest.approx(math.erfc(row.x), rel=1e-13)


def brute_ranks(values):
    ordered = sorted(values)
    return {v: (ordered.index(v) + 1 + ordered.index(v) + ordered.count(v)) / 2 for v in values}


@pytest.mark.parametrize("ranges", [None, 1, 8, 100])
def test_average_ranks_with_hot_group_and_hot_value(spark, ranges):
    rng = random.Random(11)
    data = []
    for i in range(900):
        group = "hot" if rng.random() < 0.4 else f"g{rng.randint(0, 5)}"
        value = 0.0 if rng.random() < 0.34 else round(rng.uniform(-50, 50), 1)
        data.append((group, value))
    frame = spark.createDataFrame(data, "g string, v double")
    got = ordering.average_ranks(frame, ["g"], "v", ranges=ranges).collect()
    for group in {g for g, _ in data}:
        want = brute_ranks([v for g, v in data if g == group])
        assert {r.v: r["rank"] for r in got if r.g == group} == want
        size = sum(1 for g, _ in data if g == group)
        assert sum(r["rank"] * r.n_ties for r in got if r.g == group) == size * (size + 1) / 2


def test_sums_and_numbers_over_null_groups_and_empty_frames(spark):
    rows = [(g, i) for i in range(60) for g in (None, "a", "hot") if g == "hot" or i % 7 == 0]
    frame = spark.createDataFrame(rows, "g string, i int")
    got = ordering.with_sums_before(frame, ["g"], ["i"], {"total": F.col("i"), "n": F.lit(1)}, ranges=5).collect()
    assert len(got) == len(rows)
    for r in got:
        smaller = [i for g, i in rows if g == r.g and i < r.i]
        assert (r.total, r.n) == (sum(smaller), len(smaller))
    numbers = ordering.numbered(frame, ["i", "g"], "no", ranges=7).collect()
    assert [r.no for r in sorted(numbers, key=lambda r: (r.i, r.g or ""))] == list(range(len(rows)))
    assert ordering.numbered(frame.limit(0), ["i", "g"], "no").collect() == []
    parts = ordering.in_ranges(frame.filter("g = 'hot'"), ["g", "i"], 6).groupBy("_part").count().collect()
    assert len(parts) == 6 and max(r["count"] for r in parts) < 30


def test_spearman_cases(spark):
    rows = [("p", x, 2.0 * x) for x in range(1, 6)] + [("flat", 1.0, float(x)) for x in range(5)] + [("few", 1.0, 2.0), ("few", 2.0, 1.0)]
    frame = spark.createDataFrame([(g, float(x), y) for g, x, y in rows], "f string, x double, y double")
    got = {r.f: r for r in statistics.with_spearman_p(association.spearman(frame, ["f"], "x", "y"), "rho", "n").collect()}
    assert got["p"].rho == pytest.approx(1.0) and got["p"].p_value < 0.001
    assert got["flat"].rho is None and got["flat"].p_value is None and got["few"].rho is None


def brute_bh(ps):
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    out, running = [None] * len(ps), 1.0
    for rank in range(len(known), 0, -1):
        p, i = known[rank - 1]
        running = min(running, p * len(known) / rank)
        out[i] = running
    return out


@pytest.mark.parametrize("ranges", [None, 1, 9])
def test_fdr_matches_brute_force(spark, ranges):
    rng = random.Random(3)
    for ps in ([0.01, 0.04, 0.03, None], [rng.choice([0.2, 0.01, round(rng.random(), 3), None]) for _ in range(200)], [None, None]):
        frame = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
        got = {r.i: r.fdr_q_value for r in association.fdr_bh(frame, "p", ranges=ranges).collect()}
        for i, want in enumerate(brute_bh(ps)):
            assert got[i] == (None if want is None else pytest.approx(want))


def test_mode_latest_and_target(spark):
    labels = spark.createDataFrame(
        [("1", "b"), ("1", "a"), ("1", " "), ("1", None), ("2", "-"), ("2", "-"), ("2", "x")], "series_id string, v string"
    )
    assert {r.series_id: r.m for r in summary.mode_by_key(labels, ["series_id"], "v", "m").collect()} == {"1": "a", "2": "-"}
    assert {r.series_id: r.m for r in summary.mode_by_key(labels, ["series_id"], "v", "m", ("", "-")).collect()}["2"] == "x"
    sales = spark.createDataFrame(
        [("1", "2026-05", 100), ("1", "2026-06", 120), ("2", "2026-05", 80), ("2", "2026-06", 0), ("3", "2026-07", None)],
        "series_id string, sales_period string, sales int",
    )
    target = {r.series_id: r for r in features.build_target(sales).collect()}
    assert target["1"].target_sales == 120 and target["2"].target_sales == 0 and "3" not in target
    assert target["1"].target_log_sales == pytest.approx(math.log1p(120))


def test_parameter_types(spark):
    counters = ["rows", *quality.COUNTERS]
    cases = {
        "numeric": (100, 0, 90, 0, 0, 0, 0), "equipment": (100, 0, 0, 40, 0, 0, 60), "categorical": (100, 0, 0, 0, 0, 0, 0),
        "numeric2": (100, 60, 20, 0, 0, 0, 0), "few": (30, 0, 19, 0, 0, 0, 0),
    }
    frame = spark.createDataFrame([(k, *v) for k, v in cases.items()], ["name", *counters])
    got = {r.name: r.kind for r in frame.select("name", quality.parameter_type().alias("kind")).collect()}
    assert got == {"numeric": "numeric", "equipment": "equipment", "categorical": "categorical", "numeric2": "numeric", "few": "categorical"}


def test_evidence_labels(spark):
    cases = [(0.25, 0.005, 0.12), (-0.18, 0.03, -0.04), (0.21, 0.001, -0.02), (None, None, None), (0.01, 0.5, None), (float("nan"), 0.1, 0.2)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, r double, q double, c double")
    strength, direction = evidence.evidence_label(F.col("r"), F.col("q"), F.col("c"))
    got = [(r.s, r.d) for r in frame.select("i", strength.alias("s"), direction.alias("d")).orderBy("i").collect()]
    assert got == [
        ("strong", "positive"), ("moderate", "negative"), ("weak", "mixed"), ("not_evaluated", "not_evaluated"),
        ("weak", "neutral"), ("not_evaluated", "not_evaluated"),
    ]


def planted(spark, n=240):
    """Analysis set whose target follows one feature; the controls carry nothing."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        x = rng.uniform(0, 10)
        rows.append((str(i), f"b{i % 12}", "l", "e", "s", 10.0, 2026, 3, x, rng.uniform(0, 1), 0.5 * x + rng.gauss(0, 0.3)))
    return spark.createDataFrame(
        rows,
        "series_id string, brand string, level_name string, energy_type string, body_structure string, price_median_wan double, "
        "model_year_max int, trim_count int, num_signal double, num_noise double, target_log_sales double",
    )


def test_models_find_the_planted_signal(spark):
    data, names = planted(spark), ["num_signal", "num_noise"]
    folded = models.grouped_folds(data, "brand", 3, "md5")
    assert folded.groupBy("brand").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    forest = lambda: models.forest_model(numTrees=10, maxDepth=4)
    metrics = models.cross_validate(folded, models.default_specs(names, forest), 3)
    means = {r.model: r for r in models.fold_mean(metrics).collect()}
    assert means["full_elastic_net"].r2 > 0.8 > means["baseline_elastic_net"].r2
    assert means["full_random_forest"].r2 > 0.8
    gain = models.incremental_r2(metrics).first()
    assert gain.elastic_net > 0.5 and gain.random_forest > 0.5
    assert models.forest_diagnostics(metrics).count() >= 2
    weights = {r.feature_name: r for r in models.feature_importance(data, names, forest).collect()}
    assert weights["num_signal"].elastic_net_coefficient > 0
    assert max(weights.values(), key=lambda w: w.random_forest_importance).feature_name == "num_signal"
    assert set(weights) == {*names, "brand", "level_name", "energy_type", "body_structure", "price_median_wan", "model_year_max", "trim_count"}
    again = models.cross_validate(folded, models.default_specs(names, forest)[1:2], 3)
    assert {(r.fold, r.metric): r.value for r in again.collect()} == {
        (r.fold, r.metric): r.value for r in metrics.filter("model = 'full_elastic_net'").collect()
    }


def correlated(spark, n=400):
    """Many features on few hidden ones, categories of very different size, one constant column, large offsets."""
    rng = random.Random(21)
    rows = []
    for i in range(n):
        hidden = [rng.gauss(0, 1) for _ in range(4)]
        brand = "b0" if rng.random() < 0.34 else f"b{rng.randint(1, 20)}"
        x = [hidden[j % 4] * (1 + j) + rng.gauss(0, 0.5) + 1000 * (j % 3) for j in range(12)]
        y = hidden[0] - 0.5 * hidden[1] + (0.7 if brand == "b0" else 0) + rng.gauss(0, 0.2)
        rows.append((str(i), brand, rng.choice("xyz"), "e", rng.choice("pq"), 15 + hidden[2], 2000 + rng.randint(0, 25), rng.randint(1, 9), *x, 3.5, y))
    names = [f"num_{j}" for j in range(12)] + ["num_flat"]
    schema = "series_id string, brand string, level_name string, energy_type string, body_structure string, price_median_wan double, model_year_max int, trim_count int, "
    return spark.createDataFrame(rows, schema + ", ".join(f"{c} double" for c in names) + ", target_log_sales double"), names


def test_elastic_net_from_sums_equals_the_iterative_fit(spark, monkeypatch):
    data, names = correlated(spark)
    folded = models.grouped_folds(data.repartition(3), "brand", 4, "md5")
    specs = models.default_specs(names)[:2]
    from_sums = {(r.model, r.fold, r.metric): r.value for r in models.cross_validate(folded, specs, 4, digits=12).collect()}
    monkeypatch.setattr(models.linear, "MAX_COLUMNS", 5)
    monkeypatch.setitem(models.ELASTIC_NET, "tol", 1e-12)
    one_by_one = {(r.model, r.fold, r.metric): r.value for r in models.cross_validate(folded, specs, 4, digits=12).collect()}
    assert from_sums.keys() == one_by_one.keys() and len(from_sums) == 2 * 4 * 6
    for key, value in one_by_one.items():
        assert from_sums[key] == pytest.approx(value, abs=1e-6), key


def test_levels_are_numbered_like_an_indexer(spark):
    from pyspark.ml.feature import StringIndexer

    data, _ = correlated(spark)
    levels = models.linear.category_levels(data, ["brand", "level_name"]).orderBy("position").collect()
    indexer = StringIndexer(inputCols=["brand", "level_name"], outputCols=["a", "b"]).fit(data)
    assert [(r.category, r.value) for r in levels] == [(c, v) for c, labels in zip(("brand", "level_name"), indexer.labelsArray) for v in labels]
    assert [r.position for r in levels] == list(range(len(levels)))


def test_metrics_of_fixed_predictions(spark):
    frame = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("a", 5.0, 4.0)], "k string, y double, p double")
    row = models.regression_metrics(frame, ["k"], "y", "p").first()
    assert row.rmse == pytest.approx(math.sqrt(2 / 3)) and row.mae == pytest.approx(2 / 3) and row.r2 == pytest.approx(0.75)


def test_pearson_of_constant_and_offset_columns(spark):
    rows = [("flat", 0.1, float(i)) for i in range(1000)] + [("offset", 1e9 + i / 1000, float(i)) for i in range(1000)] + [("few", 1.0, 2.0), ("few", 2.0, 1.0)]
    got = {r.g: (r.n, r.rho) for r in association.pearson(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert got["flat"] == (1000, None) and got["few"] == (2, None)
    assert abs(got["offset"][1] - 1) < 1e-6


def test_running_minimum_reads_every_row_once(spark):
    """A frame that ends at the last row is read again for every row, so a range of n rows would take n * n / 2 steps."""
    data = [(i % 3, float(i), float((i * 37) % 101)) for i in range(300)]
    frame = spark.createDataFrame(data, "g int, v double, m double")
    got = ordering.with_minimum_from(frame, ["g"], "v", F.col("m"), "least", ranges=4)
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    for row in got.collect():
        assert row.least == min(m for g, v, m in data if g == row.g and v >= row.v)


def test_group_medians_are_exact_and_build_no_sketches(spark):
    rng = random.Random(5)
    values = [*range(25_000), *[None] * 70]
    rng.shuffle(values)
    data = [("hot", None if v is None else float(v), 1.0) for v in values] + [("one", 3.0, None), ("none", None, 0.5), ("none", None, None), (None, 2.0, 0.0), (None, 1.0, 1.0)]
    frame = spark.createDataFrame(data, "k string, v double, c double")
    got = {r.k: (r.m, r.mean) for r in summary.group_medians(frame, ["k"], "v", "m", {"mean": "c"}).collect()}
    assert got == {"hot": (12_499.0, 1.0), "one": (3.0, None), "none": (None, 0.5), None: (1.0, 0.5)}
    attributes = spark.createDataFrame(
        [("s", "p", "1", 1.0, None), ("s", "p", "9", 9.0, None), ("s", "q", "-", None, None), ("s", "r", "red", None, None)],
        "series_id string, parameter_key string, value_text string, value_numeric double, equipment_state string")
    found = features.series_parameter_values(attributes)
    assert {tuple(r) for r in found.collect()} == {("s", "p", 1.0, None), ("s", "q", None, 0.0)}
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_modes_parse_their_texts_once_and_pass_over_blanks(spark):
    rows = [("a", " x "), ("a", ""), ("a", "  "), ("a", None), ("a", None), ("b", ""), ("b", None), ("c", "y"), ("c", "z"), ("c", "z")]
    texts = spark.createDataFrame(rows, "k string, raw string").select("k", F.regexp_replace("raw", "x", "X").alias("v"))
    modes = summary.mode_by_key(texts, ["k"], "v", "mode")
    assert {r.k: r["mode"] for r in modes.collect()} == {"a": " X ", "c": "z"}
    assert modes._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def test_rows_of_a_forest_are_spread_over_the_cores(spark):
    large = spark.range(models.ROWS_PER_TASK * 3).coalesce(1)
    assert models.spread(large).rdd.getNumPartitions() == 3 and models.spread(large).distinct().count() == large.count()
    assert models.spread(spark.range(50).coalesce(1)).rdd.getNumPartitions() == 1


def test_features_shuffle_only_their_own_rows_as_numbers(spark):
    """What is no feature never reaches the shuffle, a parameter goes through it as a number, and a key with two definitions has rows for both."""
    rows = [
        ("s", "n", "1", 1.0, "value"), ("s", "n", "4", 4.0, "value"), ("s", "n", "9", 9.0, "value"), ("s", "n", "-", None, "missing"), ("t", "n", "●", None, "standard"),
        ("s", "e", "●", None, "standard"), ("s", "e", "○", None, "optional"), ("s", "e", "7", 7.0, "value"), (None, "e", "--", None, "missing"), ("s", "other", "5", 5.0, "value"),
    ]
    attributes = spark.createDataFrame(rows, "series_id string, parameter_key string, value_text string, value_numeric double, equipment_state string")
    mapping = spark.createDataFrame(
        [("n", "numeric", "num_n"), ("e", "equipment", "equip_e"), ("e", "numeric", "num_e"), ("none", "numeric", "num_none")],
        "parameter_key string, parameter_type string, feature_name string")
    found = features.build_features(attributes, mapping)
    assert {tuple(r) for r in found.collect()} == {("s", "n", "num_n", 4.0), ("s", "e", "equip_e", 0.75), (None, "e", "equip_e", 0.0), ("s", "e", "num_e", 7.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert moved and all("parameter_key" not in line and "_no#" in line for line in moved)


def test_group_medians_sort_in_stated_parts(spark):
    """Spark would merge small parts until all rows are sorted at the same time."""
    frame = spark.createDataFrame([(i % 7, float(i)) for i in range(50)], "k int, v double")
    plan = summary.group_medians(frame, ["k"], "v", "m")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_forests_of_several_folds_are_fitted_at_the_same_time(spark):
    met = threading.Barrier(2, timeout=60)

    def forest():
        met.wait()
        return models.forest_model(numTrees=3, maxDepth=2)

    folded = models.grouped_folds(planted(spark, 60), "brand", 2, "md5")
    specs = models.default_specs(["num_signal"], forest)[2:]
    metrics = models.cross_validate(folded, specs, 2)
    assert [r.fold for r in metrics.collect()] == [0] * 6 + [1] * 6


def test_pairs_to_correlate_are_stored_packed(spark):
    """Pairs are Parquet, not a copy of the rows as they lie in memory."""
    frame = spark.createDataFrame([("a", float(i % 5), float(i)) for i in range(40)], "g string, x double, y double")
    assert association.spearman.__defaults__[-1] is written
    assert association.spearman(frame, ["g"], "x", "y").first().n == 40


def test_forests_keep_node_numbers_and_predict_from_unpacked_vectors(spark):
    """The node of a row is kept between levels; predictions are those of the fitted pipeline itself."""
    data, names = planted(spark), ["num_signal", "num_noise"]
    spec = models.default_specs(names, lambda: models.forest_model(numTrees=3, maxDepth=3))[2]
    stages = models.stages_for(spec)
    assert stages.getStages()[-1].getCacheNodeIds()
    fitted = stages.fit(data)
    assert {r.series_id: r.prediction for r in models.predicted(fitted, data).collect()} == {
        r.series_id: r.prediction for r in fitted.transform(data).collect()
    }
    vectors = models.predicted(fitted, data).select("assembled").collect()
    assert all(type(r.assembled).__name__ == "DenseVector" for r in vectors)
    again = models.cross_validate(models.grouped_folds(data, "brand", 2, "md5"), [spec], 2)
    assert again.count() == 12
