"""Attribute quality, features, controls, statistics, models, evidence and overview."""

from __future__ import annotations

from pyspark.sql import functions as F

from wheelbase import vocab
from wheelbase.functions import statistics
from wheelbase.operators import association, evidence, features, models, ordering, overview, quality
from wheelbase.plans import analysis_job
from wheelbase.staging import checkpointed, written
from workload import views
from workload.ctes import erfc, with_ctes
from workload.registry import check

# ------------------------------------------------------------------ quality


@check("quality_counters", with_ctes(("quality",), "SELECT * FROM quality"))
def quality_counters(spark, sf):
    return quality.parameter_quality(views.attributes(spark, sf), exact_distinct=True)


@check("parameter_types", with_ctes(("classified",), "SELECT parameter_key, parameter_type, recognized_rate FROM classified"))
def parameter_types(spark, sf):
    return views.classified(spark, sf).select("parameter_key", "parameter_type", "recognized_rate")


@check("exclusion_reasons", with_ctes(("classified",), "SELECT parameter_key, excluded_reason, selected_for_adapter FROM classified"))
def exclusion_reasons(spark, sf):
    return views.classified(spark, sf).select("parameter_key", "excluded_reason", "selected_for_adapter")


@check("feature_names", with_ctes(("classified",), "SELECT parameter_key, feature_name FROM classified"))
def feature_names(spark, sf):
    return views.classified(spark, sf).select("parameter_key", "feature_name")


@check("feature_mapping", with_ctes(("classified",), """
SELECT parameter_key, parameter_type, feature_name FROM classified WHERE selected_for_adapter"""))
def feature_mapping(spark, sf):
    return quality.feature_mapping(views.classified(spark, sf))


# ------------------------------------------------------------------ features


@check("equipment_codes", with_ctes(("coded",), """
SELECT parameter_key, equipment_state, equipment_value, count(*) AS n_rows FROM coded GROUP BY ALL"""))
def equipment_codes(spark, sf):
    rows = views.attributes(spark, sf)
    return rows.groupBy("parameter_key", "equipment_state", features.equipment_code().alias("equipment_value")).agg(
        F.count("*").alias("n_rows")
    )


@check("numeric_medians", with_ctes(("attributes",), """
SELECT series_id, parameter_key, quantile_disc(value_numeric, 0.5) AS numeric_value FROM attributes WHERE value_numeric IS NOT NULL GROUP BY ALL"""))
def numeric_medians(spark, sf):
    values = features.series_parameter_values(views.attributes(spark, sf))
    return values.filter(F.col("numeric_value").isNotNull()).select("series_id", "parameter_key", "numeric_value")


@check("equipment_means", with_ctes(("coded",), """
SELECT series_id, parameter_key, round(avg(equipment_value), 6) AS equipment_value FROM coded WHERE equipment_value IS NOT NULL GROUP BY ALL"""))
def equipment_means(spark, sf):
    values = features.series_parameter_values(views.attributes(spark, sf))
    known = values.filter(F.col("equipment_value").isNotNull())
    return known.select("series_id", "parameter_key", F.round("equipment_value", 6).alias("equipment_value"))


@check("features_union", with_ctes(("features",), """
SELECT series_id, parameter_key, feature_name, round(feature_value, 6) AS feature_value FROM features"""))
def features_union(spark, sf):
    return views.long_features(spark, sf).withColumn("feature_value", F.round("feature_value", 6))


@check("mode_by_key", with_ctes(("modes",), """
SELECT series_id, value AS energy_type FROM modes WHERE kind = 'energy'"""))
def mode_by_key(spark, sf):
    from wheelbase.operators.summary import mode_by_key as mode

    return mode(views.trims(spark, sf), ["series_id"], "energy_type_raw", "energy_type")


@check("controls_star", with_ctes(("controls",), "SELECT * FROM controls"))
def controls_star(spark, sf):
    return views.controls(spark, sf)


@check("log_target", with_ctes(("target",), "SELECT series_id, target_sales, round(target_log_sales, 6) AS target_log_sales FROM target"))
def log_target(spark, sf):
    return views.target(spark, sf).withColumn("target_log_sales", F.round("target_log_sales", 6))


@check("coverage_select", with_ctes(("selected",), """
SELECT feature_name, present, round(coverage, 6) AS coverage, round(stddev, 6) AS stddev FROM selected"""))
def coverage_select(spark, sf):
    chosen = features.select_top_features(features.feature_coverage(views.long_features(spark, sf), views.target(spark, sf)))
    return chosen.select("feature_name", "present", F.round("coverage", 6).alias("coverage"), F.round("stddev", 6).alias("stddev"))


@check("write_back_selection", with_ctes(("classified", "selected"), """
SELECT c.parameter_key, c.feature_name, s.feature_name IS NOT NULL AS selected_for_model, round(s.coverage, 6) AS model_coverage,
  round(s.stddev, 6) AS model_stddev FROM classified c LEFT JOIN selected s USING (feature_name)"""))
def write_back_selection(spark, sf):
    classified = checkpointed(views.classified(spark, sf))
    long = features.build_features(views.attributes(spark, sf), quality.feature_mapping(classified))
    chosen = features.select_top_features(features.feature_coverage(long, views.target(spark, sf)))
    return features.write_back_selection(classified, chosen).select(
        "parameter_key", "feature_name", "selected_for_model", "model_coverage", "model_stddev"
    )


# The wide set of the check: two numeric and two equipment attributes by their parameter keys.
WIDE_KEYS = ("1|发动机|最大马力(Ps)", "1|发动机|工信部综合油耗(L)", "1|装备1|配置F", "2|装备2|配置O")
WIDE_KINDS = ("num", "num", "equip", "equip")


def _wide_names(spark) -> list[str]:
    import hashlib

    return [f"{kind}_{hashlib.sha1(key.encode()).hexdigest()[:12]}" for kind, key in zip(WIDE_KINDS, WIDE_KEYS)]


def _wide_sql(fill: bool) -> str:
    names = _wide_names(None)
    cells = ", ".join(f"any_value(feature_value) FILTER (feature_name = '{n}') AS w{i}" for i, n in enumerate(names))
    numbers = [f"w{i}" for i in range(len(names))] + ["price_median_wan"]
    shown = ", ".join(
        f"round(coalesce({c}, (SELECT quantile_disc({c}, 0.5) FROM joined)), 6) AS {c}" if fill else f"round({c}, 6) AS {c}"
        for c in numbers
    )
    return with_ctes(("features", "target", "controls"), f""", wide AS (SELECT series_id, {cells} FROM features GROUP BY 1),
joined AS (SELECT * FROM target JOIN controls USING (series_id) LEFT JOIN wide USING (series_id))
SELECT series_id, target_sales, coalesce(brand, '未知') AS brand, coalesce(level_name, '未知') AS level_name, {shown} FROM joined""")


def _wide(spark, sf, impute: bool):
    names = _wide_names(spark)
    data = features.build_analysis_dataset(
        views.long_features(spark, sf), views.controls(spark, sf), views.target(spark, sf), names, impute
    )
    shown = [F.round(n, 6).alias(f"w{i}") for i, n in enumerate(names)]
    return data.select("series_id", "target_sales", "brand", "level_name", *shown, F.round("price_median_wan", 6).alias("price_median_wan"))


@check("wide_dataset", _wide_sql(False))
def wide_dataset(spark, sf):
    return _wide(spark, sf, impute=False)


@check("median_impute", _wide_sql(True))
def median_impute(spark, sf):
    return _wide(spark, sf, impute=True)


@check("column_medians", with_ctes(("features",), """
SELECT feature_name, round(quantile_disc(feature_value, 0.5), 6) AS median_value FROM features GROUP BY 1"""))
def column_medians(spark, sf):
    medians = features.feature_medians(views.long_features(spark, sf))
    return medians.withColumn("median_value", F.round("median_value", 6))


# ------------------------------------------------------------------ statistics


@check("average_ranks", """
SELECT event_type, event_id, rank() OVER (PARTITION BY event_type ORDER BY value)
  + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS rank FROM events""")
def average_ranks(spark, sf):
    events = views.table(spark, sf, "events").select("event_type", "event_id", "value")
    ranks = ordering.average_ranks(events, ["event_type"], "value").drop("n_ties")
    return events.join(ranks, ["event_type", "value"]).select("event_type", "event_id", "rank")


SPEARMAN_SQL = """
SELECT l_linestatus, count(*) AS n, round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) AS rho FROM (
  SELECT l_linestatus, rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linestatus, l_quantity) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / 2.0::DOUBLE AS ry
  FROM lineitem) GROUP BY 1"""


@check("spearman", SPEARMAN_SQL)
def spearman(spark, sf):
    lines = views.table(spark, sf, "lineitem").select("l_linestatus", "l_quantity", "l_extendedprice")
    rows = association.spearman(lines, ["l_linestatus"], "l_quantity", "l_extendedprice")
    return rows.withColumn("rho", F.round("rho", 6))


@check("pearson", """
SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS rho FROM lineitem GROUP BY 1""")
def pearson(spark, sf):
    lines = views.table(spark, sf, "lineitem")
    rows = association.pearson(lines, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return rows.withColumn("rho", F.round("rho", 6))


@check("spearman_p", f"""
SELECT p_partkey, round({erfc('z')}, 9) AS p_value FROM (
  SELECT p_partkey, b * sqrt((n - 2) / greatest(1 - b * b, 1e-12)) / sqrt(2.0::DOUBLE) AS z
  FROM (SELECT p_partkey, least(p_size / 50.0::DOUBLE, 0.999999::DOUBLE) AS b, p_partkey % 400 + 3 AS n FROM part))""")
def spearman_p(spark, sf):
    parts = views.table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") / 50.0).alias("rho"), (F.col("p_partkey") % 400 + 3).alias("n")
    )
    return statistics.with_spearman_p(parts, "rho", "n").select("p_partkey", F.round("p_value", 9).alias("p_value"))


@check("fdr_bh", """
WITH tests AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1000000.0::DOUBLE END AS p FROM orders),
levels AS (SELECT *, p * (SELECT count(p) FROM tests) / row_number() OVER (ORDER BY p NULLS LAST, o_orderkey) AS level FROM tests)
SELECT o_orderkey, CASE WHEN p IS NOT NULL THEN round(least(1.0::DOUBLE, min(level) OVER (ORDER BY p DESC NULLS LAST, o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) END AS q
FROM levels""")
def fdr_bh(spark, sf):
    orders = views.table(spark, sf, "orders")
    tests = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 1000000.0).alias("p"))
    return association.fdr_bh(tests, "p", "q").select("o_orderkey", F.round("q", 9).alias("q"))


def described(spark, sf):
    return analysis_job.describe(
        views.attributes(spark, sf), views.trims(spark, sf), views.measures(spark, sf), stage=written
    )


@check("univariate_all", with_ctes(("associations",), """
SELECT feature_name, n, round(spearman_rho, 6) AS spearman_rho, round(p_value, 6) AS p_value, round(fdr_q_value, 6) AS fdr_q_value FROM associations"""))
def univariate_all(spark, sf):
    rows = described(spark, sf)["associations"].orderBy(*association.association_order())
    return rows.select(
        "feature_name", "n", *[F.round(c, 6).alias(c) for c in ("spearman_rho", "p_value", "fdr_q_value")]
    )


@check("significance_counts", with_ctes(("associations",), """
SELECT count(*) AS tested, count(*) FILTER (fdr_q_value < 0.05) AS significant FROM associations"""))
def significance_counts(spark, sf):
    return association.significance_counts(described(spark, sf)["associations"])


# ------------------------------------------------------------------ models


@check("grouped_folds_md5", """
SELECT p_brand, ('0x' || substr(md5(p_brand), 1, 8))::BIGINT % 5 AS fold, count(*) AS n_rows FROM part GROUP BY ALL""")
def grouped_folds_md5(spark, sf):
    folded = models.grouped_folds(views.table(spark, sf, "part"), "p_brand", 5, "md5")
    return folded.groupBy("p_brand", F.col("fold").cast("bigint").alias("fold")).agg(F.count("*").alias("n_rows"))


@check("regression_metrics", """
SELECT l_returnflag, count(*) AS n_rows, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (count(*) * var_pop(y)), 6) AS r2
FROM (SELECT l_returnflag, l_extendedprice AS y, l_extendedprice - l_quantity * 1500.0::DOUBLE AS e FROM lineitem) GROUP BY 1""")
def regression_metrics(spark, sf):
    lines = views.table(spark, sf, "lineitem").select(
        "l_returnflag", "l_extendedprice", (F.col("l_quantity") * 1500.0).alias("prediction")
    )
    rows = models.regression_metrics(lines, ["l_returnflag"], "l_extendedprice")
    return rows.select("l_returnflag", "n_rows", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


# Frames that several model queries read, by session and folder; they are stored in the checkpoint folder or small.
_SHARED: dict[tuple, object] = {}


def shared(make):
    def get(spark, sf):
        key = (make.__name__, spark.sparkContext.applicationId, sf)
        if key not in _SHARED:
            _SHARED[key] = make(spark, sf)
        return _SHARED[key]

    return get


@shared
def model_data(spark, sf):
    """(wide analysis set, selected features); quantities summed over all months are the target, so every series has one."""
    totals = views.measures(spark, sf).groupBy("series_id").agg(F.sum("sales").alias("target_sales"))
    target = written(totals.filter(F.col("target_sales").isNotNull()).withColumn("target_log_sales", F.log1p("target_sales")))
    long = written(views.long_features(spark, sf))
    names = analysis_job.selected_names(features.select_top_features(features.feature_coverage(long, target)))
    data = features.build_analysis_dataset(long, views.controls(spark, sf), target, names)
    return written(data), names


@shared
def all_metrics(spark, sf):
    """Train and test metrics of the three models on the selected features, five folds held out by brand."""
    data, names = model_data(spark, sf)
    return models.cross_validate(models.grouped_folds(data, "brand", 5, "md5"), models.default_specs(names), 5)


@shared
def all_importance(spark, sf):
    data, names = model_data(spark, sf)
    return checkpointed(models.feature_importance(data, names))


def folded_controls(spark, sf):
    """Controls with filled categories, the summed target and md5 folds by brand."""
    totals = views.measures(spark, sf).groupBy("series_id").agg(F.sum("sales").alias("target_sales")).filter(F.col("target_sales").isNotNull())
    joined = features.fill_categories(views.controls(spark, sf).join(totals.withColumn("target_log_sales", F.log1p("target_sales")), "series_id"))
    return models.grouped_folds(joined, "brand", 5, "md5")


_FOLDED_SQL = """, totals AS (SELECT series_id, sum(sales) AS target_sales FROM measures GROUP BY 1 HAVING sum(sales) IS NOT NULL),
filled AS (SELECT coalesce(brand, '未知') AS brand, coalesce(level_name, '未知') AS level_name, coalesce(energy_type, '未知') AS energy_type,
    coalesce(body_structure, '未知') AS body_structure, trim_count, ln(target_sales + 1) AS y FROM controls JOIN totals USING (series_id))"""


@check("category_levels", with_ctes(("controls", "measures"), _FOLDED_SQL + """
SELECT category, value, (row_number() OVER (ORDER BY no, n DESC, value) - 1)::INT AS position FROM (
  SELECT c.no AS no, c.category AS category, c.value AS value, count(*) AS n FROM (SELECT unnest([{'no': 0, 'category': 'brand', 'value': brand},
    {'no': 1, 'category': 'level_name', 'value': level_name}, {'no': 2, 'category': 'energy_type', 'value': energy_type},
    {'no': 3, 'category': 'body_structure', 'value': body_structure}]) AS c FROM filled) GROUP BY ALL)"""))
def category_levels(spark, sf):
    return models.linear.category_levels(folded_controls(spark, sf), vocab.CATEGORICAL_CONTROLS)


@check("fold_covariances", with_ctes(("controls", "measures"), _FOLDED_SQL + """
SELECT ('0x' || substr(md5(brand), 1, 8))::BIGINT % 5 AS fold, count(*) AS n_rows, round(covar_pop(trim_count, y), 6) AS cov_trims, round(var_pop(y), 6) AS var_label
FROM filled GROUP BY 1"""))
def fold_covariances(spark, sf):
    """The sums that the linear models are fitted from, per fold, as covariances."""
    made = models.linear.design(folded_controls(spark, sf), vocab.CATEGORICAL_CONTROLS, ["trim_count"], models.LABEL)
    rows = []
    for fold, sums in models.linear.fold_sums(made).items():
        n, trims, label = sums[0, 0], sums[0, -2], sums[0, -1]
        rows.append((fold, int(n), round(float(sums[-2, -1] / n - trims * label / n**2), 6), round(float(sums[-1, -1] / n - (label / n) ** 2), 6)))
    return spark.createDataFrame(rows, "fold long, n_rows long, cov_trims double, var_label double")


@check("cv_metrics")
def cv_metrics(spark, sf):
    return all_metrics(spark, sf)


@check("fold_means")
def fold_means(spark, sf):
    return models.fold_mean(all_metrics(spark, sf))


@check("incremental_r2")
def incremental_r2(spark, sf):
    return models.incremental_r2(all_metrics(spark, sf))


@check("metric_cards")
def metric_cards(spark, sf):
    return overview.metric_cards(all_metrics(spark, sf))


@check("forest_diagnostics")
def forest_diagnostics(spark, sf):
    return models.forest_diagnostics(all_metrics(spark, sf))


@check("importance")
def importance(spark, sf):
    return all_importance(spark, sf)


@check("importance_table")
def importance_table(spark, sf):
    _, names = model_data(spark, sf)
    classified = views.classified(spark, sf)
    chosen = classified.filter(F.col("feature_name").isin(*names)).select("feature_name")
    return models.importance_table(chosen, classified, all_importance(spark, sf)).orderBy(F.desc("random_forest_importance"), "feature_name")


# ------------------------------------------------------------------ evidence
# Signals with a known spread, derived from the parts: correlation, adjusted p-value and coefficient.
SIGNAL_SQL = f"""signals AS (
  SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN (p_size - 25) / 60.0::DOUBLE END AS spearman_rho,
    CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 12) / 150.0::DOUBLE END AS fdr_q_value,
    CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 5 - 2) / 50.0::DOUBLE END AS elastic_net_coefficient FROM part),
labelled AS (
  SELECT *, CASE WHEN spearman_rho IS NULL THEN 'not_evaluated' WHEN abs(spearman_rho) < 0.05 AND c = 0 THEN 'neutral'
      WHEN c <> 0 AND s <> 0 AND c <> s THEN 'mixed' WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS association_direction,
    CASE WHEN spearman_rho IS NULL THEN 'not_evaluated'
      WHEN fdr_q_value <= 0.01 AND abs(spearman_rho) >= 0.2 AND c <> 0 AND c = s THEN 'strong'
      WHEN fdr_q_value <= 0.05 AND abs(spearman_rho) >= 0.1 AND (c = 0 OR c = s) THEN 'moderate' ELSE 'weak' END AS evidence_strength
  FROM (SELECT *, coalesce(sign(spearman_rho), 0) AS s,
      CASE WHEN elastic_net_coefficient > 1e-12 THEN 1 WHEN elastic_net_coefficient < -1e-12 THEN -1 ELSE 0 END AS c FROM signals))"""


def signals(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    known = key % 13 != 0
    return views.table(spark, sf, "part").select(
        "p_partkey",
        F.when(known, (size - 25) / 60.0).alias("spearman_rho"),
        F.when(known, (key % 12) / 150.0).alias("fdr_q_value"),
        F.when(key % 7 != 0, (key % 5 - 2) / 50.0).alias("elastic_net_coefficient"),
    )


def labelled(spark, sf):
    strength, direction = evidence.evidence_label(
        F.col("spearman_rho"), F.col("fdr_q_value"), F.col("elastic_net_coefficient")
    )
    return signals(spark, sf).withColumns({"evidence_strength": strength, "association_direction": direction})


@check("evidence_labels", f"WITH {SIGNAL_SQL} SELECT p_partkey, evidence_strength, association_direction FROM labelled")
def evidence_labels(spark, sf):
    return labelled(spark, sf).select("p_partkey", "evidence_strength", "association_direction")


@check("signal_labels", f"""WITH {SIGNAL_SQL}
SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN
    (CASE evidence_strength WHEN 'strong' THEN '强证据' WHEN 'moderate' THEN '中等证据' WHEN 'weak' THEN '弱证据' ELSE '未评估' END) ||
    (CASE association_direction WHEN 'positive' THEN ' · 正向' WHEN 'negative' THEN ' · 负向' WHEN 'mixed' THEN ' · 方向混合' WHEN 'neutral' THEN ' · 中性' ELSE '' END)
  WHEN NOT coalesce(fdr_q_value <= 0.05, false) OR abs(coalesce(spearman_rho, 0)) < 0.05 THEN '信号较弱'
  WHEN spearman_rho > 0 THEN '正向信号' ELSE '负向信号' END AS signal FROM labelled""")
def signal_labels(spark, sf):
    rows = labelled(spark, sf).withColumn(
        "evidence_strength", F.when(F.col("p_partkey") % 3 != 0, F.col("evidence_strength"))
    )
    return rows.select("p_partkey", evidence.signal_label().alias("signal"))


# Importance stand-in derived from the quality counters, so that joins and labels can be compared in SQL.
WEIGHT_SQL = """weights AS (
  SELECT feature_name, CASE WHEN numeric_rows % 3 = 0 THEN 0.0::DOUBLE ELSE (rows % 7 - 3)::DOUBLE END AS elastic_net_coefficient,
    (rows % 101) / 100.0::DOUBLE AS random_forest_importance FROM classified WHERE selected_for_adapter)"""


def weights(classified):
    rows = F.col("rows")
    return classified.filter("selected_for_adapter").select(
        "feature_name",
        F.when(F.col("numeric_rows") % 3 == 0, F.lit(0.0)).otherwise((rows % 7 - 3).cast("double")).alias("elastic_net_coefficient"),
        ((rows % 101) / 100.0).alias("random_forest_importance"),
    )


EVIDENCE_SQL = f"""{WEIGHT_SQL}, controls_named AS (
  SELECT unnest([{', '.join(f"{{'f': '{k}', 'p': '{v}'}}" for k, v in vocab.CONTROL_LABELS.items())}]) AS c),
evidence_base AS (
  SELECT feature_name, group_name, parameter_name, parameter_type, s.feature_name IS NOT NULL AS selected_for_model, excluded_reason FROM classified LEFT JOIN selected s USING (feature_name)
  UNION ALL SELECT c.f, 'control', c.p, 'control', true, 'control_only' FROM controls_named),
consolidated AS (
  SELECT *, CASE WHEN spearman_rho IS NULL THEN 'not_evaluated' WHEN abs(spearman_rho) < 0.05 AND c = 0 THEN 'neutral'
      WHEN c <> 0 AND s <> 0 AND c <> s THEN 'mixed' WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS association_direction,
    CASE WHEN spearman_rho IS NULL THEN 'not_evaluated' WHEN fdr_q_value <= 0.01 AND abs(spearman_rho) >= 0.2 AND c <> 0 AND c = s THEN 'strong'
      WHEN fdr_q_value <= 0.05 AND abs(spearman_rho) >= 0.1 AND (c = 0 OR c = s) THEN 'moderate' ELSE 'weak' END AS evidence_strength
  FROM (SELECT b.*, n, spearman_rho, fdr_q_value, elastic_net_coefficient, random_forest_importance, coalesce(sign(spearman_rho), 0) AS s,
      CASE WHEN elastic_net_coefficient > 1e-12 THEN 1 WHEN elastic_net_coefficient < -1e-12 THEN -1 ELSE 0 END AS c
    FROM evidence_base b LEFT JOIN associations a ON a.feature_name = nullif(b.feature_name, '') LEFT JOIN weights w ON w.feature_name = nullif(b.feature_name, '')))"""


def evidence_frames(spark, sf):
    frames = described(spark, sf)
    rows = checkpointed(frames["quality"])
    tested = checkpointed(frames["associations"])
    importance_rows = weights(rows)
    consolidated = evidence.consolidated_evidence(analysis_job.with_controls(rows), tested, importance_rows)
    return rows, tested, importance_rows, consolidated


@check("consolidated", with_ctes(("associations", "selected", "classified"), f""", {EVIDENCE_SQL}
SELECT feature_name, group_name, parameter_name, parameter_type, selected_for_model, excluded_reason, n, round(spearman_rho, 6) AS spearman_rho,
  round(fdr_q_value, 6) AS fdr_q_value, elastic_net_coefficient, random_forest_importance, evidence_strength, association_direction,
  'insufficient_history' AS trend_status FROM consolidated"""))
def consolidated(spark, sf):
    rows = evidence_frames(spark, sf)[3]
    return rows.withColumns({c: F.round(c, 6) for c in ("spearman_rho", "fdr_q_value")}).orderBy(*evidence.evidence_order())


@check("described_associations", with_ctes(("associations", "selected", "classified"), f""", {EVIDENCE_SQL}
SELECT a.feature_name, b.group_name, b.parameter_name, b.parameter_type, a.n, round(a.spearman_rho, 6) AS spearman_rho
FROM associations a LEFT JOIN evidence_base b ON a.feature_name = b.feature_name"""))
def described_associations(spark, sf):
    frames = described(spark, sf)
    rows = evidence.describe_associations(frames["associations"], frames["quality"])
    return rows.select(
        "feature_name", "group_name", "parameter_name", "parameter_type", "n", F.round("spearman_rho", 6).alias("spearman_rho")
    )


OVERVIEW_SQL = f"""{EVIDENCE_SQL}, overview AS (
  SELECT CASE WHEN feature_name <> '' THEN feature_name ELSE 'raw:' || group_name || '|' || parameter_name END AS feature_name, group_name, parameter_name,
    parameter_type, spearman_rho, fdr_q_value, elastic_net_coefficient, random_forest_importance, evidence_strength, association_direction, excluded_reason FROM consolidated)"""


@check("overview_rows", with_ctes(("associations", "selected", "classified"), f""", {OVERVIEW_SQL}
SELECT * REPLACE (round(spearman_rho, 6) AS spearman_rho, round(fdr_q_value, 6) AS fdr_q_value), 'insufficient_history' AS trend_status
FROM overview ORDER BY random_forest_importance DESC NULLS LAST, feature_name LIMIT 187"""))
def overview_rows(spark, sf):
    rows, tested, weighed, merged = evidence_frames(spark, sf)
    top = overview.top_overview(overview.overview_rows(merged, tested, weighed, rows))
    return top.withColumns({c: F.round(c, 6) for c in ("spearman_rho", "fdr_q_value")})


@check("top12_chart_rows", with_ctes(("associations", "selected", "classified"), f""", {OVERVIEW_SQL}
SELECT feature_name, random_forest_importance FROM overview ORDER BY coalesce(random_forest_importance, 0) DESC, feature_name LIMIT 12"""))
def top12_chart_rows(spark, sf):
    rows, tested, weighed, merged = evidence_frames(spark, sf)
    top = overview.top_chart_rows(overview.overview_rows(merged, tested, weighed, rows))
    return top.select("feature_name", "random_forest_importance")


@check("kpi_fallbacks", with_ctes(("associations", "selected", "classified", "measures", "target"), """
SELECT (SELECT max(sales_period) FROM measures WHERE sales IS NOT NULL) AS sales_period, (SELECT count(*) FROM target) AS analysis_rows,
  (SELECT count(*) FROM classified) AS parameter_definitions, (SELECT count(*) FROM classified WHERE selected_for_adapter) AS adapter_features,
  (SELECT count(*) FROM selected) AS model_features, (SELECT count(*) FROM associations WHERE fdr_q_value < 0.05) AS significant_features"""))
def kpi_fallbacks(spark, sf):
    """Only period and analysis rows are stored; the other indicators fall back to derived counts."""
    frames = described(spark, sf)
    n_rows = frames["target"].agg(F.count("*")).scalar()
    stored = views.measures(spark, sf).filter(F.col("sales").isNotNull()).agg(F.max("sales_period").alias("sales_period")).select(
        "sales_period", n_rows.cast("string").alias("analysis_rows"), F.lit("0").alias("parameter_definitions"),
        F.lit(None).cast("string").alias("adapter_features"), F.lit("").alias("model_features"),
        F.lit("NaN").alias("fdr_significant_features_0_05"),
    )
    return overview.kpi_fallbacks(stored, frames["quality"], frames["associations"])


@check("analysis_summary", with_ctes(("associations", "selected", "classified", "measures", "target", "controls"), """
SELECT (SELECT max(sales_period) FROM measures WHERE sales IS NOT NULL) AS sales_period, (SELECT count(*) FROM target JOIN controls USING (series_id)) AS analysis_rows,
  (SELECT count(*) FROM classified) AS parameter_definitions, (SELECT count(*) FROM classified WHERE selected_for_adapter) AS adapter_features,
  (SELECT count(*) FROM selected) AS model_features, 0.2::DOUBLE AS minimum_coverage, 5 AS brand_grouped_folds, '全国4S最低报价|车款人气' AS excluded_leakage_parameters,
  (SELECT count(*) FROM associations WHERE fdr_q_value < 0.05) AS fdr_significant_features_0_05, 'insufficient_history' AS trend_status,
  '仅有单期配置快照，不能估计配置渗透趋势或预测未来趋势' AS trend_status_reason, '探索性关联，不代表配置参数对销量的因果影响' AS interpretation"""))
def analysis_summary(spark, sf):
    frames = described(spark, sf)
    joined = frames["target"].join(frames["controls"], "series_id")
    return analysis_job.analysis_summary(views.measures(spark, sf), joined, frames["quality"], frames["associations"])


@check("group_list", with_ctes(("classified",), "SELECT DISTINCT coalesce(nullif(group_name, ''), '其他') AS group_name FROM classified"))
def group_list(spark, sf):
    return overview.group_list(views.classified(spark, sf))


@check("group_filter", with_ctes(("classified",), "SELECT parameter_key, group_name FROM classified WHERE group_name = '基本参数'"))
def group_filter(spark, sf):
    return overview.group_filter(views.classified(spark, sf), "基本参数").select("parameter_key", "group_name")


@check("control_labels", f"""
SELECT c.f AS feature_name, c.p AS parameter_name, c.n AS n_series FROM (SELECT unnest([{', '.join(
    f"{{'f': '{k}', 'p': '{v}', 'n': (SELECT count(*) FROM part)}}" for k, v in vocab.CONTROL_LABELS.items())}]) AS c)""")
def control_labels(spark, sf):
    n_series = views.series(spark, sf).agg(F.count("*")).scalar()
    return evidence.control_quality(spark).select("feature_name", "parameter_name", n_series.alias("n_series"))


@check("finite_or_null", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS number FROM events""")
def finite_or_null(spark, sf):
    from wheelbase.functions.text import finite_or_null as finite

    key = F.col("event_id")
    shown = F.when(key % 5 == 0, "n/a").when(key % 7 == 0, "NaN").when(key % 7 == 1, "Infinity").otherwise(F.col("value").cast("string"))
    return views.table(spark, sf, "events").select("event_id", finite(shown).alias("number"))
