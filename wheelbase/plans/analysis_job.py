"""Analysis job: attributes, trims and monthly measures to features, models and evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelbase import vocab
from wheelbase.operators import association, evidence, features, models, quality, summary
from wheelbase.staging import checkpointed, written
from wheelbase.sources import tables


@dataclass(frozen=True)
class Settings:
    minimum_coverage: float = 0.2
    max_features: int = 120
    folds: int = 5
    fold_method: str = "xxhash64"
    forest: object = models.forest_model
    # Medians per training fold instead of over all rows.
    impute_in_fold: bool = False


def describe(attributes: DataFrame, trims: DataFrame, measures: DataFrame, settings: Settings = Settings(), stage=lambda df: df):
    """Everything before the models, as frames; ``stage`` may materialise what is read repeatedly."""
    classified = stage(quality.classify_parameters(quality.parameter_quality(attributes)))
    long = stage(features.build_features(attributes, quality.feature_mapping(classified)))
    controls = stage(features.build_controls(attributes, trims))
    target = stage(features.build_target(measures))
    selected = stage(
        features.select_top_features(
            features.feature_coverage(long, target), settings.minimum_coverage, settings.max_features
        )
    )
    return {
        "quality": features.write_back_selection(classified, selected),
        "features": long,
        "controls": controls,
        "target": target,
        "selected": selected,
        "associations": association.univariate_associations(features.selected_long(long, selected), target, controls),
    }


def selected_names(selected: DataFrame) -> list[str]:
    """The pivot's column list: at most ``max_features`` names."""
    order = [F.desc("coverage"), F.desc("stddev"), F.asc("feature_name")]
    return [row.feature_name for row in selected.orderBy(*order).select("feature_name").collect()]


def model_frames(described: dict[str, DataFrame], settings: Settings = Settings()) -> dict[str, DataFrame]:
    names = selected_names(described["selected"])
    build = lambda impute: features.build_analysis_dataset(
        described["features"], described["controls"], described["target"], names, impute
    )
    analysis = written(build(True))
    open_data = written(build(False)) if settings.impute_in_fold else analysis
    folded = models.grouped_folds(open_data, "brand", settings.folds, settings.fold_method)
    specs = models.default_specs(names, settings.forest)
    metrics = models.cross_validate(folded, specs, settings.folds, impute_in_fold=settings.impute_in_fold)
    weights = models.feature_importance(analysis, names, settings.forest)
    return {
        "analysis": analysis,
        "metrics": metrics,
        "importance": models.importance_table(described["selected"], described["quality"], weights),
    }


def with_controls(quality_rows: DataFrame) -> DataFrame:
    """Quality rows of the parameters followed by those of the controls."""
    own = quality_rows.select(*evidence.control_quality(quality_rows.sparkSession).columns)
    return own.unionByName(evidence.control_quality(quality_rows.sparkSession))


def analysis_summary(
    measures: DataFrame, analysis: DataFrame, quality_rows: DataFrame, associations: DataFrame,
    settings: Settings = Settings(),
) -> DataFrame:
    """One record of the run's data-side facts and fixed remarks; every count is a scalar subquery."""
    count = lambda df, condition=F.lit(True): df.agg(F.count_if(condition)).scalar()
    significant: Column = count(associations, F.col("fdr_q_value") < 0.05)
    return measures.filter(F.col("sales").isNotNull()).agg(F.max("sales_period").alias("sales_period")).select(
        "sales_period",
        count(analysis).alias("analysis_rows"),
        count(quality_rows).alias("parameter_definitions"),
        count(quality_rows, F.col("selected_for_adapter")).alias("adapter_features"),
        count(quality_rows, F.col("selected_for_model")).alias("model_features"),
        F.lit(settings.minimum_coverage).alias("minimum_coverage"),
        F.lit(settings.folds).alias("brand_grouped_folds"),
        F.lit("|".join(sorted(vocab.LEAKAGE_PARAMETERS))).alias("excluded_leakage_parameters"),
        significant.alias("fdr_significant_features_0_05"),
        F.lit(vocab.TREND_STATUS).alias("trend_status"),
        F.lit(vocab.TREND_REASON).alias("trend_status_reason"),
        F.lit(vocab.INTERPRETATION).alias("interpretation"),
    )


RESULT_COLUMNS = {
    "parameter_quality": (
        "parameter_key", "group_id", "group_name", "parameter_name", "rows", "blank_rows", "numeric_rows",
        "standard_rows", "optional_rows", "mixed_rows", "absent_rows", "distinct_values", "parameter_type",
        "recognized_rate", "feature_name", "selected_for_adapter", "selected_for_model", "model_coverage",
        "model_stddev", "excluded_reason",
    ),
    "univariate_associations": (
        "feature_name", "group_name", "parameter_name", "parameter_type", "n", "spearman_rho", "p_value",
        "fdr_q_value",
    ),
    "parameter_importance": (
        "feature_name", "group_name", "parameter_name", "parameter_type", "elastic_net_coefficient",
        "random_forest_importance",
    ),
    "consolidated_parameter_results": (
        "feature_name", "group_name", "parameter_name", "parameter_type", "selected_for_model", "excluded_reason",
        "n", "spearman_rho", "fdr_q_value", "elastic_net_coefficient", "random_forest_importance",
        "evidence_strength", "association_direction", "trend_status",
    ),
    "random_forest_model_diagnostics": (
        "fold", "train_rmse", "test_rmse", "train_mae", "test_mae", "train_r2", "test_r2",
    ),
}


def run(spark: SparkSession, source: str, output: str, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Whole job; the long attribute table is scanned for quality, features and controls only."""
    read = tables.read_tables(spark, source, ("parameters", "trims", "measures"))
    described = describe(read["parameters"], read["trims"], read["measures"], settings, stage=written)
    quality_rows = checkpointed(described["quality"])
    associations = checkpointed(described["associations"])
    described["quality"] = quality_rows
    modelled = model_frames(described, settings)
    importance = checkpointed(modelled["importance"])
    consolidated = evidence.consolidated_evidence(with_controls(quality_rows), associations, importance)
    results = {
        "parameter_quality": quality_rows.orderBy("parameter_key"),
        "univariate_associations": evidence.describe_associations(associations, quality_rows).orderBy(
            *association.association_order()
        ),
        "parameter_importance": importance.orderBy(F.desc("random_forest_importance"), "feature_name"),
        "consolidated_parameter_results": consolidated.orderBy(*evidence.evidence_order()),
        "random_forest_model_diagnostics": models.forest_diagnostics(modelled["metrics"]),
    }
    for name, frame in results.items():
        tables.write_rows_csv(frame, f"{output}/{name}.csv", RESULT_COLUMNS[name])
    tables.write_parquet(described["features"], f"{output}/series_features_all.parquet")
    tables.write_parquet(
        features.selected_long(described["features"], described["selected"]), f"{output}/series_features.parquet"
    )
    tables.write_parquet(modelled["analysis"], f"{output}/analysis_dataset.parquet")
    record = summary_record(read["measures"], modelled, quality_rows, associations, settings)
    tables.write_json(record, f"{output}/model_metrics.json")
    return {**results, "summary": record, "metrics": modelled["metrics"]}


def summary_record(measures: DataFrame, modelled: dict[str, DataFrame], quality_rows: DataFrame, associations: DataFrame, settings: Settings) -> DataFrame:
    """Summary with nested model means and increments, in the shape the overview reads."""
    base = analysis_summary(measures, modelled["analysis"], quality_rows, associations, settings)
    means = models.fold_mean(modelled["metrics"])
    columns = [c for c in means.columns if c != "model"]
    named = [
        means.filter(F.col("model") == name).select(F.struct(F.struct(*columns).alias("mean"))).scalar().alias(name)
        for name in vocab.METRIC_LABELS
    ]
    increments = models.incremental_r2(modelled["metrics"]).select(F.struct("elastic_net", "random_forest")).scalar()
    notes = F.struct(*[F.lit(note).alias(name) for name, note in vocab.IMPORTANCE_NOTES.items()])
    hyper = F.struct(*[F.lit(value).alias(name) for name, value in models.FOREST.items()])
    return base.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"),
        "*",
        F.struct(*named).alias("model_metrics"),
        increments.alias("incremental_mean_r2"),
        hyper.alias("forest_settings"),
        notes.alias("importance_notes"),
    )
