"""Overview of a finished analysis: tolerant reads, merged rows, indicators, cards and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelbase import vocab
from wheelbase.operators import overview
from wheelbase.sources import tables

STORED_COUNTS = (
    "analysis_rows", "parameter_definitions", "adapter_features", "model_features", "fdr_significant_features_0_05",
)
EMPTY = {
    "associations": "feature_name string, spearman_rho string, fdr_q_value string",
    "importance": (
        "feature_name string, group_name string, parameter_name string, parameter_type string, "
        "elastic_net_coefficient string, random_forest_importance string"
    ),
    "quality": "feature_name string, selected_for_adapter string, selected_for_model string",
}


def stored_record(spark: SparkSession, document: DataFrame | None) -> DataFrame:
    """The stored summary as one row of text fields; all NULL when there is none."""
    names = ("sales_period", *STORED_COUNTS, "trend_status", "trend_status_reason", "interpretation")
    if document is None:
        return spark.range(1).select(*[F.lit(None).cast("string").alias(n) for n in names])
    return document.select(*[F.try_variant_get("v", f"$.{n}", "string").alias(n) for n in names])


def stored_metrics(spark: SparkSession, document: DataFrame | None) -> DataFrame:
    """Stored mean metrics in the long form the cards use."""
    if document is None:
        return spark.createDataFrame([], "model string, fold int, metric string, value double")
    cells = [
        F.struct(
            F.lit(model).alias("model"),
            F.lit(0).alias("fold"),
            F.lit(f"test_{m}").alias("metric"),
            F.try_variant_get("v", f"$.model_metrics.{model}.mean.{m}", "double").alias("value"),
        )
        for model in vocab.METRIC_LABELS
        for m in ("r2", "rmse", "mae")
    ]
    return document.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def load(spark: SparkSession, folder: str, limit: object = overview.LIMIT_DEFAULT) -> dict[str, DataFrame]:
    """Frames of the overview; ``health.ok`` is false for every table that could not be used."""
    number = overview.overview_limit(limit)
    read, health = tables.artifact_health(spark, folder)
    document = read.get("model_metrics")
    table = lambda name: read.get(name, None) if name in read else spark.createDataFrame([], EMPTY[name])
    associations, importance, quality = table("associations"), table("importance"), table("quality")
    stored = stored_record(spark, document)
    remarks = stored.first()
    consolidated = read.get("consolidated")
    if consolidated is not None and consolidated.isEmpty():
        consolidated = None
    rows = overview.overview_rows(consolidated, associations, importance, quality, remarks.trend_status or "")
    return {
        "available": health.agg(F.min("ok").alias("available")),
        "indicators": overview.kpi_fallbacks(stored, quality, associations),
        "cards": overview.metric_cards(stored_metrics(spark, document)),
        "top_parameters": overview.top_overview(rows, number),
        "trend": stored.select(
            F.coalesce(F.nullif("trend_status", F.lit("")), F.lit(vocab.TREND_STATUS)).alias("trend_status"),
            F.coalesce(F.nullif("trend_status_reason", F.lit("")), F.lit(vocab.TREND_REASON_DEFAULT)).alias("trend_status_reason"),
        ),
        "warnings": overview.overview_warnings(
            health, remarks.interpretation or "", remarks.trend_status_reason or ""
        ).orderBy("position"),
        "groups": overview.group_list(rows),
    }
