"""Conservative evidence labels and one consolidated row per parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheelbase import vocab
from wheelbase.functions.statistics import nan_to_null

DEAD_ZONE = 1e-12


def _sign(value: Column, dead: float = 0.0) -> Column:
    return F.when(value > dead, 1).when(value < -dead, -1).otherwise(0)


def evidence_label(rho: Column, q: Column, coefficient: Column) -> tuple[Column, Column]:
    """(strength, direction) from correlation, adjusted p-value and linear coefficient.

    Forest importance has no sign and is not used.
    """
    rho, q = nan_to_null(rho), nan_to_null(q)
    by_rank = _sign(rho)
    by_model = _sign(F.coalesce(coefficient, F.lit(0.0)), DEAD_ZONE)
    size = F.abs(rho)
    opposed = (by_model != 0) & (by_rank != 0) & (by_model != by_rank)
    agreed = (by_model == 0) | (by_model == by_rank)
    direction = (
        F.when(rho.isNull(), "not_evaluated")
        .when((size < 0.05) & (by_model == 0), "neutral")
        .when(opposed, "mixed")
        .when(by_rank > 0, "positive")
        .when(by_rank < 0, "negative")
        .otherwise("neutral")
    )
    strength = (
        F.when(rho.isNull(), "not_evaluated")
        .when((q <= 0.01) & (size >= 0.2) & (by_model != 0) & agreed, "strong")
        .when((q <= 0.05) & (size >= 0.1) & agreed, "moderate")
        .otherwise("weak")
    )
    return strength, direction


def control_quality(spark) -> DataFrame:
    """The control variables as rows of the evidence table, with display names."""
    rows = [(name, label) for name, label in vocab.CONTROL_LABELS.items()]
    return spark.createDataFrame(rows, "feature_name string, parameter_name string").select(
        "feature_name",
        F.lit("control").alias("group_name"),
        "parameter_name",
        F.lit("control").alias("parameter_type"),
        F.lit(True).alias("selected_for_model"),
        F.lit("control_only").alias("excluded_reason"),
    )


def describe_associations(associations: DataFrame, quality: DataFrame) -> DataFrame:
    """Associations with group, name and type of their parameter or control."""
    described = quality.filter(F.col("feature_name") != "").select(
        "feature_name", "group_name", "parameter_name", "parameter_type"
    )
    controls = control_quality(associations.sparkSession).select(*described.columns)
    return associations.join(described.unionByName(controls), "feature_name", "left")


def consolidated_evidence(quality: DataFrame, associations: DataFrame, importance: DataFrame) -> DataFrame:
    """Every parameter keeps its row, modelled or not; a blank feature name matches nothing."""
    base = quality.select(
        F.nullif("feature_name", F.lit("")).alias("_feature"),
        "feature_name", "group_name", "parameter_name", "parameter_type", "selected_for_model", "excluded_reason",
    )
    tested = associations.select(F.col("feature_name").alias("_feature"), "n", "spearman_rho", "fdr_q_value")
    weighed = importance.select(
        F.col("feature_name").alias("_feature"), "elastic_net_coefficient", "random_forest_importance"
    )
    joined = base.join(tested, "_feature", "left").join(weighed, "_feature", "left").drop("_feature")
    strength, direction = evidence_label(
        F.col("spearman_rho"), F.col("fdr_q_value"), F.col("elastic_net_coefficient")
    )
    return joined.withColumns(
        {
            "evidence_strength": strength,
            "association_direction": direction,
            "trend_status": F.lit(vocab.TREND_STATUS),
        }
    )


def evidence_order() -> list[Column]:
    return [F.asc("group_name"), F.asc("parameter_name")]


def signal_label() -> Column:
    """Display label: from the evidence when present, else from q and rho alone."""
    def mapped(column: str, labels: dict[str, str]) -> Column:
        table = F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])
        return F.try_element_at(table, F.col(column))

    strength = F.coalesce(mapped("evidence_strength", vocab.STRENGTH_LABELS), F.col("evidence_strength"))
    direction = F.nullif(F.coalesce(mapped("association_direction", vocab.DIRECTION_LABELS), F.lit("")), F.lit(""))
    labelled = F.concat_ws(" · ", strength, direction)
    rho = F.coalesce("spearman_rho", F.lit(0.0))
    weak = ~F.coalesce(F.col("fdr_q_value") <= 0.05, F.lit(False)) | (F.abs(rho) < 0.05)
    plain = F.when(weak, "信号较弱").when(rho > 0, "正向信号").otherwise("负向信号")
    return F.when(F.coalesce("evidence_strength", F.lit("")) != "", labelled).otherwise(plain)
