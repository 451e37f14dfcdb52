"""Read side: merged overview rows, indicators with fallbacks, groups and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheelbase import vocab
from wheelbase.functions.text import finite_or_null

LIMIT_DEFAULT, LIMIT_MIN, LIMIT_MAX = 187, 1, 500


class OverviewLimitError(ValueError):
    """Limit outside 1..500 or not an integer."""

    def __init__(self) -> None:
        self.code, message = vocab.ERROR_MESSAGES["overview_limit"]
        self.field = "limit"
        super().__init__(message)


def overview_limit(value: object = LIMIT_DEFAULT) -> int:
    try:
        number = int(str(value))
    except ValueError:
        raise OverviewLimitError() from None
    if not LIMIT_MIN <= number <= LIMIT_MAX:
        raise OverviewLimitError()
    return number


def _filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def overview_rows(
    evidence: DataFrame | None,
    associations: DataFrame,
    importance: DataFrame,
    quality: DataFrame,
    trend_status: str = "",
) -> DataFrame:
    """Consolidated rows (importance rows when there are none) with correlations looked up again
    in the associations and blank texts filled from the quality table."""
    consolidated = evidence is not None
    source = evidence if consolidated else importance.filter(F.coalesce("feature_name", F.lit("")) != "")
    own = source.select(
        F.coalesce("feature_name", F.lit("")).alias("own_name"),
        F.nullif("feature_name", F.lit("")).alias("_feature"),
        *[_optional(source, c).alias(c) for c in ("group_name", "parameter_name", "parameter_type")],
        *[finite_or_null(F.col(c).cast("string")).alias(c) for c in ("elastic_net_coefficient", "random_forest_importance")],
        *[
            _optional(source, c).alias(c)
            for c in ("evidence_strength", "association_direction", "trend_status", "excluded_reason")
        ],
    )
    tested = associations.filter(F.col("feature_name") != "").select(
        F.col("feature_name").alias("_feature"),
        *[finite_or_null(F.col(c).cast("string")).alias(c) for c in ("spearman_rho", "fdr_q_value")],
    )
    described = quality.filter(F.col("feature_name") != "").select(
        F.col("feature_name").alias("_feature"),
        *[
            _optional(quality, c).alias(f"q_{c}")
            for c in ("group_name", "parameter_name", "parameter_type", "excluded_reason")
        ],
    )
    raw_name = F.concat(
        F.lit("raw:"), F.coalesce("group_name", F.lit("")), F.lit("|"), F.coalesce("parameter_name", F.lit(""))
    )
    joined = own.join(tested, "_feature", "left").join(described, "_feature", "left")
    fallback = lambda c: _filled(F.col(c), F.col(f"q_{c}")).alias(c)
    return joined.select(
        F.when(F.col("own_name") != "", F.col("own_name")).otherwise(raw_name).alias("feature_name"),
        *[fallback(c) for c in ("group_name", "parameter_name", "parameter_type")],
        "spearman_rho",
        "fdr_q_value",
        "elastic_net_coefficient",
        "random_forest_importance",
        _filled(F.col("evidence_strength")).alias("evidence_strength"),
        _filled(F.col("association_direction")).alias("association_direction"),
        _filled(F.col("trend_status"), F.lit(trend_status)).alias("trend_status"),
        fallback("excluded_reason"),
    )


def top_overview(rows: DataFrame, limit: object = LIMIT_DEFAULT) -> DataFrame:
    """Highest importance first, unknown importance last."""
    return rows.orderBy(F.desc_nulls_last("random_forest_importance"), "feature_name").limit(overview_limit(limit))


def top_chart_rows(rows: DataFrame, n: int = 12) -> DataFrame:
    return rows.orderBy(F.coalesce("random_forest_importance", F.lit(0.0)).desc(), "feature_name").limit(n)


def group_filter(rows: DataFrame, group: str = "") -> DataFrame:
    label = _filled(F.col("group_name"))
    return rows.filter(F.when(label == "", vocab.OTHER_LABEL).otherwise(label) == group) if group else rows


def group_list(rows: DataFrame) -> DataFrame:
    label = F.coalesce(F.nullif("group_name", F.lit("")), F.lit(vocab.OTHER_LABEL))
    return rows.select(label.alias("group_name")).distinct().orderBy("group_name")


def kpi_fallbacks(
    stored: DataFrame, quality: DataFrame, associations: DataFrame, level: float = 0.05
) -> DataFrame:
    """One row of indicators: the stored number, or the derived count where it is 0 or missing."""
    flag = lambda c: F.count_if(F.lower(F.col(c).cast("string")) == "true")
    derived_quality = quality.agg(
        F.struct(
            F.count("*").alias("definitions"),
            flag("selected_for_adapter").alias("adapter"),
            flag("selected_for_model").alias("model"),
        ).alias("d")
    ).scalar()
    q_value = finite_or_null(F.col("fdr_q_value").cast("string"))
    significant = associations.agg(F.count_if(q_value < level)).scalar()
    base = stored.withColumns({"_d": derived_quality, "_s": significant})
    whole = lambda c: F.coalesce(finite_or_null(F.col(c).cast("string")).cast("bigint"), F.lit(0))
    either = lambda c, derived: F.coalesce(F.nullif(whole(c), F.lit(0)), derived)
    return base.select(
        "sales_period",
        whole("analysis_rows").alias("analysis_rows"),
        either("parameter_definitions", F.col("_d.definitions")).alias("parameter_definitions"),
        either("adapter_features", F.col("_d.adapter")).alias("adapter_features"),
        either("model_features", F.col("_d.model")).alias("model_features"),
        either("fdr_significant_features_0_05", F.col("_s")).alias("significant_features"),
    )


def metric_cards(metrics: DataFrame) -> DataFrame:
    """Three models × r2, rmse, mae with display labels; absent models keep their card with NULLs.

    ``metrics`` is the long frame ``(model, fold, metric, value)``; the mean over folds is shown.
    """
    spark = metrics.sparkSession
    cards = spark.createDataFrame(
        [(i, key, label) for i, (key, label) in enumerate(vocab.METRIC_LABELS.items())],
        "card_no int, key string, label string",
    )
    mean = metrics.groupBy("model").agg(
        *[F.round(F.avg(F.when(F.col("metric") == f"test_{m}", F.col("value"))), 6).alias(m) for m in ("r2", "rmse", "mae")]
    )
    return cards.join(mean, cards["key"] == mean["model"], "left").select("card_no", "key", "label", "r2", "rmse", "mae")


def overview_warnings(health: DataFrame, interpretation: str = "", trend_reason: str = "") -> DataFrame:
    """Warnings of unreadable tables, then the stored remarks."""
    warnings = health.filter(F.col("warning").isNotNull()).select("position", "warning")
    extra = [(100 + i, t) for i, t in enumerate([interpretation, trend_reason]) if t]
    if not extra:
        return warnings
    return warnings.unionByName(health.sparkSession.createDataFrame(extra, "position int, warning string"))
