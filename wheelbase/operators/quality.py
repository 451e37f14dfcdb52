"""What kind of attribute each parameter is, and which of them become features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheelbase import vocab

DEFINITION = ("parameter_key", "group_id", "group_name", "parameter_name")
COUNTERS = ("blank_rows", "numeric_rows", "standard_rows", "optional_rows", "mixed_rows", "absent_rows")


def parameter_quality(attributes: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """Row counters per parameter in one map-combined pass; blank means NULL or ''."""
    value, state = F.col("value_text"), F.col("equipment_state")
    distinct = F.countDistinct(value) if exact_distinct else F.approx_count_distinct(value)
    return attributes.groupBy(*DEFINITION).agg(
        F.count("*").alias("rows"),
        F.count_if(F.coalesce(value, F.lit("")) == "").alias("blank_rows"),
        F.count("value_numeric").alias("numeric_rows"),
        *[F.count_if(state == name).alias(f"{name}_rows") for name in vocab.EQUIPMENT_CODES],
        F.count_if(value.isin(*vocab.ABSENT_MARKS)).alias("absent_rows"),
        distinct.alias("distinct_values"),
    )


def _symbols() -> Column:
    return F.col("standard_rows") + F.col("optional_rows") + F.col("mixed_rows")


def parameter_type() -> Column:
    """numeric, equipment or categorical, from the counters."""
    share = lambda part, whole: part / F.greatest(whole, F.lit(1))
    numeric = F.col("numeric_rows")
    enough_numbers = (numeric >= vocab.MIN_NUMERIC_ROWS) & (
        share(numeric, F.col("rows") - F.col("blank_rows")) >= vocab.MIN_TYPE_RATIO
    )
    recognized = _symbols() + F.col("absent_rows")
    enough_symbols = (_symbols() > 0) & (share(recognized, F.col("rows")) >= vocab.MIN_TYPE_RATIO)
    return F.when(enough_numbers, "numeric").when(enough_symbols, "equipment").otherwise("categorical")


def exclusion_reason(
    leakage: Sequence[str] = vocab.LEAKAGE_PARAMETERS, controls: Sequence[str] = vocab.CONTROL_ONLY_PARAMETERS
) -> Column:
    name = F.col("parameter_name")
    return F.when(name.isin(*leakage), "target_leakage").when(name.isin(*controls), "control_only").otherwise("")


def feature_name(kind: Column, key: Column) -> Column:
    prefix = F.when(kind == "numeric", "num_").otherwise("equip_")
    return F.concat(prefix, F.substring(F.sha1(key), 1, 12))


def recognized_rate() -> Column:
    recognized = F.when(F.col("parameter_type") == "numeric", F.col("numeric_rows")).otherwise(
        _symbols() + F.col("absent_rows")
    )
    return F.round(recognized / F.greatest("rows", F.lit(1)), 6)


def classify_parameters(
    quality: DataFrame,
    leakage: Sequence[str] = vocab.LEAKAGE_PARAMETERS,
    controls: Sequence[str] = vocab.CONTROL_ONLY_PARAMETERS,
) -> DataFrame:
    """Counters plus type, recognized rate, exclusion reason and feature name ('' when none)."""
    typed = quality.withColumn("parameter_type", parameter_type())
    judged = typed.withColumns(
        {"recognized_rate": recognized_rate(), "excluded_reason": exclusion_reason(leakage, controls)}
    )
    adapted = F.col("parameter_type").isin("numeric", "equipment") & (F.col("excluded_reason") == "")
    return judged.withColumn("selected_for_adapter", adapted).withColumn(
        "feature_name",
        F.when(F.col("selected_for_adapter"), feature_name(F.col("parameter_type"), F.col("parameter_key"))).otherwise(""),
    )


def feature_mapping(classified: DataFrame) -> DataFrame:
    return classified.filter("selected_for_adapter").select("parameter_key", "parameter_type", "feature_name")
