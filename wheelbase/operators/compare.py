"""Side-by-side comparison of two or three items per set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wheelbase import vocab
from wheelbase.functions import rules


def check_sets(sets: DataFrame, items: DataFrame, key: str = "set_id") -> tuple[DataFrame, DataFrame]:
    """(valid sets, rejected sets with code, message, field, status); ``sets`` has ``car_ids array``."""
    ids = F.col("car_ids")
    count = F.coalesce(F.size(ids), F.lit(0))
    wrong_count = ids.isNull() | ~count.between(2, 3)
    repeated = F.size(F.array_distinct(ids)) != count
    count_error, repeat_error = vocab.ERROR_MESSAGES["compare_count"], vocab.ERROR_MESSAGES["compare_duplicate"]
    first = sets.withColumns(
        {
            "code": F.when(wrong_count, count_error[0]).when(repeated, repeat_error[0]),
            "message": F.when(wrong_count, count_error[1]).when(repeated, repeat_error[1]),
        }
    )
    formal = first.filter(F.col("code").isNotNull()).select(key, "code", "message", F.lit(400).alias("status"))
    wellformed = first.filter(F.col("code").isNull()).select(key, "car_ids")
    unknown = (
        wellformed.select(key, F.posexplode("car_ids").alias("pos", "car_id"))
        .join(items.select("car_id"), "car_id", "left_anti")
        .groupBy(key)
        .agg(F.min_by("car_id", "pos").alias("missing"))
    )
    absent = unknown.select(
        key,
        F.lit("CAR_NOT_FOUND").alias("code"),
        F.concat(F.lit("车型不存在："), "missing").alias("message"),
        F.lit(404).alias("status"),
    )
    rejected = formal.unionByName(absent).withColumn("field", F.lit("car_ids"))
    return wellformed.join(unknown, key, "left_anti"), rejected


def compare_items(items: DataFrame, valid_sets: DataFrame, key: str = "set_id") -> DataFrame:
    """Rows of the valid sets in request order."""
    listed = valid_sets.select(key, F.posexplode("car_ids").alias("pos", "car_id"))
    return listed.join(items.select(*vocab.PUBLIC_FIELDS), "car_id").select(key, "pos", *vocab.PUBLIC_FIELDS)


def _bounded(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(value, 1)))


def radar_scores(compared: DataFrame, key: str = "set_id") -> DataFrame:
    """Six 0–100 scores per compared item, scaled inside its set of at most three rows."""
    group = Window.partitionBy(key)
    price = F.coalesce("price_min_wan", F.lit(0.0))
    year = F.coalesce(F.nullif("model_year", F.lit(0)), F.lit(None).cast("int"))
    low, high = F.min(price).over(group), F.max(price).over(group)
    first_year, last_year = F.min(year).over(group), F.max(year).over(group)

    def share(column: str) -> Column:
        top = F.greatest(F.max(F.coalesce(column, F.lit(0))).over(group), F.lit(1))
        return F.coalesce(100.0 * F.col(column) / top, F.lit(0.0))

    scores = {
        "price_score": F.when(high == low, 100.0).otherwise(30 + 70 * F.try_divide(high - price, high - low)),
        "power_score": share("horsepower"),
        "seats_score": share("seats"),
        "freshness_score": F.when(year.isNull(), 0.0)
        .when(first_year == last_year, 100.0)
        .otherwise(50 + 50.0 * F.try_divide(year - first_year, last_year - first_year)),
        "heat_score": F.coalesce(100 * F.col("normalized_heat"), F.lit(0.0)),
        "completeness_score": F.coalesce(100 * F.col("data_completeness"), F.lit(0.0)),
    }
    return compared.select(key, "pos", "car_id", *[_bounded(v).alias(n) for n, v in scores.items()])


def _display(attribute: str) -> Column:
    shown = {
        "price_min_wan": rules.display_price("price_min_wan", "price_max_wan"),
        "sales": F.concat(F.format_number("sales", 0), F.lit(" 辆")),
        "seats": F.concat(F.col("seats").cast("string"), F.lit(" 座")),
        "range_km": F.format_string("%.0f km", F.col("range_km")),
        "horsepower": F.concat(F.col("horsepower").cast("string"), F.lit(" hp")),
        "data_completeness": F.concat(F.round(F.col("data_completeness") * 100).cast("int").cast("string"), F.lit("%")),
    }
    return F.when(F.col(attribute).isNotNull(), shown.get(attribute, F.col(attribute).cast("string")))


def comparison_matrix(compared: DataFrame, key: str = "set_id", missing: str = "—") -> DataFrame:
    """Attributes as rows, positions as columns; an attribute unknown for the whole set is left out."""
    cells = compared.select(
        key,
        "pos",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(order).alias("attribute_no"), F.lit(label).alias("attribute"), _display(name).alias("value")
                    )
                    for order, (label, name) in enumerate(vocab.COMPARISON_ATTRIBUTES)
                ]
            )
        ).alias("cell"),
    ).select(key, "pos", "cell.*")
    sized = F.max("pos").alias("last_pos")
    at = lambda p: F.max(F.when(F.col("pos") == p, F.col("value")))
    wide = cells.groupBy(key, "attribute_no", "attribute").agg(
        sized, *[at(p).alias(f"item_{p + 1}") for p in range(3)]
    )
    known = F.coalesce("item_1", "item_2", "item_3").isNotNull()
    filled = [
        F.when(F.col("last_pos") >= p, F.coalesce(f"item_{p + 1}", F.lit(missing))).alias(f"item_{p + 1}")
        for p in range(3)
    ]
    return wide.filter(known).select(key, "attribute_no", "attribute", *filled)
