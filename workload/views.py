"""The catalog tables derived from the given tables.

Parts act as series, their line items as trims, the trims' columns as long attributes, months of line
items as measures, customers as requesters.  Missing and malformed cases are derived from the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelbase import vocab
from wheelbase.functions import rules, text
from wheelbase.operators import catalog, features, ingest, quality
from wheelbase.sources.tables import spread_rows

LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)
CAPTURED = "2026-07-10"
ENERGY_TEXTS = ("汽油", "柴油", "纯电动", "插电式混合动力", "增程式电动", "油电混合", "非插电式混合动力", "氢燃料电池", "PHEV")
STRUCTURES = {"ECONOMY": "两厢车", "LARGE": "三厢车", "MEDIUM": "SUV", "PROMO": "-", "SMALL": "掀背", "STANDARD": " 三厢车 "}
LEVELS = {"ECONOMY": "紧凑型车", "LARGE": "中大型MPV", "MEDIUM": "紧凑型SUV", "PROMO": "跑车", "SMALL": "小型车", "STANDARD": "其他"}
BODIES = {"ECONOMY": "轿车", "LARGE": "MPV", "MEDIUM": "SUV", "PROMO": "跑车", "SMALL": "两厢车", "STANDARD": "SUV"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_type(labels: dict[str, str]) -> Column:
    return rules.first_match([(F.col("p_type") == kind, label) for kind, label in labels.items()])


def text_at(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def sold(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their part."""
    return spread_rows(table(spark, sf, "lineitem").select(*LINE_COLUMNS)).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))


def trim_id() -> Column:
    return F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"))


def series_id(key: str = "l_partkey") -> Column:
    return F.col(key).cast("string")


def trims(spark: SparkSession, sf: str) -> DataFrame:
    year = F.year("l_shipdate")
    seats = (
        F.when(F.col("p_size") % 10 == 0, "5/7座")
        .when(F.col("p_size") % 10 == 9, "-")
        .otherwise(F.concat(F.lit("●"), (2 + F.col("p_size") % 9).cast("string")))
    )
    return sold(spark, sf).select(
        trim_id().alias("trim_id"),
        series_id().alias("series_id"),
        F.concat("p_name", F.lit(" "), year.cast("string"), F.lit("款")).alias("trim_name"),
        year.alias("model_year"),
        text_at(ENERGY_TEXTS, (F.col("l_partkey") + F.col("l_linenumber") % 2) % 9).alias("energy_type_raw"),
        by_type(STRUCTURES).alias("body_structure"),
        seats.alias("seats_raw"),
    )


def _digits(number: Column, scale: int) -> Column:
    """Whole number as decimal text with ``scale`` decimals."""
    unit = F.lit(10**scale)
    return F.concat(
        F.floor(number / unit).cast("string"), F.lit("."), F.lpad((number % unit).cast("string"), scale, "0")
    )


def raw_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Nine attributes per line item, values as the raw text of a payload.

    The line item is repeated by the attribute's number before any text is made, so a job that asks for some attributes makes the texts of these only.
    """
    line = F.col("l_linenumber").cast("string")
    quantity = F.col("l_quantity").cast("bigint")
    symbol = (
        F.when(F.col("l_discount") >= 0.095, "主：●&nbsp;副：○")
        .when(F.col("l_returnflag") == "A", "●")
        .when(F.col("l_returnflag") == "N", "○")
        .otherwise("-")
    )
    price = F.when(F.col("l_linenumber") == 7, "暂无报价").otherwise(
        F.concat(_digits(F.floor(F.col("l_extendedprice") / 50), 2), F.lit("万"))
    )
    fuel = F.when(F.col("l_tax") >= 0.075, "").otherwise(_digits(quantity * 2 + 30, 1))
    gauge = F.when(F.col("l_discount").between(0.045, 0.055), "12×34").otherwise(
        F.concat((F.round(F.col("l_tax") * 100).cast("bigint") + quantity).cast("string"), F.lit("%"))
    )
    status = F.col("l_linestatus")
    cells = [
        (F.lit("0"), F.lit("基本参数"), F.lit("厂商"), F.when(F.col("l_suppkey") % 50 == 0, "-").otherwise(F.col("p_brand"))),
        (F.lit("0"), F.lit("基本参数"), F.lit("级别"), by_type(LEVELS)),
        (F.lit("0"), F.lit("基本参数"), F.lit("厂商指导价(元)"), price),
        (F.lit("1"), F.lit("发动机"), F.lit("工信部综合油耗(L)"), fuel),
        (F.lit("1"), F.lit("发动机"), F.lit("最大马力(Ps)"), (quantity * 9).cast("string")),
        (F.lit("0"), F.lit("基本参数"), F.lit("车款人气"), F.col("l_suppkey").cast("string")),
        (line, F.concat(F.lit("装备"), line), F.concat(F.lit("配置"), status), symbol),
        (line, F.concat(F.lit("性能"), line), F.concat(F.lit("指标"), status, F.lit("(%)")), gauge),
        (F.lit("9"), F.lit("外观"), F.lit("颜色"), text_at(("红", "白", "黑"), F.year("l_shipdate") % 3)),
    ]
    names = ("group_id", "group_name", "parameter_name", "value_raw")
    repeated = sold(spark, sf).withColumn("_cell", F.explode(F.array(*[F.lit(i) for i in range(len(cells))])))
    of_cell = lambda k: rules.first_match([(F.col("_cell") == i, cell[k]) for i, cell in enumerate(cells)])
    return repeated.select(trim_id().alias("trim_id"), series_id().alias("series_id"), *[of_cell(k).alias(n) for k, n in enumerate(names)])


def attributes(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """Long attribute table in the shape the jobs read.

    For a job that takes all columns of it (``whole``), the raw and the clean texts are each made behind a one-element generator: a row of all columns
    from one piece of code takes Spark more than twice as long. Jobs that take some columns and rows would make more texts than they need that way.
    """
    once = lambda frame, *names: frame.select(*[c for c in frame.columns if c not in names], F.inline(F.array(F.struct(*names)))).select(*frame.columns)
    raw = raw_attributes(spark, sf)
    if whole:
        raw = once(raw, "group_id", "group_name", "parameter_name", "value_raw")
    raw = raw.withColumn("value_text", text.clean_text("value_raw", "common"))
    if whole:
        raw = once(raw, "value_text")
    keyed = raw.withColumn("parameter_key", text.parameter_key("group_id", "group_name", "parameter_name"))
    return ingest.decode_values(keyed)


def measures(spark: SparkSession, sf: str) -> DataFrame:
    months = table(spark, sf, "lineitem").groupBy(
        "l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("sales_period")
    ).agg(F.sum("l_quantity").cast("int").alias("total"))
    return months.select(
        series_id().alias("series_id"), "sales_period", F.when(F.col("l_partkey") % 17 != 0, F.col("total")).alias("sales")
    )


def list_prices() -> tuple[Column, Column]:
    low = F.round((F.col("p_retailprice") - 895) * 0.5, 2)
    return low, F.round(low + (F.col("p_size") % 5) * 0.5, 2)


def series(spark: SparkSession, sf: str) -> DataFrame:
    low, high = list_prices()
    link = lambda tail: F.concat(F.lit("https://catalog.example/"), series_id("p_partkey"), F.lit(tail))
    return table(spark, sf, "part").select(
        series_id("p_partkey").alias("series_id"),
        F.concat("p_name", F.lit(" "), series_id("p_partkey")).alias("series_name"),
        low.alias("list_price_min_wan"),
        high.alias("list_price_max_wan"),
        by_type(LEVELS).alias("body_hints"),
        link("/").alias("source_url"),
        link("/options/").alias("options_url"),
        link("/sales/").alias("sales_url"),
        F.lit(CAPTURED).alias("captured_at"),
    )


def assembled(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.assemble(series(spark, sf), trims(spark, sf), attributes(spark, sf), measures(spark, sf))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog straight from the parts; all quantities sold are the measure, the last month sold in its period."""
    sales = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").cast("int").alias("sales"), F.date_format(F.max("l_shipdate"), "yyyy-MM").alias("sales_period"))
    low, high = list_prices()
    key, size = F.col("p_partkey"), F.col("p_size")
    energy = text_at(vocab.ENERGY_CLASSES, key % 5)
    base = (
        table(spark, sf, "part")
        .join(sales, F.col("p_partkey") == F.col("l_partkey"), "left")
        .select(
            rules.stable_id(F.concat(F.lit("p-"), series_id("p_partkey"))).alias("car_id"),
            F.concat("p_name", F.lit(" "), series_id("p_partkey")).alias("model_name"),
            F.col("p_brand").alias("brand"),
            low.alias("price_min_wan"),
            high.alias("price_max_wan"),
            rules.price_mid(low, high).alias("price_mid_wan"),
            by_type(BODIES).alias("body_type"),
            energy.alias("energy_type"),
            rules.null_out_of_range(size % 10, 2, 9).alias("seats"),
            F.when(energy == vocab.PURE_ELECTRIC, (300 + size * 10).cast("double")).alias("range_km"),
            F.when(energy != vocab.PURE_ELECTRIC, 5 + (size % 8) / 2).alias("fuel_consumption"),
            F.when(size % 7 != 0, 80 + size * 7).alias("horsepower"),
            F.when(size % 11 != 0, 2015 + size % 12).alias("model_year"),
            "sales",
            "sales_period",
        )
    )
    return base.withColumns(
        {
            "normalized_heat": catalog.log_heat(base),
            "scenario_tags": rules.scenario_tags(),
            "data_completeness": rules.completeness(),
        }
    )


def raw_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Text requests of all customers; some are malformed, some have narrow or empty bands."""
    k, balance = F.col("c_custkey"), F.abs(F.col("c_acctbal")).cast("bigint")
    low = (3 + balance % 45).cast("string")
    high = (4 + balance % 45 + k % 6).cast("string")
    pick = lambda values: text_at(values, (balance + F.col("c_nationkey")) % len(values))
    brand = lambda n: F.concat(F.lit("Brand#"), (1 + n % 25).cast("string"))
    return table(spark, sf, "customer").select(
        k.alias("request_id"),
        F.when(k % 31 == 0, F.lit(None))
        .when(k % 37 == 0, "abc")
        .when(k % 41 == 0, "-5")
        .when(k % 29 == 0, "90")
        .when(k % 19 == 0, "2.0")
        .when(k % 61 == 0, "1")
        .otherwise(low)
        .alias("budget_min_wan"),
        F.when(k % 29 == 0, high).when(k % 19 == 0, "2.45").when(k % 61 == 0, "1.5").otherwise(high).alias("budget_max_wan"),
        F.when(k % 3 == 0, "").otherwise(pick(("SUV", "MPV", "轿车", " 跑车 ", "两厢车"))).alias("body_type"),
        F.when(k % 2 == 0, F.lit(None).cast("string")).otherwise(pick(vocab.ENERGY_CLASSES)).alias("energy_type"),
        F.when(k % 3 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(brand(k), brand(k * 7), brand(k), F.lit(" ")))
        .alias("brands"),
        F.when(k % 53 == 0, "越野").otherwise(text_at((*vocab.SCENARIOS, ""), k % 4)).alias("scenario"),
        F.when(k % 43 == 0, "12").when(k % 4 == 0, "5").otherwise("").alias("min_seats"),
        F.when(k % 47 == 0, "-1").when(k % 5 == 0, (k % 1200).cast("string")).alias("min_sales"),
        F.when(k % 23 == 0, "9").when(k % 7 == 0, F.lit(None)).otherwise((3 + k % 3).cast("string")).alias("limit"),
        F.lit(False).alias("use_llm"),
    )


def comparison_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Two or three parts per customer; some sets have a wrong size, repeated or unknown members."""
    k = F.col("c_custkey")
    item = lambda offset: rules.stable_id(F.concat(F.lit("p-"), (k + offset).cast("string")))
    return table(spark, sf, "customer").select(
        k.alias("set_id"),
        F.when(k % 17 == 0, F.array(item(0)))
        .when(k % 13 == 0, F.array(item(0), item(1), item(2), item(3)))
        .when(k % 11 == 0, F.array(item(0), item(0)))
        .when(k % 7 == 0, F.array(item(0), F.lit("car_unknown")))
        .when(k % 2 == 0, F.array(item(0), item(25)))
        .otherwise(F.array(item(0), item(1), item(2)))
        .alias("car_ids"),
    )


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify_parameters(quality.parameter_quality(attributes(spark, sf), exact_distinct=True))


def long_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.build_features(attributes(spark, sf), quality.feature_mapping(classified(spark, sf)))


def target(spark: SparkSession, sf: str) -> DataFrame:
    return features.build_target(measures(spark, sf))


def controls(spark: SparkSession, sf: str) -> DataFrame:
    return features.build_controls(attributes(spark, sf), trims(spark, sf))
