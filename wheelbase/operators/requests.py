"""Batches of preference requests: typed checks, first error per request, normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheelbase import vocab
from wheelbase.functions import text

NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
INTEGER = r"^\s*[-+]?\d+\s*$"
# Normalized fields that decide the answer; equal requests share one evaluation.
SIGNATURE_FIELDS = (
    "budget_min_wan", "budget_max_wan", "body_type", "energy_type", "brands", "scenario", "min_seats", "min_sales",
    "limit",
)
RAW_FIELDS = (
    "budget_min_wan", "budget_max_wan", "body_type", "energy_type", "brands", "scenario", "min_seats", "min_sales",
    "limit", "use_llm",
)


def _number(name: str) -> Column:
    return F.when(F.col(name).rlike(NUMBER), F.col(name).try_cast("double"))


def _integer(name: str) -> Column:
    return F.when(F.col(name).rlike(INTEGER), F.col(name).try_cast("int"))


def _filled(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def _error(code: str, message: str, field: str | None) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(message).alias("message"),
        F.lit(field).cast("string").alias("field"),
        F.lit(400).alias("status"),
    )


def _known(kind: str, field: str | None) -> Column:
    code, message = vocab.ERROR_MESSAGES[kind]
    return _error(code, message, field)


def _checks(columns: list[str]) -> list[tuple[Column, Column]]:
    """(condition, error) in the order the rules are applied."""
    checks: list[tuple[Column, Column]] = []
    if "is_object" in columns:
        checks.append((~F.col("is_object"), _known("json", None)))
    for field, label in vocab.BUDGET_LABELS.items():
        checks += [
            (F.col(field).isNull(), _error("MISSING_FIELD", f"请填写{label}", field)),
            (_number(field).isNull(), _error("INVALID_NUMBER", f"{label}必须是数字", field)),
            (_number(field) <= 0, _error("INVALID_BUDGET", f"{label}必须大于 0", field)),
        ]
    checks.append(
        (_number("budget_min_wan") > _number("budget_max_wan"), _known("budget_order", "budget_min_wan"))
    )
    if "brands_valid" in columns:
        checks.append((~F.col("brands_valid"), _known("brands", "brands")))
    limit = F.when(F.col("limit").isNull(), F.lit(vocab.LIMIT_DEFAULT)).otherwise(_integer("limit"))
    seats, sales = _integer("min_seats"), _integer("min_sales")
    in_limit = F.coalesce(limit.between(vocab.LIMIT_MIN, vocab.LIMIT_MAX), F.lit(False))
    scenario = text.strip(F.coalesce("scenario", F.lit("")))
    checks += [
        (~in_limit, _known("limit", "limit")),
        (_filled("min_seats") & seats.isNull(), _known("seats_integer", "min_seats")),
        (_filled("min_seats") & ~seats.between(vocab.SEATS_MIN, vocab.SEATS_MAX), _known("seats_range", "min_seats")),
        (_filled("min_sales") & (sales.isNull() | (sales < 0)), _known("sales", "min_sales")),
        ((scenario != "") & ~scenario.isin(*vocab.SCENARIOS), _known("scenario", "scenario")),
    ]
    return checks


def validate_requests(raw: DataFrame, key: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Split raw text requests into (normalized valid requests, rejected ones with their first error)."""
    error = F.coalesce(*[F.when(condition, problem) for condition, problem in _checks(raw.columns)])
    checked = raw.withColumn("error", error)
    rejected = checked.filter(F.col("error").isNotNull()).select(key, "error.*")
    return normalize(checked.filter(F.col("error").isNull()), key), rejected


def normalize(requests: DataFrame, key: str = "request_id") -> DataFrame:
    brands = F.array_sort(
        F.array_distinct(
            F.filter(F.transform(F.coalesce("brands", F.array()), text.strip), lambda b: b.isNotNull() & (b != ""))
        )
    )
    return requests.select(
        key,
        F.round(_number("budget_min_wan"), 2).alias("budget_min_wan"),
        F.round(_number("budget_max_wan"), 2).alias("budget_max_wan"),
        *[text.strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("body_type", "energy_type")],
        brands.alias("brands"),
        text.strip(F.coalesce("scenario", F.lit(""))).alias("scenario"),
        _integer("min_seats").alias("min_seats"),
        _integer("min_sales").alias("min_sales"),
        F.coalesce(_integer("limit"), F.lit(vocab.LIMIT_DEFAULT)).alias("limit"),
        F.coalesce(F.col("use_llm").cast("boolean"), F.lit(False)).alias("use_llm")
        if "use_llm" in requests.columns
        else F.lit(False).alias("use_llm"),
    )


def requests_from_json(df: DataFrame, body: str, key: str = "request_id") -> DataFrame:
    """JSON bodies to the raw text form; JSON types are judged before they become text."""
    document = F.try_parse_json(F.col(body))
    parsed = df.select(key, document.alias("v"))
    kind = lambda path: F.coalesce(
        F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("ABSENT")
    )
    as_text = lambda path: F.try_variant_get("v", path, "string")
    is_bool = lambda path: kind(path) == "BOOLEAN"
    whole = lambda path: F.when(
        kind(path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"),
        F.try_variant_get("v", path, "double").try_cast("bigint").cast("string"),
    ).otherwise(as_text(path))
    brands = F.try_variant_get("v", "$.brands", "array<string>")
    falsy = kind("$.brands").isin("ABSENT", "VOID") | as_text("$.brands").isin("", "0", "false")
    listed = kind("$.brands").isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(
        F.exists(brands, lambda b: b.isNull()), F.lit(False)
    )
    return parsed.select(
        key,
        F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("is_object"),
        *[F.when(~is_bool(f"$.{c}"), as_text(f"$.{c}")).alias(c) for c in vocab.BUDGET_LABELS],
        as_text("$.body_type").alias("body_type"),
        as_text("$.energy_type").alias("energy_type"),
        F.when(~falsy, brands).alias("brands"),
        (falsy | listed).alias("brands_valid"),
        as_text("$.scenario").alias("scenario"),
        F.when(is_bool("$.min_seats"), F.try_variant_get("v", "$.min_seats", "boolean").cast("int").cast("string"))
        .otherwise(whole("$.min_seats"))
        .alias("min_seats"),
        whole("$.min_sales").alias("min_sales"),
        F.when(kind("$.limit") == "ABSENT", F.lit(None).cast("string"))
        .otherwise(F.coalesce(whole("$.limit"), F.lit("")))
        .alias("limit"),
        F.coalesce(F.try_variant_get("v", "$.use_llm", "boolean"), F.lit(False)).alias("use_llm"),
    )


def signature(fields=SIGNATURE_FIELDS) -> Column:
    """Digest of the deciding fields; equal requests have equal signatures."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
