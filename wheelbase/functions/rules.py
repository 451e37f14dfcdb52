"""Column functions driven by rule tables: classes, ranges, tags, identifiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wheelbase import vocab


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)


def first_match(branches: Sequence[tuple[Column, object]], default: Column | None = None) -> Column:
    """CASE WHEN over (condition, value) pairs; the first true condition decides."""
    (condition, value), *rest = branches
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain if default is None else chain.otherwise(default)


def classify_keywords(value: Column | str, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """Class of the first rule with a keyword inside the lower-cased text, NULL without a hit."""
    text = F.lower(F.trim(_col(value)))
    return first_match([(any_of([text.contains(word) for word in words]), label) for words, label in rules])


def classify_body(
    level: Column | str, structure: Column | str, rules: Sequence[tuple[str, str, str]] = vocab.BODY_RULES
) -> Column:
    sides = {"level": _col(level), "structure": _col(structure)}
    branches = [(sides[side].rlike(pattern), label) for side, pattern, label in rules]
    return first_match(branches, F.trim(sides["structure"]))


def null_out_of_range(
    value: Column | str, low=None, high=None, exclusive_low: bool = False
) -> Column:
    """Keep a value inside its valid range, NULL outside."""
    column = _col(value)
    checks = []
    if low is not None:
        checks.append(column > low if exclusive_low else column >= low)
    if high is not None:
        checks.append(column <= high)
    return F.when(reduce(lambda a, b: a & b, checks), column)


def repair_upper_bound(upper: Column | str, lower: Column | str) -> Column:
    """An upper bound below its lower bound, or missing, becomes the lower bound."""
    return F.when(_col(upper) >= _col(lower), _col(upper)).otherwise(_col(lower))


def stable_id(key: Column | str, prefix: str = "car_", digits: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(_col(key), 256), 1, digits))


def price_mid(low: Column | str, high: Column | str) -> Column:
    return F.round((_col(low) + _col(high)) / 2, 2)


def tags_from_rules(rules: Sequence[tuple[str, Column]]) -> Column:
    """Array of the labels whose condition is true; unknown conditions add nothing."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(label)) for label, condition in rules]))


def scenario_rules() -> list[tuple[str, Column]]:
    energy, fuel, reach = F.col("energy_type"), F.col("fuel_consumption"), F.col("range_km")
    hybrid = energy.isin(*vocab.HYBRID_CLASSES)
    return [
        (
            vocab.SCENARIO_CITY,
            (energy == vocab.PURE_ELECTRIC) | hybrid | (fuel <= vocab.CITY_FUEL_LIMIT),
        ),
        (
            vocab.SCENARIO_FAMILY,
            (F.col("seats") >= vocab.FAMILY_SEATS) & F.col("body_type").isin(*vocab.FAMILY_BODIES),
        ),
        (vocab.SCENARIO_LONG, (energy == vocab.COMBUSTION) | hybrid | (reach >= vocab.LONG_RANGE_KM)),
    ]


def scenario_tags() -> Column:
    return tags_from_rules(scenario_rules())


def completeness(
    columns: Sequence[str] = vocab.COMPLETENESS_FIELDS, base: int = vocab.COMPLETENESS_BASE
) -> Column:
    """Share of known fields: ``base`` mandatory ones plus the filled optional ones, 2 decimals."""
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    return F.round((F.lit(base) + filled) / F.lit(base + len(columns)), 2)


def split_tags(value: Column | str) -> Column:
    """Pipe-joined text back to an array without empty members."""
    return F.filter(F.split(F.coalesce(_col(value), F.lit("")), r"\|"), lambda tag: tag != "")


def display_price(low: Column | str, high: Column | str) -> Column:
    low_text = F.format_string("%.2f", _col(low))
    high_text = F.format_string("%.2f", F.coalesce(_col(high), _col(low)))
    return F.when(low_text == high_text, F.concat(low_text, F.lit(" 万"))).otherwise(
        F.concat(low_text, F.lit("—"), high_text, F.lit(" 万"))
    )


def display_sales(sales: Column | str, period: Column | str) -> Column:
    prefix = F.coalesce(F.concat(F.nullif(_col(period), F.lit("")), F.lit(" · ")), F.lit(""))
    text = F.concat(prefix, F.lit("月销量 "), F.format_number(_col(sales), 0), F.lit(" 辆"))
    return F.when(_col(sales).isNull(), "月销量暂无数据").otherwise(text)
