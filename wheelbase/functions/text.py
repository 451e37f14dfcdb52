"""Column functions on free text: cleaning, units, numbers, equipment symbols."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace of any kind, the no-break and the ideographic space included.
SPACE = r"[\s\p{Z}]"
# Scripts, styles, comments, tags and declarations; a bare "<" followed by no letter is text.
MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|</?[a-z][^>]*>|<![^>]*>"
# One signed number, then an optional unit.
SINGLE_NUMBER = r"^([-+]?\d+(?:\.\d+)?)\s*(万|%|[A-Za-z]+(?:/[A-Za-z0-9]+)?|公里|小时|秒)?$"
# Unit separator; whitespace to any text rule, and never the result of decoding an entity.
JOINER = "\u001f"
ANY_NUMBER = r"\d+(?:\.\d+)?"
TRAILING_UNIT = r"\(([^()]*)\)\s*$"
# The entities that occur in attribute payloads; the ampersand is replaced last.
COMMON_ENTITIES = (
    ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&copy;", "©"), ("&middot;", "·"), ("&times;", "×"), ("&amp;", "&"),
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(_col(value), f"^{SPACE}+|{SPACE}+$", "")


def nullify_blank(value: Column | str) -> Column:
    return F.nullif(_col(value), F.lit(""))


def unescape_entities(value: Column | str) -> Column:
    """Decode every HTML entity, vectorised over Arrow batches; entity-free batches pass through."""

    def decode(values: pd.Series) -> pd.Series:
        import html

        marked = values.str.contains("&", regex=False, na=False)
        if not marked.any():
            return values
        decoded = values.copy()
        decoded[marked] = values[marked].map(html.unescape)
        return decoded

    return F.pandas_udf(decode, returnType=T.StringType())(_col(value))


def unescape_common(value: Column | str) -> Column:
    """Decode the entities known to occur, without leaving the JVM; most texts hold none."""
    text = decoded = _col(value)
    for entity, character in COMMON_ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(character))
    return F.when(text.contains("&"), decoded).otherwise(text)


def _tidy(decoded: Column) -> Column:
    """Markup dropped, whitespace collapsed, ends trimmed."""
    untagged = F.when(
        decoded.contains("<") & decoded.contains(">"), F.regexp_replace(decoded, MARKUP, " ")
    ).otherwise(decoded)
    # After the collapse only plain single spaces are left at the ends.
    return F.trim(F.regexp_replace(untagged, f"{SPACE}+", " "))


def clean_text(value: Column | str, entities: str = "all") -> Column:
    """Entities decoded, tags dropped, whitespace collapsed, ends trimmed; NULL becomes ''.

    ``entities='common'`` keeps the whole expression in JVM code.
    """
    text = F.coalesce(_col(value), F.lit(""))
    return _tidy(unescape_entities(text) if entities == "all" else unescape_common(text))


def clean_texts(values: Column, entities: str = "all") -> Column:
    """``clean_text`` of every member of an array.

    The members travel to Python as one text per row, joined by a control character that counts as
    whitespace and is therefore replaced by a space inside members first.
    """
    members = F.transform(values, lambda v: F.replace(F.coalesce(v, F.lit("")), F.lit(JOINER), F.lit(" ")))
    if entities == "common":
        return F.transform(members, lambda v: _tidy(unescape_common(v)))
    parts = F.split(unescape_entities(F.array_join(members, JOINER)), JOINER)
    return F.when(F.size(values) > 0, F.transform(parts, _tidy)).otherwise(F.array().cast("array<string>"))


def trailing_unit(name: Column | str) -> Column:
    """Text of the brackets at the end of a name, '' without them."""
    return F.trim(F.regexp_extract(_col(name), TRAILING_UNIT, 1))


def split_unit(name: Column | str) -> tuple[Column, Column]:
    """``最高车速(km/h)`` gives name and unit; a name without trailing brackets is kept as it is."""
    text = _col(name)
    bare = F.when(text.rlike(TRAILING_UNIT), strip(F.regexp_replace(text, TRAILING_UNIT, ""))).otherwise(text)
    return bare, trailing_unit(text)


def single_number_text(value: Column | str) -> Column:
    """The number of a text that is exactly one number, else ''.

    Only texts that begin with a sign or a digit are matched: these sort from ``+`` to before ``:``, which is cheaper to see.
    """
    text = _col(value)
    return F.when((text < "+") | (text >= ":"), F.lit("")).otherwise(F.regexp_extract(text, SINGLE_NUMBER, 1))


def single_number_unit(value: Column | str) -> Column:
    """What follows the number of a text that is exactly one number; the pattern is matched only once."""
    number = single_number_text(value)
    rest = F.ltrim(F.substr(_col(value), F.length(number) + 1))
    return F.when(number != "", rest).otherwise(F.lit(""))


def parse_single_number(value: Column | str) -> tuple[Column, Column]:
    """Number and unit of a text that is exactly one number; composite values give NULL and ''."""
    # Blank becomes NULL before the cast: a failing cast is far slower than a NULL.
    return nullify_blank(single_number_text(value)).try_cast("double"), single_number_unit(value)


def first_number(value: Column | str, strip_separators: bool = True) -> Column:
    """First unsigned decimal.  ``8,709`` is 8709, or 8 with ``strip_separators=False``."""
    text = _col(value)
    if strip_separators:
        text = F.regexp_replace(text, r"(\d),(?=\d{3}(?:\D|$))", "$1")
    return nullify_blank(F.regexp_extract(text, ANY_NUMBER, 0)).try_cast("double")


def number_range(value: Column | str) -> tuple[Column, Column]:
    """Smallest and largest number anywhere in the text, NULL when there is none."""
    found = F.transform(
        F.regexp_extract_all(_col(value), F.lit(f"({ANY_NUMBER})"), F.lit(1)), lambda n: n.cast("double")
    )
    return F.array_min(found), F.array_max(found)


def equipment_state(value: Column | str) -> Column:
    """missing / mixed / standard / optional / value from the fitted and optional symbols."""
    text = _col(value)
    compact = F.replace(text, F.lit(" "), F.lit(""))
    fitted, offered = text.contains("●"), text.contains("○")
    return (
        # Spaces and dashes sort before the full stop, so few texts are looked at without their spaces.
        F.when((text < ".") & compact.isin("", "-", "--"), "missing")
        .when(fitted & offered, "mixed")
        .when(fitted, "standard")
        .when(offered, "optional")
        .otherwise("value")
    )


def parameter_key(group_id: Column | str, group_name: Column | str, name: Column | str) -> Column:
    return F.concat_ws("|", _col(group_id), _col(group_name), _col(name))


def last_digit_in_range(value: Column | str, digits: str = "2-9") -> Column:
    """Last digit of the given class in a free text such as ``●5/7``."""
    return nullify_blank(F.regexp_extract(_col(value), f"([{digits}])[^{digits}]*$", 1)).try_cast("int")


def inferred_series_name(name: Column | str, key: Column | str, first_trim_name: Column | str) -> Column:
    """A name that only repeats the key is replaced by the trim name up to its model-year mark."""
    before_year = strip(F.element_at(F.split(_col(first_trim_name), r"\s+20\d{2}款(?:\s+|$)", 2), 1))
    return F.when(
        _col(name) == _col(key), F.coalesce(nullify_blank(before_year), _col(name))
    ).otherwise(_col(name))


def finite_or_null(value: Column | str) -> Column:
    """A double, or NULL for text that is no number, NaN and the infinities."""
    number = _col(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
