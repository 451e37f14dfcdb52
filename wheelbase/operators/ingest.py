"""Stored responses to normalized tables: JSON payloads, HTML tables and listings."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wheelbase import schemas, vocab
from wheelbase.functions import text

KEY_PATTERN = r"^\d+$"
PERIOD_PATTERN = r"^20\d{2}-\d{2}$"

# target column <- member of the payload's item struct
TRIM_MEMBERS = {
    "trim_name": "car_name", "model_year": "decade", "status": "status", "energy_type_raw": "fueltype",
    "displacement": "displacement", "transmission": "transmission", "drive_style": "driveStyle",
    "body_structure": "body_structure", "seats_raw": "seatnum",
}
MEASURE_CELLS = ("overall_rank", "manufacturer_share", "manufacturer_rank", "segment_rank", "registration_related")


def _link(template: str, key: Column) -> Column:
    before, after = template.split("{id}")
    return F.concat(F.lit(before), key, F.lit(after))


# ------------------------------------------------------------------ JSON payloads
def parse_payloads(responses: DataFrame, body: str = "body") -> DataFrame:
    """Parse ``(series_id, body)``; ``problem`` names what is wrong, NULL for a usable payload.

    A payload whose ``ret`` is not ``ok`` is usable and simply has no items.  The closer look runs only
    for documents the typed parse complains about.
    """
    document = F.col(body)
    schema = schemas.OPTIONS_PAYLOAD + ", broken string"
    parsed = F.from_json(document, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    # A one-element generator: filters on the parsed value stay above it, so each document is parsed once.
    once = responses.select("series_id", F.col(body).alias("_body"), F.inline(F.array(F.struct(parsed.alias("payload")))))
    document, payload = F.col("_body"), F.col("payload")

    def misshapen(path: str, opening: str) -> Column:
        return F.coalesce(~F.get_json_object(document, path).startswith(opening), F.lit(False))

    unreadable = F.coalesce(~F.ltrim(document).startswith("{"), F.lit(True)) | (
        payload["broken"].isNotNull() & F.try_parse_json(document).isNull()
    )
    bad_shape = payload["broken"].isNotNull() & (
        misshapen("$.data", "{") | misshapen("$.data.arrCar", "[") | misshapen("$.data.arrConfig", "{")
    )
    accepted = F.coalesce(payload["ret"] == "ok", F.lit(False))
    judged = F.struct(
        F.when(accepted, payload["data"]).alias("data"),
        F.when(unreadable, "load-options").when(accepted & bad_shape, "parse-options").alias("problem"),
    )
    return once.select("series_id", F.inline(F.array(judged)))


def _items(data: Column) -> Column:
    """Items with a key, in payload order; positions are counted after keyless items are dropped."""
    return F.filter(
        data["arrCar"], lambda item: F.coalesce(text.strip(item["car_id"]), F.lit("")) != ""
    )


def explode_trims(
    payloads: DataFrame, captured_at: str, links: vocab.SiteLinks = vocab.SiteLinks(), entities: str = "all"
) -> DataFrame:
    """One row per payload item, every field cleaned."""
    rows = payloads.filter(F.col("problem").isNull()).select(
        "series_id", F.explode(_items(F.col("data"))).alias("item")
    )
    members = F.array(*[F.col(f"item.{member}") for member in TRIM_MEMBERS.values()])
    cleaned = rows.select(
        "series_id", text.strip(F.col("item.car_id")).alias("trim_id"), text.clean_texts(members, entities).alias("texts")
    )
    return cleaned.select(
        "trim_id",
        "series_id",
        *[F.col("texts")[position].alias(name) for position, name in enumerate(TRIM_MEMBERS)],
        _link(links.trim, F.col("trim_id")).alias("options_url"),
        F.lit(captured_at).alias("captured_at"),
    )


def _parameter_lists(payloads: DataFrame) -> DataFrame:
    """One row per payload, group and parameter, still holding the whole value list."""
    groups = payloads.filter(F.col("problem").isNull()).select(
        "series_id",
        F.transform(_items(F.col("data")), lambda item: text.strip(item["car_id"])).alias("trim_ids"),
        F.explode("data.arrConfig").alias("group_id", "named"),
    )
    fields = groups.select("series_id", "trim_ids", "group_id", F.explode("named").alias("raw_group", "fields"))
    lists = fields.select(
        "series_id", "trim_ids", "group_id", "raw_group", F.explode("fields").alias("raw_name", "cells")
    )
    return lists.filter(F.col("cells").isNotNull())


def explode_parameters(payloads: DataFrame, captured_at: str, entities: str = "all") -> DataFrame:
    """Group, name and the i-th value paired with the i-th item; short lists are padded with ''.

    Names and values are cleaned once per list, before the list is paired with the items.
    """
    lists = _parameter_lists(payloads)
    names = F.array("raw_group", "raw_name")
    if entities == "common":
        # Apart, so that who asks for the names only does not clean the values. Python gets one text per list.
        cleaned = {"names": text.clean_texts(names, entities), "texts": text.clean_texts(F.col("cells"), entities)}
    else:
        cleaned = {"texts": text.clean_texts(F.concat(names, F.col("cells")), entities)}
    head, first = ("names", 0) if "names" in cleaned else ("texts", 2)
    paired = lists.select("series_id", "group_id", "cells", "trim_ids", *[c.alias(name) for name, c in cleaned.items()]).select(
        "series_id", "group_id", "cells", *cleaned, F.posexplode("trim_ids").alias("position", "trim_id")
    )
    named = paired.select(
        "trim_id",
        "series_id",
        "group_id",
        F.col(head)[0].alias("group_name"),
        F.col(head)[1].alias("parameter_name"),
        F.coalesce(F.get("cells", F.col("position")), F.lit("")).alias("value_raw"),
        F.coalesce(F.get("texts", F.col("position") + first), F.lit("")).alias("value_text"),
    )
    return decode_values(named).select(
        "trim_id",
        "series_id",
        text.parameter_key("group_id", "group_name", "parameter_name").alias("parameter_key"),
        "group_id",
        "group_name",
        "parameter_name",
        "value_raw",
        "value_text",
        "value_numeric",
        "value_unit",
        "equipment_state",
        F.lit(captured_at).alias("captured_at"),
    )


def decode_values(rows: DataFrame) -> DataFrame:
    """``value_text`` to number, unit (own unit first, then the declared one) and equipment state."""
    number, unit = text.parse_single_number("value_text")
    declared = text.trailing_unit("parameter_name")
    return rows.withColumns(
        {
            "value_numeric": number,
            "value_unit": F.when(unit != "", unit).otherwise(declared),
            "equipment_state": text.equipment_state("value_text"),
        }
    )


def parameter_definitions(parameters: DataFrame) -> DataFrame:
    """Distinct parameter keys with group, name and the unit in the name's brackets."""
    distinct = parameters.select("parameter_key", "group_id", "group_name", "parameter_name").dropDuplicates(
        ["parameter_key"]
    )
    return distinct.withColumn("declared_unit", text.trailing_unit("parameter_name"))


# ------------------------------------------------------------------ HTML pages
def _table_cells(html: Column | str) -> Column:
    """Rows of the page's first table, each an array of its ``td`` texts."""

    def read(pages: pa.Array) -> pa.Array:
        import re
        from html import unescape
        from html.parser import HTMLParser

        blank = r"[ \t\n\r\f]"
        value = r"""(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`/]+)"""
        # A tag as it should be: it ends at its first ">". Other uses of "<" are left to the parser.
        name, given = r"[a-zA-Z][a-zA-Z0-9]*+", rf"(?:{blank}++[a-zA-Z_:][-\w:.]*+(?:{blank}*+={blank}*+{value})?+)*+"
        plain_tag = re.compile(rf"<(/{name}(?={blank}*+>)|{name}){given}{blank}*+(/?)>")
        table, row, data, other_end, table_end, raw = range(1, 7)
        # The content of the raw ones is no markup, or is none in some versions of the parser.
        texts_only = ("script", "style", "textarea", "title", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript")
        kinds = {"table": table, "tr": row, "td": data, "/tr": other_end, "/td": other_end, "/table": table_end, **dict.fromkeys(texts_only, raw)}

        def plain_rows(page):
            """(rows as ``FirstTable`` finds them, whether the table ended), several times as fast, or None for a page that has to be parsed with care."""
            parts = plain_tag.split(page)
            if page.count("<") != len(parts) // 3:
                return None
            depth, found, cell = 0, [], None
            for text, tag, empty in zip(parts[::3], parts[1::3], parts[2::3]):
                if cell is not None and (text := (unescape(text) if "&" in text else text).strip()):
                    cell.append(text)
                kind = kinds.get(tag.lower())
                if not kind:
                    continue
                if empty or kind == raw:
                    return None
                if cell is not None and kind != table:
                    if found:
                        found[-1].append(" ".join(cell))
                    cell = None
                if kind == table:
                    depth += 1
                elif kind == table_end and depth:
                    depth -= 1
                    if not depth:
                        return found, True
                elif kind == row and depth:
                    found.append([])
                elif kind == data and depth:
                    cell = []
            if cell is not None and found:
                if text := unescape(parts[-1]).strip():
                    cell.append(text)
                found[-1].append(" ".join(cell))
            return found, False

        class FirstTable(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.depth, self.done, self.rows, self.cell = 0, False, [], None

            def handle_starttag(self, tag, attrs):
                if self.done:
                    return
                if tag == "table":
                    self.depth += 1
                elif self.depth and tag == "tr":
                    self.close_cell()
                    self.rows.append([])
                elif self.depth and tag == "td":
                    self.close_cell()
                    self.cell = []

            def handle_endtag(self, tag):
                if tag in ("td", "tr", "table"):
                    self.close_cell()
                if tag == "table" and self.depth:
                    self.depth -= 1
                    self.done = self.depth == 0

            def handle_data(self, data):
                if self.cell is not None and data.strip():
                    self.cell.append(data.strip())

            def close_cell(self):
                if self.cell is not None and self.rows:
                    self.rows[-1].append(" ".join(self.cell))
                self.cell = None

        def rows(page):
            page = page or ""
            # What stands behind the first table changes nothing; with a table inside it, the first end is not its own.
            head, end, _ = page.partition("</table>")
            found = plain_rows(head + end)
            if found and end and not found[1]:
                found = plain_rows(page)
            if found:
                return found[0]
            parser = FirstTable()
            parser.feed(page)
            parser.close()
            parser.close_cell()
            return parser.rows

        # Flat lists and where they are cut: lists of lists would be looked through value by value.
        row_ends, cell_ends, cells = [0], [0], []
        for page in pages.to_pylist():
            for found in rows(page):
                cells += found
                cell_ends.append(len(cells))
            row_ends.append(len(cell_ends) - 1)
        found = pa.ListArray.from_arrays(pa.array(cell_ends, pa.int32()), pa.array(cells, pa.string()))
        return pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), found)

    column = F.col(html) if isinstance(html, str) else html
    return F.arrow_udf(read, returnType=T.ArrayType(T.ArrayType(T.StringType())))(column)


def html_table_rows(
    pages: DataFrame,
    captured_at: str,
    html: str = "html",
    links: vocab.SiteLinks = vocab.SiteLinks(),
    strip_separators: bool = True,
) -> DataFrame:
    """Monthly rows of the first table: period in cell 0, measure in cell 1, five optional cells.

    A measure too large for its column is open; ``measure_failures`` names its page.
    """
    return monthly_rows(page_cells(pages, html), captured_at, links, strip_separators)


def page_cells(pages: DataFrame, html: str = "html") -> DataFrame:
    """(series_id, cells) of every table row that starts with a period; the one step that reads the pages."""
    cells = pages.select("series_id", F.explode(_table_cells(html)).alias("cells"))
    return cells.filter((F.size("cells") >= 2) & F.get("cells", F.lit(0)).rlike(PERIOD_PATTERN))


def measure_failures(cells: DataFrame, strip_separators: bool = True) -> DataFrame:
    """One row per series that has a measure no integer column can hold."""
    number = text.first_number(F.get("cells", F.lit(1)), strip_separators)
    bad = cells.filter(number.isNotNull() & number.try_cast("int").isNull())
    return bad.select("series_id").distinct().withColumn("failure", F.lit("parse-sales"))


def monthly_rows(cells: DataFrame, captured_at: str, links: vocab.SiteLinks = vocab.SiteLinks(), strip_separators: bool = True) -> DataFrame:
    optional = [
        F.coalesce(F.get("cells", F.lit(position)), F.lit("")).alias(name)
        for position, name in enumerate(MEASURE_CELLS, start=2)
    ]
    return cells.select(
        "series_id",
        F.get("cells", F.lit(0)).alias("sales_period"),
        text.first_number(F.get("cells", F.lit(1)), strip_separators).try_cast("int").alias("sales"),
        *optional,
        _link(links.sales, F.col("series_id")).alias("sales_url"),
        F.lit(captured_at).alias("captured_at"),
    )


def page_links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Anchors of a page with their text, in page order, by JVM regular expressions."""
    anchor = r'(?s)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    found = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(anchor), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(anchor), F.lit(2)).alias("inner"),
    )
    return pages.select(key, F.posexplode(found).alias("pos", "link")).select(
        key, "pos", F.col("link.href").alias("href"), text.clean_text("link.inner", "common").alias("label")
    )


def _listing_items(html: Column | str, links: vocab.SiteLinks) -> Column:
    """(category, id, name, price text) of every linked item inside a titled listing box, in page order."""
    series_pattern, price_mark = links.series_link_pattern, links.price_link_mark
    fields = ("category", "series_id", "name", "price_text")

    def read(pages: pd.Series) -> pd.Series:
        import re
        from html.parser import HTMLParser

        void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}

        class Listing(HTMLParser):
            """Follows the element stack; a box belongs to the title element right before it."""

            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.stack, self.items = [], []
                self.title = self.category = self.box_level = self.title_level = None
                self.item = self.link = None

            def handle_starttag(self, tag, attrs):
                if tag in void:
                    return
                attrs = dict(attrs)
                classes = (attrs.get("class") or "").split()
                self.stack.append(tag)
                level = len(self.stack)
                if tag == "div" and "brand_title" in classes:
                    self.title, self.title_level = [], level
                elif tag == "div" and "brand_box" in classes and self.category is not None and level == self.title_level:
                    self.box_level = level
                elif tag == "li" and self.box_level is not None:
                    self.item = {"links": []}
                elif tag == "a" and self.item is not None and "href" in attrs:
                    self.link = (attrs["href"] or "", [])

            def handle_endtag(self, tag):
                if tag not in self.stack:
                    return
                while self.stack:
                    level, closed = len(self.stack), self.stack.pop()
                    if self.title is not None and level == self.title_level:
                        self.category, self.title = " ".join(self.title), None
                    if level == self.box_level:
                        self.box_level = self.category = None
                    if closed == "a" and self.link is not None:
                        self.item["links"].append((self.link[0], " ".join(self.link[1])))
                        self.link = None
                    if closed == "li" and self.item is not None:
                        self.finish_item()
                    if closed == tag:
                        break

            def handle_data(self, data):
                piece = data.strip()
                if not piece:
                    return
                if self.title is not None:
                    self.title.append(piece)
                if self.link is not None:
                    self.link[1].append(piece)

            def finish_item(self):
                anchors, self.item = self.item["links"], None
                own = next(((m, t) for h, t in anchors if (m := re.fullmatch(series_pattern, h)) and t), None)
                price = next((t for h, t in anchors if price_mark in h), "")
                if own:
                    values = (self.category, own[0].group(1), own[1], price)
                    self.items.append(dict(zip(fields, values)))

        def items(page):
            parser = Listing()
            parser.feed(page or "")
            parser.close()
            return parser.items

        return pages.map(items)

    column = F.col(html) if isinstance(html, str) else html
    item = T.StructType([T.StructField(name, T.StringType()) for name in fields])
    return F.pandas_udf(read, returnType=T.ArrayType(item))(column)


def html_listing(
    pages: DataFrame,
    limits: Mapping[str, int],
    hint: str,
    html: str = "html",
    links: vocab.SiteLinks = vocab.SiteLinks(),
) -> DataFrame:
    """Priced items of the listed categories, at most ``limits[category]`` per page and category.

    ``pages`` needs ``page_no``; the result carries ``(page_no, pos)`` as its order.
    """
    found = pages.select("page_no", F.posexplode(_listing_items(html, links)).alias("pos", "item"))
    low, high = text.number_range("item.price_text")
    rows = found.select(
        "page_no", "pos", "item.category", "item.series_id", "item.name",
        low.alias("list_price_min"), high.alias("list_price_max"), F.lit(hint).alias("hint_type"),
    ).filter(F.col("category").isin(*limits) & F.col("list_price_min").isNotNull())
    return top_n_per_category(rows, limits)


def top_n_per_category(
    rows: DataFrame,
    limits: Mapping[str, int],
    partition: tuple[str, ...] = ("page_no", "category"),
    order: tuple[str, ...] = ("pos",),
    category: str = "category",
) -> DataFrame:
    """The first ``limits[category]`` rows of each partition.

    The constant bound lets Spark cut every map task to the largest limit before the shuffle.
    """
    window = Window.partitionBy(*partition).orderBy(*order)
    own_limit = F.create_map(*[F.lit(part) for pair in limits.items() for part in pair])[F.col(category)]
    numbered = rows.withColumn("_n", F.row_number().over(window))
    return numbered.filter(F.col("_n") <= max(limits.values())).filter(F.col("_n") <= own_limit).drop("_n")


def merge_candidates(listings: list[DataFrame]) -> DataFrame:
    """Union of listings; the first occurrence gives name and price, hints are united.

    Listing number, page and position form one global order, so the result does not depend on task order.
    """
    union = None
    for number, frame in enumerate(listings):
        part = frame.withColumn("_list", F.lit(number))
        union = part if union is None else union.unionByName(part)
    order = F.struct("_list", "page_no", "pos")

    def hints(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("hint_type") == kind, F.col("category"))))

    first = F.min_by(F.struct("name", "list_price_min", "list_price_max"), order)
    return (
        union.groupBy("series_id")
        .agg(first.alias("first"), F.min(order).alias("ord"), hints("body").alias("body_hints"), hints("energy").alias("energy_hints"))
        .select("series_id", "first.*", "body_hints", "energy_hints", "ord")
    )


def valid_id_filter(candidates: DataFrame, key: str = "series_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose key is all digits, rejected rows)."""
    good = F.coalesce(text.strip(key).rlike(KEY_PATTERN), F.lit(False))
    trimmed = candidates.withColumn("_good", good)
    accepted = trimmed.filter("_good").drop("_good").withColumn(key, text.strip(key))
    return accepted, trimmed.filter(~F.col("_good")).drop("_good")


def manual_candidates(ids: DataFrame, key: str = "series_id") -> tuple[DataFrame, DataFrame]:
    """Candidates named by key only: the key is their name, price and hints are open."""
    accepted, rejected = valid_id_filter(ids, key)
    nothing = F.lit(None).cast("double")
    empty = F.array().cast("array<string>")
    return accepted.select(
        key, F.col(key).alias("name"), nothing.alias("list_price_min"), nothing.alias("list_price_max"),
        empty.alias("body_hints"), empty.alias("energy_hints"),
    ), rejected


def has_response(candidates: DataFrame, *responses: DataFrame, key: str = "series_id") -> DataFrame:
    """Candidates for which any stored response exists."""
    keys = responses[0].select(key)
    for frame in responses[1:]:
        keys = keys.union(frame.select(key))
    return candidates.join(keys, key, "left_semi")


def limit_candidates(candidates: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first ``n`` candidates for a pilot run; all of them for ``n <= 0``."""
    return candidates.orderBy(order).limit(n) if n > 0 else candidates


def series_rows(
    candidates: DataFrame,
    payloads: DataFrame | None,
    captured_at: str,
    links: vocab.SiteLinks = vocab.SiteLinks(),
    entities: str = "all",
) -> DataFrame:
    """Series table: inferred name, list prices (0 counts as unknown), sorted hints, derived links."""
    if payloads is None:
        named = candidates.withColumn("_first", F.lit(None).cast("string"))
    else:
        first_name = F.get(F.col("data.arrCar"), F.lit(0))["car_name"]
        names = payloads.select("series_id", first_name.alias("_raw")).withColumn(
            "_first", text.clean_text("_raw", entities)
        )
        named = candidates.join(names.drop("_raw"), "series_id", "left")
    key = F.col("series_id")
    return named.select(
        "series_id",
        text.inferred_series_name("name", "series_id", F.coalesce("_first", F.lit(""))).alias("series_name"),
        F.nullif("list_price_min", F.lit(0.0)).alias("list_price_min_wan"),
        F.nullif("list_price_max", F.lit(0.0)).alias("list_price_max_wan"),
        F.array_join(F.array_sort("body_hints"), "|").alias("body_hints"),
        F.array_join(F.array_sort("energy_hints"), "|").alias("energy_hints"),
        _link(links.series, key).alias("source_url"),
        _link(links.options, key).alias("options_url"),
        _link(links.sales, key).alias("sales_url"),
        F.lit(captured_at).alias("captured_at"),
    )


def failures(payloads: DataFrame) -> DataFrame:
    """One row per series whose payload could not be read; the other series are unaffected."""
    return payloads.filter(F.col("problem").isNotNull()).select("series_id", F.col("problem").alias("failure"))


def manifest_record(
    spark: SparkSession, counts: Mapping[str, int], failed: DataFrame, selected: int, captured_at: str, generated_at: str, source: str, build_only: bool = True,
) -> DataFrame:
    """One record about an ingest run: source, scope, times, selected series, rows per table and failures by kind.

    ``counts`` are those that the writes themselves observed; failures are listed by kind with their number and first series.
    """
    scope = "cached series, full attributes and measure history" if build_only else "listed series, full attributes and measure history"
    kinds = failed.groupBy("failure").agg(F.count("*").alias("n"), F.min("series_id").alias("first_series"))
    listed = kinds.agg(F.array_sort(F.collect_list(F.struct("failure", "n", "first_series"))).alias("failures"))
    return listed.select(
        F.lit(source).alias("data_source"), F.lit(scope).alias("scope"), F.lit(captured_at).alias("captured_at"), F.lit(generated_at).alias("generated_at"),
        F.lit(selected).cast("long").alias("selected_series"),
        F.struct(*[F.lit(n).cast("long").alias(name) for name, n in counts.items()]).alias("counts"), "failures", F.lit(build_only).alias("build_only"),
    )


def ingest_manifest(tables: Mapping[str, DataFrame], failed: DataFrame) -> DataFrame:
    """Row count per table, and one row for the failures."""
    counts = None
    for name, frame in [*tables.items(), ("failures", failed)]:
        row = frame.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        counts = row if counts is None else counts.unionByName(row)
    return counts


