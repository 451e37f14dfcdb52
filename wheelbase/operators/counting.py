"""How many items fit each request, without pairing requests with items.

A request is a conjunction of classes (body, energy, brand, tag), two minimums (seats, sales) and a price band. The items that
overlap a band [low, high] are those that begin at or below ``high`` less those that end below ``low``; both are
counts of a prefix of a price order. So a count is a difference of two running sums over a line of item
and request points, one line per combination of conditions that some request asks for, and the work is a sort of points.

Minimums become classes too: seats above the largest that can be asked are cut to it and a request adds up the few seat
numbers it accepts; sales are replaced by the number of asked minimums they reach, and a suffix of these levels is a
sum of blocks of 1, 2, 4, ... levels, so an item is in one block of each size.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheelbase import vocab
from wheelbase.operators.ordering import with_sums_before
from wheelbase.staging import written

# Conditions of a line, by bit of its pattern; a condition that is not asked for stays blank in the line's key.
BODY, ENERGY, BRAND, TAG, SEATS, SALES = (1 << i for i in range(6))
# Most terms whose keys are shipped to all tasks: 32 MB.
SHIPPED_TERMS = 2_000_000


def _value(column: Column) -> Column:
    """A class value as key text; no value equals the blank of an unasked condition."""
    return F.concat(F.lit("="), column)


def _key(*conditions: Column) -> Column:
    """128 bits of the conditions of a line, in the order body, energy, brand, tag, seats, block."""
    return F.struct(F.xxhash64(*conditions).alias("a"), F.xxhash64(F.lit(1), *conditions).alias("b"))


def sales_levels(items: DataFrame, minimums: DataFrame, stage=written) -> tuple[DataFrame, DataFrame, int]:
    """(items with ``level``, minimums with ``level``, number of block sizes).

    ``minimums`` has the distinct asked ``min_sales``. An item's level is the number of these at or below its sales, the level of
    the smallest minimum is 1, so an item fulfils a minimum exactly if its level is not below the minimum's.
    """
    asked = minimums.select(F.col("min_sales").cast("long").alias("value")).filter("value is not null").distinct()
    sold = items.select(F.col("item_sales").cast("long").alias("value")).filter("value is not null").distinct()
    points = asked.select("value", F.lit(1).alias("step")).unionByName(sold.select("value", F.lit(0).alias("step")))
    merged = points.groupBy("value").agg(F.max("step").alias("step"))
    levels = with_sums_before(merged, [], ["value"], {"below": F.col("step")}, stage=stage).select("value", (F.col("below") + F.col("step")).alias("level"), "step")
    n = asked.count()
    of_item = levels.select(F.col("value").alias("_sold"), F.col("level"))
    leveled = items.join(of_item, F.col("item_sales").cast("long") == F.col("_sold"), "left").drop("_sold").withColumn("level", F.coalesce("level", F.lit(0)))
    return leveled, levels.filter("step = 1").select(F.col("value").alias("min_sales"), "level"), max(1, n.bit_length())


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by)


def blocks_of_level(sizes: int) -> Column:
    """The block of every size that holds ``level``; level 0 fulfils no minimum and is in none."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(sizes - 1)), lambda s: _block(s, _shift("shiftright", F.col("level"), s)))
    return F.when(F.col("level") > 0, blocks).otherwise(_nothing("bigint"))


def blocks_from_level(sizes: int) -> Column:
    """Disjoint blocks that cover all levels from ``level`` (at least 1) up."""
    one = F.lit(1).cast("long")
    first = lambda s: _shift("shiftright", F.col("level") + _shift("shiftleft", one, s) - 1, s)
    used = F.filter(F.sequence(F.lit(0), F.lit(sizes - 1)), lambda s: (first(s) % 2 == 1) & (first(s) < _shift("shiftleft", one, F.lit(sizes) - s)))
    return F.transform(used, lambda s: _block(s, first(s)))


def _block(size: Column, number: Column) -> Column:
    return size.cast("long") * F.lit(2**40) + number


def _nothing(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _blank(kind: str) -> Column:
    """What stands for a condition that is not asked for."""
    return F.array(F.lit("") if kind == "string" else F.lit(-1).cast(kind))


def _lines_of_items(items: DataFrame, terms: DataFrame, keys: DataFrame, sizes: int) -> DataFrame:
    """(number, low, high, weight): each item once for every asked key that it fulfils; ``keys`` number the asked ones.

    The combinations that an item can fulfil are built in place and looked up by key. The lookup table is shipped to the tasks
    only after its rows were counted; a larger one is joined by a shuffle.
    """
    asked = terms.agg(F.count("*").alias("n"), F.collect_set("pattern").alias("patterns")).first()
    patterns = F.array(*[F.lit(p) for p in asked.patterns]).cast("array<int>")
    if asked.n <= SHIPPED_TERMS:
        keys = F.broadcast(keys)
    # A small catalog arrives in few partitions, but every item of it becomes many rows here.
    spread = items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = lambda c: F.when(F.col(c).isNotNull(), F.array(_value(F.col(c)))).otherwise(_nothing("string"))
    seats = F.when(F.col("seats") > vocab.SEATS_MAX, vocab.SEATS_MAX).otherwise(F.col("seats")).cast("bigint")
    tags = F.filter(F.coalesce(F.transform(F.array_distinct("scenario_tags"), _value), _nothing("string")), lambda t: t.isNotNull())
    choices = {
        "body": (BODY, text("body_type"), _blank("string")), "energy": (ENERGY, text("energy_type"), _blank("string")), "brand": (BRAND, text("brand"), _blank("string")),
        "tag": (TAG, tags, _blank("string")), "seats": (SEATS, F.when(seats.isNotNull(), F.array(seats)).otherwise(_nothing("bigint")), _blank("bigint")),
        "block": (SALES, blocks_of_level(sizes), _blank("bigint")),
    }
    lines = spread.select(
        F.col("price_min_wan").alias("low"), F.col("price_max_wan").alias("high"), "weight", *[values.alias(f"_{c}s") for c, (_, values, _) in choices.items()]
    ).withColumn("pattern", F.explode(patterns))
    for name, (bit, _, blank) in choices.items():
        asked = F.col("pattern").bitwiseAND(bit) != 0
        lines = lines.withColumn(f"_{name}", F.explode(F.when(asked, F.col(f"_{name}s")).otherwise(blank))).drop(f"_{name}s")
    return lines.select(_key(*[F.col(f"_{c}") for c in choices]).alias("key"), "low", "high", "weight").join(keys, "key").drop("key")


def _terms(requests: DataFrame, sizes: int) -> DataFrame:
    """(sig, name, key, pattern, low, high): the lines whose counts a request adds up under each name."""
    has = lambda c: F.col(c) != ""
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    seats = F.when(F.col("min_seats").isNull(), _blank("bigint")).when(F.col("min_seats") > vocab.SEATS_MAX, _nothing("bigint")).otherwise(
        F.sequence(F.col("min_seats").cast("bigint"), F.greatest(F.col("min_seats"), F.lit(vocab.SEATS_MAX)).cast("bigint")))
    blocks = F.when(F.col("min_sales").isNull(), _blank("bigint")).otherwise(blocks_from_level(sizes))
    brands = F.transform("brands", _value)
    tag = _value(F.coalesce("scenario", F.lit("")))
    core, raised = F.col("budget_max_wan"), F.col("raised_wan")
    names = F.array(*[
        F.struct(F.lit(name).alias("name"), chosen.alias("brand"), label.alias("tag"), high.alias("high"), F.lit(bits).alias("bits"))
        for name, chosen, label, high, bits in (
            ("n_core", _blank("string"), F.lit(""), core, 0), ("n_brand", brands, F.lit(""), core, BRAND), ("n_scenario", _blank("string"), tag, core, TAG),
            ("n_both", brands, tag, core, BRAND | TAG), ("n_raised", _blank("string"), F.lit(""), raised, 0),
        )
    ])
    wide = (
        requests.withColumn("n", F.explode(names)).withColumn("_brand", F.explode("n.brand"))
        .withColumn("_seats", F.explode(seats)).withColumn("_block", F.explode(blocks))
    )
    pattern = (
        bit(has("body_type"), BODY) + bit(has("energy_type"), ENERGY) + F.col("n.bits") + bit(F.col("min_seats").isNotNull(), SEATS)
        + bit(F.col("min_sales").isNotNull(), SALES)
    )
    wish = lambda c: F.when(has(c), _value(F.col(c))).otherwise("")
    key = _key(wish("body_type"), wish("energy_type"), F.col("_brand"), F.col("n.tag"), F.col("_seats"), F.col("_block"))
    return wide.select("sig", F.col("n.name").alias("name"), key.alias("key"), pattern.alias("pattern"), F.col("budget_min_wan").alias("low"), F.col("n.high").alias("high"))


COUNTS = ("n_core", "n_brand", "n_scenario", "n_both", "n_raised")
# Order at equal prices: items that begin there count, items that end there are not below.
_BEGIN, _ASK, _END = 0, 1, 2


def count_in_bands(items: DataFrame, requests: DataFrame, raised: Column, stage=written) -> DataFrame:
    """Per ``sig`` the summed weights of the items that fit: as asked, with brand, with tag, with both, and under the ``raised`` ceiling.

    ``items`` need price_max_wan not below price_min_wan, as the catalog's repair rule gives it; a NULL class, seat or sales value fulfils
    no condition on it. ``requests`` hold distinct brands. Requests that no item can answer have zeros.
    Items become one point per asked combination of conditions, requests a few points per name: the work is a sort of both.
    """
    sold = items.withColumnRenamed("sales", "item_sales").select(
        "price_min_wan", "price_max_wan", "body_type", "energy_type", "brand", "scenario_tags", "seats", "item_sales", "weight").filter("weight > 0")
    leveled, minimums, sizes = sales_levels(sold, requests, stage)
    minimums = minimums.withColumnRenamed("min_sales", "_minimum")
    # Tables of points hold a request and a line once a row, so both are numbers there.
    known = stage(requests.withColumn("number", F.monotonically_increasing_id()))
    wanted = known.withColumn("sig", F.col("number")).drop("number").withColumn("raised_wan", raised).join(minimums, F.col("min_sales") == F.col("_minimum"), "left")
    terms = stage(_terms(wanted, sizes))
    keys = stage(terms.select("key").distinct().withColumn("number", F.monotonically_increasing_id()))
    lines = _lines_of_items(leveled, terms, keys, sizes)
    begin = F.struct(F.lit(_BEGIN).alias("line"), F.col("low").alias("price"))
    end = F.struct(F.lit(_END).alias("line"), F.col("high").alias("price"))
    # Stored before the ranges are made, so the shuffle files of all points are gone when the summed ones are dealt out.
    of_items = stage(lines.select("number", "weight", F.inline(F.array(begin, end))).groupBy("number", "line", "price").agg(F.sum("weight").alias("weight")))
    of_items = of_items.withColumn("side", F.col("line"))
    upper = F.struct(F.lit(_BEGIN).alias("line"), F.col("high").alias("price"), F.lit(1).alias("sign"))
    lower = F.struct(F.lit(_END).alias("line"), F.col("low").alias("price"), F.lit(-1).alias("sign"))
    of_requests = terms.join(keys, "key").select("number", F.inline(F.array(upper, lower)), F.lit(_ASK).alias("side"), F.lit(0).cast("long").alias("weight"), "sig", "name")
    points = of_requests.unionByName(of_items, allowMissingColumns=True)
    running = with_sums_before(points, ["number", "line"], ["price", "side"], {"below": F.col("weight")}, stage=stage).filter(F.col("side") == _ASK)
    total = lambda name: F.sum(F.when(F.col("name") == name, F.col("sign") * F.col("below")).otherwise(F.lit(0)))
    counted = running.groupBy(F.col("sig").alias("number")).agg(*[total(n).alias(n) for n in COUNTS])
    return known.select("sig", "number").join(counted, "number").drop("number")
