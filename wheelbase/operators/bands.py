"""Overlap join of price bands as an equi-join on a grid.

A band covers a few geometric price buckets.  Both sides are laid out over their buckets and joined on
(bucket, body, energy); a pair that shares several buckets is kept only in the first shared one.  Keys
whose sides are large are cut into a grid of slices, so no key is worked on by a single task and the
work of one task is bounded however the data is distributed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_RATIO = 1.15
SLICE_ROWS = 20_000
ANY = ""


# Prices outside share the first and the last bucket, so an endless band covers few of them.
LOWEST, HIGHEST = 1e-4, 1e9


def bucket(price: Column) -> Column:
    inside = F.least(F.greatest(price, F.lit(LOWEST)), F.lit(HIGHEST))
    return F.floor(F.log(inside) / F.lit(math.log(BUCKET_RATIO))).cast("int")


def _over_buckets(df: DataFrame, low: Column, high: Column) -> DataFrame:
    return df.withColumn("first_bucket", bucket(low)).withColumn(
        "bucket", F.explode(F.sequence(F.col("first_bucket"), bucket(high)))
    )


def sliced(df: DataFrame, sizes: DataFrame, keys: list[str], own: str, other: str, identity: str) -> DataFrame:
    """Assign each row one of its own slices and copy it to every slice of the other side."""
    return (
        df.join(sizes, keys)
        .withColumn(own, F.pmod(F.xxhash64(identity, F.lit(own)), F.col(f"n_{own}")).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
        .drop("n_i", "n_r")
    )


def band_join(
    items: DataFrame,
    requests: DataFrame,
    condition: Column,
    item_id: str,
    request_id: str,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Pairs whose bands overlap, whose classes agree where requested, and that satisfy ``condition``.

    ``items`` needs ``price_min_wan, price_max_wan, body_type, energy_type``; ``requests`` needs
    ``band_low, band_high, want_body, want_energy`` with '' for "any".
    """
    keys = ["bucket", "key_body", "key_energy"]
    # An item answers requests for its own class and requests for any class.
    either = lambda c: F.explode(F.array_distinct(F.array(F.lit(ANY), F.coalesce(F.col(c), F.lit(ANY)))))
    laid_items = _over_buckets(
        items.withColumn("key_body", either("body_type")).withColumn("key_energy", either("energy_type")),
        F.col("price_min_wan"), F.col("price_max_wan"),
    ).withColumnRenamed("first_bucket", "item_bucket")
    asked = requests.withColumns({"key_body": F.col("want_body"), "key_energy": F.col("want_energy")})
    laid_requests = _over_buckets(asked, F.col("band_low"), F.col("band_high")).withColumnRenamed(
        "first_bucket", "request_bucket"
    )

    def slices(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(slice_rows)).cast("int").alias(name))

    # Keys only one side has drop out here, before anything is shuffled for the pairing.
    sizes = slices(laid_items, "n_i").join(slices(laid_requests, "n_r"), keys)
    left = sliced(laid_items, sizes, keys, "i", "r", item_id)
    right = sliced(laid_requests, sizes, keys, "r", "i", request_id)
    first_shared = F.col("bucket") == F.greatest("item_bucket", "request_bucket")
    overlap = (F.col("price_min_wan") <= F.col("band_high")) & (F.col("price_max_wan") >= F.col("band_low"))
    # A small side would be sent to the few tasks of the other one, though every row of it may become many pairs; a stated number of tasks stays.
    spread = left.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "i", "r")
    joined = spread.join(right, [*keys, "i", "r"])
    return joined.filter(first_shared & overlap & condition).drop(
        *keys, "i", "r", "item_bucket", "request_bucket"
    )
