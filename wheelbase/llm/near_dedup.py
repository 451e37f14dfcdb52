"""MinHash near-duplicate detection: one permutation, optimal densification, bands, star-shaped candidates, exact check.

1. A document's set holds the fingerprints of its distinct k-word shingles (`words.py`). Equal sets collapse to one
   representative at once, so a group of a million copies is one row from here on.
2. One pass over the sorted set fills all bins (a bin takes the smallest fingerprint that falls into it). An empty bin borrows
   from the occupied bin that comes first in an order drawn for that bin alone, which is the densification with the least variance.
3. Bins form bands; equal bands are a bucket. The number of bands follows from the threshold, so that a pair at the threshold is missed
   with a chance below ``MISS``.
4. In each bucket centres are linked with the other members (a star), never all members with each other. Links are checked on the
   full sets. Buckets that still hold several components get further centres, 64 times as many in every round, until each bucket is one component
   or every member outside its pivot's component has been a centre: two members of that component need no check, so no link inside a bucket is lost, and
   the pairs met are those outside times the members. A group around one original takes two or three rounds. From the third round on, the members' differences from the bucket's second centre decide most pairs without their texts.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelbase.llm.frames import table, versions, written
from wheelbase.llm.graph import components
from wheelbase.llm.words import U, Words, keyed, mix, pieces

ROWS_PER_BAND = 6
MISS = 1e-6
# From the third wave on, each has so many times the centres of the one before.
GROWTH = 64
# What a member of a bucket keeps of its pivot: which it is, its size, and the intersection with it. The differences are stored once for each member and pivot.
PIVOT = ("pivot", "size", "both")


def bands_for(threshold: float, rows: int = ROWS_PER_BAND, miss: float = MISS) -> int:
    """Bands of ``rows`` bins that miss a pair at the threshold with a chance of at most ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-(threshold**rows))))


def one_permutation(values: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """Signature of a sorted, non-empty set of fingerprints; order[i, j] ranks bin j as a lender for the empty bin i."""
    where = ((values >> U(32)) * U(bins)) >> U(32)
    first = np.empty(len(values), bool)
    first[0] = True
    np.not_equal(where[1:], where[:-1], out=first[1:])
    held = where[first].astype(np.int64)
    out = np.zeros(bins, U)
    out[held] = values[first]
    if len(held) < bins:
        empty = np.ones(bins, bool)
        empty[held] = False
        empty = np.flatnonzero(empty)
        out[empty] = out[held[order[np.ix_(empty, held)].argmin(axis=1)]]
    return out


def signatures(docs: DataFrame, k: int, threshold: float, rows: int = ROWS_PER_BAND) -> DataFrame:
    """(doc_id, version, n_shingles long, digest binary, bands array<long>) per row of ``docs`` (doc_id, text, version); no digest and bands for an empty set."""
    n_bands = bands_for(threshold, rows)
    bins = n_bands * rows

    def sign(batches):
        order = keyed(bins * bins, 71).reshape(bins, bins)
        weight, tags = keyed(rows, 72) | U(1), keyed(n_bands, 73)
        for whole in batches:
            for batch in pieces(whole):
                count, digest, bands = [], [], []
                for values in Words(batch.column("text")).sets(k):
                    count.append(len(values))
                    digest.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                    if len(values):
                        bin_values = one_permutation(values, bins, order).reshape(n_bands, rows)
                        bands.append(mix((mix(bin_values) * weight).sum(axis=1, dtype=U) + tags).view(np.int64))
                    else:
                        bands.append(None)
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "version": batch.column("version"), "n_shingles": pa.array(count, pa.int64()), "digest": pa.array(digest, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return docs.select("doc_id", "text", "version").mapInArrow(sign, "doc_id long, version long, n_shingles long, digest binary, bands array<long>")


def intersections(pairs: DataFrame, held: DataFrame, k: int, deltas: bool = False) -> DataFrame:
    """(a, b, both, union): sizes counted on the full sets of both texts; ``held`` has one text per representative.

    With ``deltas`` also ``lacks`` (shingles of b that a has not) and ``adds`` (the reverse); null where they are more than a's set together.
    """
    schema = "a long, b long, both long, union long" + ", lacks array<long>, adds array<long>" * deltas

    def check(batches):
        for whole in batches:
            for left in pieces(whole, "text_a", 1_000_000):
                common, union, lacks, adds, at = [], [], [], [], 0
                for batch in pieces(left, "text_b", 1_000_000):
                    one = Words(left.column("text_a").slice(at, batch.num_rows)).sets(k)
                    at += batch.num_rows
                    for x, y in zip(one, Words(batch.column("text_b")).sets(k)):
                        union.append(len(np.unique(np.concatenate([x, y]))))
                        common.append(len(x) + len(y) - union[-1])
                        if deltas:
                            close = union[-1] - common[-1] <= len(x)
                            lacks.append(np.setdiff1d(y, x, True).view(np.int64) if close else None)
                            adds.append(np.setdiff1d(x, y, True).view(np.int64) if close else None)
                made = {"a": left.column("a"), "b": left.column("b"), "both": pa.array(common, pa.int64()), "union": pa.array(union, pa.int64())}
                if deltas:
                    made |= {"lacks": pa.array(lacks, pa.list_(pa.int64())), "adds": pa.array(adds, pa.list_(pa.int64()))}
                yield pa.record_batch(made)

    both = pairs.join(held.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(held.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, schema)


def private_counts(held: DataFrame, k: int) -> DataFrame:
    """(rep, private): how many of each text's shingles occur in none of the other texts. Counting combines before the shuffle."""

    def cut(batches):
        for whole in batches:
            for batch in pieces(whole):
                sets = Words(batch.column("text")).sets(k)
                yield pa.record_batch({"rep": batch.column("rep"), "shingles": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))})

    cut_ = held.mapInArrow(cut, "rep long, shingles array<long>")
    alone = cut_.select("rep", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).filter("n = 1")
    return alone.groupBy("rep").agg(F.count("*").alias("private"))


def links(sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of all representatives with a link; ``sets`` holds one row (rep, source, n, bands) per distinct set, ``source`` being (doc_id, version) of a text with it.

    Exact bounds keep pairs out before any text is compared; none can lose a link. A shingle that no other candidate holds is private, so two sets share
    at most the smaller n - private. Once all members of a bucket are compared with its pivot, two of them share at most the smaller intersection with
    the pivot plus the smaller rest that is neither the pivot's nor private. And where both keep their differences from the pivot (which are small in a
    family of near copies), these give the intersection itself: the pivot's size, less what either lacks, plus what both add.
    """
    banded = sets.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket")
    active = written(banded.join(shared, "bucket"))
    reps = sets.join(active.select("rep").distinct(), "rep", "left_semi").select("rep", "source.*")
    held = written(docs.join(reps, ["doc_id", "version"]).groupBy("rep").agg(F.max("text").alias("text")))
    active = active.join(private_counts(held, k), "rep", "left").select("bucket", "rep", "n", (F.col("n") - F.coalesce("private", F.lit(0))).alias("common"))
    active = active.filter(100 * F.col("common") >= percent * F.col("n"))
    several = active.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket")
    active = active.join(several, "bucket", "left_semi").select("*", F.lit(False).alias("used"), F.lit(False).alias("safe"), F.col("rep").alias("component"), *[F.lit(None).cast("long").alias(c) for c in PIVOT])
    active = written(active)
    carried = ["n", "common", "component", *PIVOT]
    found, tried, apart, labels, wave = None, None, None, None, 0

    def enough(shared_most):
        return 100 * shared_most >= percent * (F.col("n") + F.col("n_c") - shared_most)

    while rows := active.count():
        # Centres: those with most links so far (the original of a group), then the smallest. One in the first two waves, the pivots; then 64, 4096, ...
        ranked = active.filter("not used and not safe").select("bucket", "rep", *carried)
        if found is None:
            ranked = ranked.withColumn("degree", F.lit(0))
        else:
            ranked = ranked.join(found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree")), "rep", "left")
        ranked = ranked.select("bucket", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), (-F.col("rep")).alias("less"), *carried).alias("rank"))
        chosen = _largest(ranked, GROWTH ** max(0, wave - 1)).select("bucket", (-F.col("rank.less")).alias("centre"), *[F.col(f"rank.{c}").alias(f"{c}_c") for c in carried])
        if wave > 1:
            told = apart.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), "lacks", "adds")
            members = active.join(told, ["rep", "pivot"], "left")
            chosen = chosen.join(told.toDF("centre", "pivot_c", "lacks_c", "adds_c"), ["centre", "pivot_c"], "left")
        else:
            members = active
        met = members.join(chosen, "bucket").filter("rep <> centre")
        if wave == 0:
            met = met.filter(enough(F.least("common", "common_c")))
        elif wave > 1:
            most = F.least("common", "common_c", F.least("both", "both_c") + F.least(F.col("common") - F.col("both"), F.col("common_c") - F.col("both_c")))
            exact = F.col("size") - F.size(F.array_union("lacks", "lacks_c")) + F.size(F.array_intersect("adds", "adds_c"))
            met = met.filter("component <> component_c").filter(enough(most)).filter(enough(F.when(F.col("lacks").isNotNull() & F.col("lacks_c").isNotNull(), exact).otherwise(most)))
        if wave == 1:
            measured = written(intersections(met.select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct(), held, k, deltas=True))
            apart = measured
            measured = measured.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "both", "union").distinct()
        else:
            pairs = met.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
            measured = written(intersections(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), held, k))
        good = measured.filter(100 * F.col("both") >= percent * F.col("union")).select("a", "b")
        tried = measured.select("a", "b") if tried is None else tried.unionByName(measured.select("a", "b"))
        if labels is None or not good.isEmpty():
            found = good if found is None else written(found.unionByName(good))
            labels = components(found)
        used = chosen.select("bucket", F.col("centre").alias("rep"), F.lit(True).alias("now"))
        state = active.drop("component").join(used, ["bucket", "rep"], "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        state = state.select("bucket", "rep", "n", "common", *PIVOT, "safe", (F.col("used") | F.coalesce("now", F.lit(False))).alias("used"), F.coalesce("component", "rep").alias("component"))
        if wave == 1:
            pivots = chosen.select("bucket", F.col("centre").alias("pivot"), F.col("n_c").alias("size"))
            state = state.drop(*PIVOT).join(pivots, "bucket").join(apart.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), "both"), ["rep", "pivot"], "left")
            state = state.withColumn("both", F.coalesce("both", "n")).select("bucket", "rep", "n", "common", *PIVOT, "safe", "used", "component")
        state = written(state, rows)
        # A component only grows, so who is in the pivot's once is safe: it needs no turn as a centre later. Without a pivot nobody is.
        waits = F.when(~F.col("used") & ~F.col("safe"), F.col("component"))
        main = F.max(F.when(F.col("rep") == F.col("pivot"), F.col("component")))
        open_ = state.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count_if(~F.col("used")).alias("idle"), F.min(waits).alias("first_left"), F.max(waits).alias("last_left"), main.alias("main"))
        # The only member that was no centre has met all others.
        open_ = open_.filter("low < high and idle > 1 and first_left is not null and not (first_left <=> main and last_left <=> main)").select("bucket", "main")
        active = written(state.join(open_, "bucket").withColumn("safe", F.col("safe") | F.col("component").eqNullSafe(F.col("main"))).drop("main"), rows)
        wave += 1
    return labels if labels is not None else docs.sparkSession.createDataFrame([], "node long, component long")


def _largest(ranked: DataFrame, n: int) -> DataFrame:
    """Up to n ranks of every bucket: the largest of each of n parts, which combines before the shuffle for any bucket size."""
    return ranked.groupBy("bucket", F.pmod(F.xxhash64("rank.less"), F.lit(n)).alias("part")).agg(F.max("rank").alias("rank")).select("bucket", "rank")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text, ...).

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest doc_id reachable.
    A text that is null, empty or blank has an empty set, is linked with nothing and is kept. A text with fewer than k words has its whole sequence as its
    only shingle. Repeated rows get equal result rows; rows of one doc_id with different texts are told apart.
    Rows without doc_id are left out. An empty table gives no rows. Other columns are ignored.
    """
    return numbered(docs, k, percent).drop("version")


def numbered(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``near_duplicates`` with the version of each row's text."""
    docs = versions(docs)
    signed = written(signatures(docs, k, percent / 100))
    sets = signed.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "version")).alias("source"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    # A representative is a number of its own, not a doc_id: a doc_id may have several texts. It is drawn once, as the table is written.
    sets = written(sets.withColumn("rep", F.monotonically_increasing_id()))
    labels = links(sets, docs, k, percent)
    groups = sets.select("digest", "rep", "source.doc_id").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    groups = groups.join(smallest, "component").select("digest", "component_id")
    out = signed.select("doc_id", "version", "n_shingles", "digest").join(groups, "digest", "left")
    out = out.select("doc_id", "version", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (the smallest id); k = 5 and 0.8 as for all stages on shingles. Another text of a document that goes is judged on its own."""
    gone = numbered(docs, 5, 80).filter("not kept").select("doc_id", "version").distinct()
    mine = (docs["doc_id"].cast("long") == gone["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["version"])
    return docs.join(gone, mine, "left_anti")
