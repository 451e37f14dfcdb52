"""Line dedup with sharded cuckoo filters over exact reference counts; insertions and document deletions are reversible.

State, four tables in shared storage: ``holdings`` (doc_id, key) says which document holds which line, ``counts`` (key, n_docs, largest) is
the exact reference count of a line and its largest holder, ``filters`` (shard, cells) is one cuckoo filter per shard over the crowded keys
(n_docs >= min_docs). A line is first tried against its shard's filter; what passes is looked up in ``counts``, so false positives never
drop a line. Deleting a document takes its holdings out of the counts, and keys that are no longer crowded leave their filter.

A key is a line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z lower-cased, told by 128 bits of BLAKE2b. Shorter keys than ``min_chars`` code
points are never dropped. Counting combines before the shuffle, filters are tried on (shard, salt) groups whose number follows both the largest count and the number
of holdings, and the exact look-up is a join that Spark can split, so a line that a third of all documents share lands in no single task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wheelbase.llm.frames import stored, table, texts
from wheelbase.llm.words import U, mix, pieces

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
KEYS_PER_SHARD = 100_000
ROWS_PER_GROUP = 200_000
SLOTS = 4


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of a line's key, or None for a key that is too short to count."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key is in one of two buckets. It has no false negatives: a table that gets too full grows."""

    def __init__(self, capacity: int, cells: np.ndarray | None = None):
        if cells is None:
            buckets = 1 << max(2, int(np.ceil(np.log2(max(capacity, 1) / (0.8 * SLOTS)))))
            cells = np.zeros((buckets, SLOTS), np.uint16)
        self.cells = cells

    @staticmethod
    def of(data: bytes) -> CuckooFilter:
        return CuckooFilter(0, np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key."""
        raw = np.frombuffer(b"".join(keys), U).reshape(-1, 2)
        low = U(len(self.cells) - 1)
        mark = (raw[:, 1] >> U(32)).astype(np.uint16)
        mark[mark == 0] = 1
        one = raw[:, 0] & low
        return mark, one.astype(np.int64), ((one ^ mix(mark.astype(U))) & low).astype(np.int64)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        mark, one, two = self.places(keys)
        return ((self.cells[one] == mark[:, None]) | (self.cells[two] == mark[:, None])).any(axis=1)

    def _put(self, mark: int, bucket: int) -> bool:
        low = len(self.cells) - 1
        for turn in range(500):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return True
            slot = (turn * 7 + mark) % SLOTS
            mark, self.cells[bucket, slot] = int(self.cells[bucket, slot]), mark
            bucket = (bucket ^ int(mix(np.array([mark], U))[0])) & low
        return False

    def insert(self, keys: list[bytes]) -> bool:
        """False if the table got too full; it must then be built anew with more room."""
        if not keys:
            return True
        mark, one, two = self.places(keys)
        for m, a, b in zip(mark.tolist(), one.tolist(), two.tolist()):
            bucket = a if (self.cells[a] == 0).any() else b
            if not self._put(m, bucket):
                return False
        return True

    def delete(self, keys: list[bytes]) -> None:
        """Only keys that were inserted may be deleted."""
        if not keys:
            return
        mark, one, two = self.places(keys)
        for m, a, b in zip(mark, one, two):
            for bucket in (a, b):
                slot = np.flatnonzero(self.cells[bucket] == m)
                if len(slot):
                    self.cells[bucket, slot[0]] = 0
                    break

    @staticmethod
    def build(keys: list[bytes]) -> CuckooFilter:
        capacity = len(keys)
        while True:
            made = CuckooFilter(capacity)
            if made.insert(keys):
                return made
            capacity = 2 * max(capacity, 1)


def held_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, key) for every distinct countable line of every document."""

    def split(batches):
        for whole in batches:
            for batch in pieces(whole):
                ids, keys = [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                    own = {line_key(line, min_chars) for line in (text or b"").split(b"\n")}
                    own.discard(None)
                    ids += [doc] * len(own)
                    keys += own
                yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(split, "doc_id long, key binary")


def _counted(holdings: DataFrame) -> DataFrame:
    return holdings.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("largest"))


@dataclass
class LineIndex:
    """The state of incremental line dedup. Every method returns a new state; the old one stays valid."""

    holdings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int
    min_docs: int

    @staticmethod
    def build(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        held = stored(held_lines(texts(docs), min_chars).distinct())
        counts = stored(_counted(held))
        crowded = counts.filter(F.col("n_docs") >= min_docs)
        shards = max(1, -(-crowded.count() // KEYS_PER_SHARD))

        def make(group: pa.Table) -> pa.Table:
            cells = CuckooFilter.build(group.column("key").to_pylist()).cells
            return pa.table({"shard": [group.column("shard")[0].as_py()], "cells": pa.array([cells.tobytes()], pa.binary())})

        filters = crowded.select(_shard(shards).alias("shard"), "key").groupBy("shard").applyInArrow(make, "shard long, cells binary")
        return LineIndex(held, counts, stored(filters), shards, min_chars, min_docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents. Rows whose id the index holds already are left out: delete the old text first."""
        fresh = held_lines(texts(docs), self.min_chars).distinct().join(self.holdings.select("doc_id").distinct(), "doc_id", "left_anti")
        fresh = stored(fresh)
        merged = self.counts.unionByName(_counted(fresh)).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("largest").alias("largest"))
        return self._after(self.holdings.unionByName(fresh), merged)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Takes documents (doc_id) out again. Ids that the index doesn't hold change nothing."""
        ids = ids.select("doc_id").distinct()
        gone = _counted(self.holdings.join(ids, "doc_id", "left_semi")).select("key", F.col("n_docs").alias("n_gone"), F.col("largest").alias("largest_gone"))
        rest = stored(self.holdings.join(ids, "doc_id", "left_anti"))
        left = self.counts.join(gone, "key", "left").select("key", (F.col("n_docs") - F.coalesce("n_gone", F.lit(0))).alias("n_docs"), "largest", (F.col("largest") == F.col("largest_gone")).alias("lost"))
        left = stored(left.filter("n_docs > 0"))
        again = _counted(rest.join(left.filter("lost").select("key"), "key", "left_semi")).select("key", F.col("largest").alias("next"))
        return self._after(rest, left.join(again, "key", "left").select("key", "n_docs", F.coalesce("next", "largest").alias("largest")))

    def _after(self, holdings: DataFrame, counts: DataFrame) -> LineIndex:
        """The filters follow the keys whose state has changed; a shard that gets too full is built anew from the counts."""
        holdings, counts = stored(holdings), stored(counts)
        was = self.counts.filter(F.col("n_docs") >= self.min_docs).select("key", F.lit(1).alias("was"))
        now = counts.filter(F.col("n_docs") >= self.min_docs).select("key", F.lit(1).alias("now"))
        keys = was.join(now, "key", "full").select(_shard(self.shards).alias("shard"), "key", F.col("was").isNotNull().alias("was"), F.col("now").isNotNull().alias("now"))

        def change(old: pa.Table, keys: pa.Table) -> pa.Table:
            shard = (old if old.num_rows else keys).column("shard")[0].as_py()
            rows = list(zip(keys.column("key").to_pylist(), keys.column("was").to_pylist(), keys.column("now").to_pylist()))
            made = CuckooFilter.of(old.column("cells")[0].as_py()) if old.num_rows else CuckooFilter.build([])
            made.delete([k for k, was, now in rows if was and not now])
            if not made.insert([k for k, was, now in rows if now and not was]):
                made = CuckooFilter.build([k for k, _, now in rows if now])
            return pa.table({"shard": [shard], "cells": pa.array([made.cells.tobytes()], pa.binary())})

        filters = self.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(change, "shard long, cells binary")
        return LineIndex(holdings, counts, stored(filters), self.shards, self.min_chars, self.min_docs)

    def grouped(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """(shard, salt, doc_id, key) from rows (doc_id, key), and the number of salts: a group has about ROWS_PER_GROUP rows, however few keys are crowded and however hot one is."""
        most = self.counts.agg(F.max("n_docs")).first()[0] or 0
        salts = max(1, -(-most // ROWS_PER_GROUP), -(-rows.count() // (self.shards * ROWS_PER_GROUP)))
        return rows.select(_shard(self.shards).alias("shard"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(salts)).alias("salt"), "doc_id", "key"), salts

    def dropped(self, holdings: DataFrame | None = None) -> DataFrame:
        """(doc_id, keys array): the lines that each document loses."""
        rows = self.holdings if holdings is None else holdings
        crowded = self.counts.filter(F.col("n_docs") >= self.min_docs).select("key", "largest")
        rows, salts = self.grouped(rows)
        copies = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))

        def probe(rows: pa.Table, held: pa.Table) -> pa.Table:
            own = rows.select(["doc_id", "key"])
            if not held.num_rows or not rows.num_rows:
                return own.slice(0, 0)
            return own.filter(pa.array(CuckooFilter.of(held.column("cells")[0].as_py()).contains(own.column("key").to_pylist())))

        passed = rows.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(probe, "doc_id long, key binary")
        return passed.join(crowded, "key").filter("doc_id <> largest").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards))


def deduplicate(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row struct of all columns of ``docs``, text of the remaining lines, n_lines, n_dropped, kept_sha256), one row per row of ``docs``.

    Keys found in at least ``min_docs`` different documents lose all their lines except in the largest doc_id that holds them. A null or
    empty text is one empty line and comes back empty. Rows without doc_id keep their text. Repeated rows count as one document and are all
    treated alike. Other columns pass through inside ``row``, whatever their names; an empty table stays empty.
    """
    dropped = LineIndex.build(docs, min_chars, min_docs).dropped()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    wide = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(dropped.withColumnRenamed("doc_id", "id"), "id", "left").select("row", "text", "keys")
    schema = T.StructType([wide.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def rebuild(batches):
        for whole in batches:
            for batch in pieces(whole):
                kept, n, gone, sha = [], [], [], []
                for text, keys in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("keys").to_pylist()):
                    lines = text.split(b"\n")
                    rest = lines
                    if keys:
                        keys = set(keys)
                        rest = [x for x in lines if line_key(x, min_chars) not in keys]
                        text = b"\n".join(rest)
                    kept.append(text)
                    n.append(len(lines))
                    gone.append(len(lines) - len(rest))
                    sha.append(hashlib.sha256(text).hexdigest())
                yield pa.record_batch([batch.column("row"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["row", "text", "n_lines", "n_dropped", "kept_sha256"])

    return wide.mapInArrow(rebuild, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text").filter("doc_id is not null"))
    return out.select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")


OP10_SQL = """
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents where doc_id is not null
),
keyed as (
    select doc_id, pos, line,
        translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
),
crowded as (select key, max(doc_id) as largest from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
judged as (select k.doc_id, k.pos, k.line, c.key is not null and k.doc_id <> c.largest as gone from keyed k left join crowded c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Crowded lines go from every text but one; n_chars follows the text. No document is dropped."""
    chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    columns = [F.col("text") if c == "text" else chars.alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return deduplicate(docs).select(*columns)
