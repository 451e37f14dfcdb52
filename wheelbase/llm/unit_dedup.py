"""Substring dedup on hashed units: the earliest occurrence of a repeated passage stays, the others go, and their offsets are kept.

A text is cut into paragraphs (at blank lines), lines, or the sentences of its lines; the finest level also finds passages that start in the middle of
a line. A unit is normalised (lower case, runs of white space as one space, ends trimmed) and told by 128 bits. Digests are grouped over the corpus, and the
earliest occurrence, in the order (doc_id, version of its text, position), is its owner. Later ones are repeats. Repeats that follow each other in a document form
a run, and a run of at least ``min_words`` words is removed, so short phrases that many clean texts share stay where they are.

Grouping keeps one minimum per digest and combines before the shuffle; digests that occur once never meet the documents again; the join that tells each
occurrence its owner is one that Spark can split, so a unit that a third of all documents hold is no hot task.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wheelbase.llm.frames import stored, table, versions
from wheelbase.llm.words import pieces

MIN_WORDS = 15
LEVELS = {
    "paragraph": re.compile(r"\n[^\S\n]*\n\s*"),
    "line": re.compile(r"\n"),
    "sentence": re.compile(r"\n|(?<=[.!?])[ \t]+"),
}


def units(text: str, level: str = "sentence") -> list[tuple[int, int]]:
    """(start, end) of the units of a text, in code points, without the separators between them and without blank units."""
    edges, at = [], 0
    for gap in LEVELS[level].finditer(text):
        edges.append((at, gap.start()))
        at = gap.end()
    edges.append((at, len(text)))
    return [(a, b) for a, b in edges if b > a and not text[a:b].isspace()]


def unit_digest(unit: str) -> tuple[bytes, int]:
    words = unit.lower().split()
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest(), len(words)


def hashed_units(docs: DataFrame, level: str) -> DataFrame:
    """(doc_id, version, digests array<binary>) per row: the digest of each unit in its place."""

    def cut(batches):
        for whole in batches:
            for batch in pieces(whole):
                made = [[unit_digest(t[a:b])[0] for a, b in units(t, level)] for t in batch.column("text").to_pylist()]
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "version": batch.column("version"), "digests": pa.array(made, pa.list_(pa.binary()))})

    return docs.mapInArrow(cut, "doc_id long, version long, digests array<binary>")


def repeats(docs: DataFrame, level: str) -> DataFrame:
    """(doc_id, version, repeated array<int>): the units of each document that have an earlier occurrence. Rows of ``docs``: (doc_id, text, version)."""
    place = ("doc_id", "version", "pos")
    placed = stored(hashed_units(docs, level)).select("doc_id", "version", F.posexplode("digests").alias("pos", "digest"))
    owners = placed.groupBy("digest").agg(F.min(F.struct(*place)).alias("owner"), F.count("*").alias("n")).filter("n > 1").select("digest", "owner")
    owners = stored(owners)  # the join then stands directly on two shuffles, and Spark can split a hot digest
    later = placed.join(owners, "digest").filter(F.struct(*place) != F.col("owner"))
    return later.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("repeated"))


def deduplicate(docs: DataFrame, level: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_units, n_removed long, removed array<struct<start, end>> (code points of the input text), kept_text.

    A removed run reaches from its first unit to the start of the unit that follows it. Null and empty texts have no units and come back empty. Rows equal in doc_id and text are one
    document, not repeats of each other, and get equal result rows; rows of one doc_id with different texts are different documents. Rows without doc_id are left out.
    Ties between occurrences cannot arise, as (doc_id, version, position) is unique.
    An empty table gives no rows; other columns are ignored.
    """
    docs = versions(docs)
    schema = T.StructType.fromDDL("doc_id long, n_units long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")

    def remove(batches):
        for whole in batches:
            for batch in pieces(whole):
                rows = []
                for doc, text, repeated in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("repeated").to_pylist()):
                    spans = units(text, level)
                    gone, n_removed = [], 0
                    marked = sorted(p for p in repeated or [] if p < len(spans))
                    at = 0
                    while at < len(marked):
                        end = at
                        while end + 1 < len(marked) and marked[end + 1] == marked[end] + 1:
                            end += 1
                        first, last = marked[at], marked[end]
                        if sum(len(text[a:b].split()) for a, b in spans[first:last + 1]) >= min_words:
                            gone.append((spans[first][0], spans[last + 1][0] if last + 1 < len(spans) else spans[last][1]))
                            n_removed += last - first + 1
                        at = end + 1
                    kept, edge = [], 0
                    for a, b in gone:
                        kept.append(text[edge:a])
                        edge = b
                    kept.append(text[edge:])
                    rows.append({"doc_id": doc, "n_units": len(spans), "n_removed": n_removed, "removed": [{"start": a, "end": b} for a, b in gone], "kept_text": "".join(kept)})
                kinds = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return docs.join(repeats(docs, level), ["doc_id", "version"], "left").select("doc_id", "text", "repeated").mapInArrow(remove, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_units, n_removed, spans (start:end of the removed parts), kept_sha256 of the remaining text."""
    out = deduplicate(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return out.select("doc_id", "n_units", "n_removed", spans.alias("spans"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
