"""Repeated byte strings over a whole corpus, after the manner of prefix-free parsing.

* Parse: the trigger of a window of ``length`` bytes is its k-gram with the smallest rolling hash. Windows that follow each other mostly share their trigger,
  and the stretch of bytes that all windows of one trigger occurrence cover is a phrase. Every window lies in exactly one phrase, and equal windows lie
  at equal places in phrases of equal triggers: phrases can be compared on their own, and a repeat can never be missed.
* Dictionary: phrases are grouped by trigger, and equal phrases become one entry with its number of occurrences. An entry that occurs twice repeats as a whole. A trigger
  with a single entry that occurs once repeats nowhere. Highly repetitive text collapses here, whatever its size.
* Suffixes: only where a trigger has several entries, the suffixes of each dictionary entry (its windows) are sorted and matched against each other, in shards by
  fingerprint; this decides repeats that start or end inside a phrase.

Neither the text nor the dictionary is ever in one place: documents stay in their batches, triggers and suffixes go to shards as 64-bit fingerprints, a
few bits come back. Suffix order is needed only to bring equal windows together, so shards sort fingerprints instead of the bytes themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelbase.llm.exchange import ask, answered, dealt, pack, spread, unpack, visit
from wheelbase.llm.frames import table, texts
from wheelbase.llm.words import BYTE_VALUE, U, mix, pieces, powers, utf8

LENGTH = 200
GRAM = 32
BATCH_BYTES = 2_000_000
KEYS_PER_SHARD = 400_000
LEAST_SHARDS = 32


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUE[data] * up[:-1], out=out[1:])
    return out


def fingerprints(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the byte strings start..end."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w numbers in a row, in constant time for each."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    ahead = np.minimum.accumulate(padded.reshape(-1, w), axis=1).ravel()
    behind = np.minimum.accumulate(padded.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1:n])


def parse(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of a batch: first window, number of windows, place of the trigger."""
    none = np.zeros(0, np.int64)
    valid = np.zeros(len(data) + 1, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        valid[a:max(a, b - length + 1)] = True
    start = np.flatnonzero(valid)
    if not len(start):
        return none, none, none
    gram = min(GRAM, length)
    at = np.arange(len(data) - gram + 1)
    grams = fingerprints(prefix_sums(data), at, at + gram)
    # Ties go to the earlier place, which is the same one in equal windows.
    least = sliding_least(grams >> U(24) << U(24) | at.astype(U), length - gram + 1)
    trigger = (least[start] & U(2**24 - 1)).astype(np.int64)
    new = np.r_[True, (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1)]
    return start[new], np.diff(np.r_[np.flatnonzero(new), len(start)]), trigger[new]


class Parsed:
    """A batch with its phrases; fingerprints are worked out again when they are asked for, which is cheaper than to store them."""

    def __init__(self, body: bytes, length: int):
        x = unpack(body)
        self.ids, self.data, self.offsets, self.length = x["ids"], x["data"], x["offsets"].astype(np.int64), length
        self.first = np.cumsum(x["step"].astype(np.int64))
        self.count = x["count"].astype(np.int64)
        self.where = self.first + x["place"].astype(np.int64)
        self.sums = prefix_sums(self.data)
        self.trigger = fingerprints(self.sums, self.where, self.where + min(GRAM, length))

    def shard(self, shards: int) -> np.ndarray:
        return (mix(self.trigger) % U(shards)).astype(np.int64)

    def phrase(self) -> np.ndarray:
        whole = fingerprints(self.sums, self.first, self.first + self.count - 1 + self.length)
        return mix(whole + (self.where - self.first).astype(U) * U(0x9E3779B97F4A7C15))

    def flags(self, got: dict, shards: int) -> np.ndarray:
        out = np.zeros(len(self.first), np.uint8)
        for shard, _, places in spread(self.shard(shards), {}) if len(out) else ():
            out[places] = got[shard]["flags"]
        return out

    def suffixes(self, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints of all windows of the phrases to be matched, their starts, and whether the phrase occurs again."""
        chosen = np.flatnonzero(flag & 2)
        count = self.count[chosen]
        start = np.repeat(self.first[chosen], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return fingerprints(self.sums, start, start + self.length), start, np.repeat((flag[chosen] & 1).astype(bool), count)


def batches(docs: DataFrame, length: int) -> DataFrame:
    """(batch, body): texts of about BATCH_BYTES with their parse. A longer text has a batch of its own; a text over 16 MB is cut where no window is lost."""

    def make(parts):
        number = TaskContext.get().partitionId() << 32
        for whole in parts:
            for batch in pieces(whole, most=BATCH_BYTES):
                data, offsets = utf8(batch.column("text"))
                first, count, where = parse_long(data, offsets, length)
                body = pack({"ids": batch.column("doc_id").to_numpy(), "offsets": offsets, "data": data, "step": np.diff(first, prepend=0), "count": count, "place": where - first})
                yield pa.record_batch({"batch": pa.array([number], pa.int64()), "body": pa.array([body], pa.binary()), "phrases": pa.array([len(first)], pa.int64())})
                number += 1

    return texts(docs).mapInArrow(make, "batch long, body binary, phrases long")


def parse_long(data: np.ndarray, offsets: np.ndarray, length: int, most: int = 1 << 23) -> tuple[np.ndarray, ...]:
    """``parse`` of a batch of any size: windows are dealt to parts of at most ``most`` starts, each with the bytes that its windows need."""
    if len(data) <= most:
        return parse(data, offsets, length)
    made = []
    for a in range(0, len(data), most):
        b = min(len(data), a + most + length - 1)
        cut = np.unique(np.clip(offsets, a, b)) - a
        cut = np.unique(np.r_[0, cut, b - a])
        first, count, where = parse(data[a:b], cut, length)
        made.append((first + a, count, where + a))
    return tuple(np.concatenate(x) for x in zip(*made))


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans long, spans (start, end byte offsets), kept_sha256.

    A byte is removed if a string of ``length`` bytes that covers it starts at another place of the corpus too, in whatever document; overlapping occurrences count. Null and
    empty texts have no bytes. A repeated row is an occurrence like any other, so the same text in two rows is a repeat. Rows without doc_id are left
    out; an empty table gives no rows; other columns are ignored.
    """
    held = dealt(batches(docs, length))
    total = held.agg(F.sum("phrases")).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // KEYS_PER_SHARD))
    held = held.select("batch", "body")

    def phrases(number, body, _):
        x = Parsed(body, length)
        if len(x.first):
            for shard, own, _ in spread(x.shard(shards), {"trigger": x.trigger, "phrase": x.phrase()}):
                yield shard, own

    def judge(requests):
        """Per phrase: 1 if it occurs again, 2 if its suffixes must be matched with those of other entries; one occurrence of an entry does that for all."""
        trigger, phrase = (np.concatenate([r[k].astype(U) for r in requests]) for k in ("trigger", "phrase"))
        order = np.lexsort((phrase, trigger))
        t, p = trigger[order], phrase[order]
        new_t = np.r_[True, t[1:] != t[:-1]]
        new = new_t | np.r_[True, p[1:] != p[:-1]]
        entry, group = np.cumsum(new) - 1, np.cumsum(new_t) - 1
        again = np.bincount(entry)[entry] > 1
        several = np.bincount(group[new])[group] > 1
        flags = np.zeros(len(t), np.uint8)
        flags[order] = again + 2 * (several & new)
        edges = np.cumsum([0, *[len(r["trigger"]) for r in requests]])
        return [{"flags": flags[a:b]} for a, b in zip(edges, edges[1:])], None

    flags = answered(ask(held, None, phrases), judge)

    def suffixes(number, body, got):
        x = Parsed(body, length)
        key, _, again = x.suffixes(x.flags(got, shards))
        for shard, own, _ in spread((key >> U(40)).astype(np.int64) % shards, {"key": key, "again": again.astype(np.uint8)}):
            yield shard, own

    def match(requests):
        """Per suffix: whether another one is equal to it, or its own entry occurs again."""
        key = np.concatenate([r["key"].astype(U) for r in requests])
        weight = np.concatenate([r["again"] for r in requests]).astype(np.int64) + 1
        _, place = np.unique(key, return_inverse=True)
        twice = np.bincount(place, weights=weight)[place] > 1.5
        edges = np.cumsum([0, *[len(r["key"]) for r in requests]])
        return [{"twice": np.packbits(twice[a:b])} for a, b in zip(edges, edges[1:])], None

    matched = answered(ask(held, flags, suffixes), match)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string"
    both = flags.unionByName(matched.select("batch", (-F.col("shard") - 1).alias("shard"), "body"))

    def remove(number, body, got):
        if not body:
            return pa.table({n: pa.array([], t) for n, t in KINDS})
        x = Parsed(body, length)
        data, offsets = x.data, x.offsets
        flag = x.flags(got, shards)
        edge = np.zeros(len(data) + 1, np.int64)
        whole = np.flatnonzero(flag & 1)
        np.add.at(edge, x.first[whole], 1)
        np.add.at(edge, x.first[whole] + x.count[whole] - 1 + length, -1)
        key, start, _ = x.suffixes(flag)
        if len(key):
            twice = np.zeros(len(key), bool)
            for shard, _, places in spread((key >> U(40)).astype(np.int64) % shards, {}):
                twice[places] = np.unpackbits(got[-shard - 1]["twice"])[: len(places)].astype(bool)
            np.add.at(edge, start[twice], 1)
            np.add.at(edge, start[twice] + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = {n: [] for n, _ in KINDS}
        for doc, a, b in zip(x.ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            own = gone[a:b]
            turn = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
            spans = [{"start": s, "end": e} for s, e in turn.reshape(-1, 2).tolist()]
            for name, value in zip(out, (doc, b - a, int(own.sum()), len(spans), spans, hashlib.sha256(data[a:b][~own].tobytes()).hexdigest())):
                out[name].append(value)
        return pa.table({n: pa.array(out[n], t) for n, t in KINDS})

    return visit(held, both, remove, schema)


KINDS = (
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string()),
)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
