"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver, whatever the corpus size. The plan is a list of patterns (lengths that share a
sequence) with multiplicities; every pattern uses up at least one length, so its size is bounded by the capacity too. Pieces are then ranked within their
length, in slices, and each finds its pattern, sequence and place by binary search: no piece is ever gathered in one task.

The plan: best-fit decreasing gives an incumbent. Bin completion then takes the longest remaining piece, enumerates the undominated fillings of the
room around it (of equal sums the one with the longest pieces), best first, and applies one as often as the stock allows. A branch is cut when
its waste leaves no chance to beat the incumbent; the search ends at the lower bound or after ``NODES`` patterns.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wheelbase.llm.frames import stored, table, texts
from wheelbase.llm.words import pieces as parts

CAPACITY = 2048
END_ID = 0
NODES = 30_000
FILLING_NODES = 600
FILLINGS = 4
RANK_SLICE = 2_000

Plan = list[tuple[tuple[int, ...], int]]


# ---- the plan -------------------------------------------------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: total length, sharpened by the pieces that cannot share one."""
    if not counts:
        return 0
    size = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in size.tolist()], np.int64)
    best = -(-int((size * n).sum()) // capacity)
    for k in [0, *size[size <= capacity // 2].tolist()]:
        large, middle = size > capacity - k, (size <= capacity - k) & (2 * size > capacity)
        small = (size >= k) & (2 * size <= capacity)
        free = int((n * (capacity - size))[middle].sum())
        best = max(best, int(n[large | middle].sum()) + max(0, -(-(int((size * n)[small].sum()) - free) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Every piece goes where it leaves the least room; equal pieces and equally filled sequences are handled together."""
    rooms: list[int] = []  # sorted
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_:
            rooms.insert(bisect_left(rooms, room), room)
            open_[room] = []
        open_[room].append((pattern, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                if left >= each:
                    put(capacity - each * size, (size,) * each, left // each)
                if left % each:
                    put(capacity - left % each * size, (size,) * (left % each), 1)
                break
            room = rooms[at]
            pattern, n = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            used = min(n, left)
            if n > used:
                put(room, pattern, n - used)
            put(room - size, (*pattern, size), used)
            left -= used
    return [x for own in open_.values() for x in own]


def fillings(counts: dict[int, int], sizes: list[int], room: int) -> list[tuple[int, ...]]:
    """Up to FILLINGS undominated fillings of ``room``, the fullest first; ``sizes`` ascending. The first one found is the greedy one."""
    best: dict[int, tuple[int, ...]] = {}
    nodes = 0

    def go(below: int, room_left: int, chosen: tuple[int, ...]) -> bool:
        nonlocal nodes
        nodes += 1
        at = min(below, bisect_left(sizes, room_left + 1)) - 1
        extended = False
        while at >= 0 and nodes <= FILLING_NODES:
            size = sizes[at]
            most = min(counts[size], room_left // size)
            if most > 0:
                extended = True
                for copies in {most: 0, 1: 0}:
                    if go(at, room_left - copies * size, (*chosen, *(size,) * copies)):
                        return True
            at -= 1
        if not extended:
            total = room - room_left
            if total not in best or len(chosen) < len(best[total]):
                best[total] = chosen
            return room_left == 0 and len(best) >= 1
        return False

    go(len(sizes), room, ())
    return [best[s] for s in sorted(best, reverse=True)[:FILLINGS]] or [()]


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = NODES) -> Plan:
    counts = {int(s): int(n) for s, n in counts.items() if n}
    incumbent = best_fit_decreasing(counts, capacity)
    most = sum(n for _, n in incumbent)
    least = lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    stock, sizes = dict(counts), sorted(counts)
    done: list[tuple[tuple[int, ...], int]] = []
    used, waste = 0, 0
    stack: list[list[tuple[int, ...]]] = []

    def take(pattern: tuple[int, ...], n: int) -> None:
        for size in pattern:
            stock[size] -= n
            if stock[size] == 0:
                del sizes[bisect_left(sizes, size)]

    def give_back(pattern: tuple[int, ...], n: int) -> None:
        for size in pattern:
            if stock[size] == 0:
                sizes.insert(bisect_left(sizes, size), size)
            stock[size] += n

    while most > least and nodes > 0:
        if sizes and waste <= (most - 1) * capacity - total:
            size = sizes[-1]
            stock[size] -= 1
            options = [(size, *x) for x in fillings(stock, [x for x in sizes if stock[x] > 0], capacity - size)]
            stock[size] += 1
        else:
            if not sizes and used < most:
                incumbent, most = list(done), used
                if most == least:
                    break
            options = []
        stack.append(options)
        while stack and not stack[-1]:
            stack.pop()
            if not done:
                return incumbent
            pattern, n = done.pop()
            give_back(pattern, n)
            used, waste = used - n, waste - n * (capacity - sum(pattern))
        if not stack:
            break
        pattern = stack[-1].pop(0)
        need: dict[int, int] = {}
        for size in pattern:
            need[size] = need.get(size, 0) + 1
        n = min(stock[size] // own for size, own in need.items())
        take(pattern, n)
        done.append((pattern, n))
        used, waste = used + n, waste + n * (capacity - sum(pattern))
        nodes -= 1
    return incumbent


# ---- documents to pieces to places ------------------------------------------------------------------------------------


def tokenizer(path: str):
    """The byte-level BPE of a ``tokenizers`` file, as it stands: its added tokens are found in the text.

    A rank file is run by tiktoken, which gives the same ids at three times the speed; texts that hold an added token of the ``tokenizers`` file of the same name go through that file.
    """
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda text: own.encode(text, add_special_tokens=False).ids
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    twin = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(twin):
        return plain
    with open(twin, encoding="utf-8") as file:
        added = [token["content"] for token in json.load(file)["added_tokens"]]
    whole = cache(lambda: tokenizer(twin))  # read when the first such text comes
    return lambda text: whole()(text) if any(token in text for token in added) else plain(text)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenised(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece int, start, length long, ids_crc32 long[, ids array<int>]), one row for each piece of each row of ``docs``.

    A document is its ids and then END_ID. One that is longer than ``capacity`` is cut so that all pieces but the first are full. A null or empty text is one END_ID.
    ``vocabulary``: a public tokenizer file by name, or a path.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]

    def cut(batches):
        encode = tokenizer(vocabulary if "/" in vocabulary else vocabulary_path(vocabulary))
        for whole in batches:
            for batch in parts(whole):
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = np.array([*encode(text), END_ID], "<u4")
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for n, (a, b) in enumerate(zip(edges, edges[1:])):
                        own = ids[a:b]
                        rows.append((doc, n, a, b - a, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] if keep_ids else [])))
                columns = list(zip(*rows)) if rows else [[]] * len(names)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return texts(docs).mapInArrow(cut, schema)


def placed(made: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...); ``made`` should be a stored table, as it is read several times."""
    counts = {int(r.length): r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = counts.pop(capacity, 0)
    plan = bin_completion(counts, capacity, nodes)
    if full:
        plan = [*plan, ((capacity,), full)]
    # For each length: from which rank on it belongs to which pattern.
    spans: dict[int, list[tuple[int, int, list[int]]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, n in plan:
        places: dict[int, list[int]] = {}
        at = 0
        for size in pattern:
            places.setdefault(size, []).append(at)
            at += size
        for size, offsets in places.items():
            spans.setdefault(size, []).append((taken.get(size, 0), sequence, offsets))
            taken[size] = taken.get(size, 0) + n * len(offsets)
        sequence += n
    slices = max(1, -(-sum(counts.values(), full) // RANK_SLICE))
    cut = made.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    before = cut.groupBy("length", "slice").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("slice")) - F.col("n")).select("length", "slice", "before")
    ranked = cut.withColumn("own", F.row_number().over(W.partitionBy("length", "slice").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "slice"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "slice").select(*made.columns, "rank")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def find(batches):
        starts = {size: np.array([x[0] for x in own]) for size, own in spans.items()}
        for batch in batches:
            where, offset = [], []
            for size, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist()):
                start, first, offsets = spans[size][int(np.searchsorted(starts[size], rank, side="right")) - 1]
                number, slot = divmod(rank - start, len(offsets))
                where.append(first + number)
                offset.append(offsets[slot])
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "rank"]
            yield pa.record_batch([*columns, pa.array(where, pa.int64()), pa.array(offset, pa.int64())], [*(n for n in batch.schema.names if n != "rank"), "sequence_id", "offset"])

    return ranked.mapInArrow(find, schema)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces with their sequence and place. Repeated rows are packed as often as they occur; an empty table gives no rows; other columns are ignored."""
    return placed(stored(tokenised(docs, vocabulary, capacity, keep_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<int>): the sequences themselves, from pieces packed with ``keep_ids``; a group holds ``capacity`` ids at most."""
    gathered = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("own"))
    return gathered.select("sequence_id", F.flatten(F.col("own.ids")).alias("ids"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces of all remaining documents with sequence_id and offset."""
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
