"""Benchmark decontamination by pigeonhole edit matching.

Both sides are normalised to lower-case word characters with single spaces. An item of m characters has a budget of k = m * ``ERRORS`` edits. It is cut into
k + 1 pieces; a passage within k edits must hold at least one piece unchanged, so exact piece hits (one Aho-Corasick pass over the whole
text) find every candidate, and Myers' bit-parallel distance decides it. Nothing within the budget is missed. An item of fewer than ``LEAST_WORDS`` words
has no budget and must stand between word borders, as a few letters within a few edits are everywhere.

The items travel in blocks of bounded size (``BLOCK_ITEMS``, ``BLOCK_CHARS``), one scan of the documents for each block; documents are never shuffled.
"""

from __future__ import annotations

import re
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelbase.llm.frames import table
from wheelbase.llm.words import pieces

ERRORS = 0.08
LEAST_WORDS = 8
BLOCK_ITEMS = 5_000
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"\w+")


def normal(text: str | None) -> str:
    return " ".join(WORD.findall((text or "").lower()))


def cut(pattern: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their offsets."""
    n = budget + 1
    edges = [i * len(pattern) // n for i in range(n + 1)]
    return [(a, pattern[a:b]) for a, b in zip(edges, edges[1:])]


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of the whole pattern anywhere in the text, the first one; None beyond the budget.

    Columns of the edit table are kept as two bit vectors of vertical differences, one bit for each pattern character.
    """
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, letter in enumerate(pattern):
        where[letter] = where.get(letter, 0) | 1 << i
    plus, minus, score = full, 0, m
    best, at = budget + 1, -1
    for j, letter in enumerate(text):
        eq = where.get(letter, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        # A match may start anywhere, so the top row stays 0: nothing is shifted in.
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        if score < best:
            best, at = score, j + 1
    return (best, at) if best <= budget else None


class Finder:
    """Matches of a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS):
        self.items = [(key, text, int(len(text) * errors) if long_enough(text) else 0) for key, text in items]
        holders: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget) in enumerate(self.items):
            for offset, piece in cut(text, budget):
                holders.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, own in holders.items():
            self.automaton.add_word(piece, (len(piece), own))
        if holders:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, budget, end in the normalised text) for each item that occurs within its budget: its best text and the first end of it."""
        if not len(self.automaton):
            return []
        diagonals: dict[int, list[int]] = {}
        for end, (size, own) in self.automaton.iter(text):
            for n, offset in own:
                diagonals.setdefault(n, []).append(end + 1 - size - offset)
        out: dict[int, tuple[int, int, int]] = {}
        for n, starts in diagonals.items():
            key, pattern, budget = self.items[n]
            best = None
            if not long_enough(pattern):
                bordered = [a + len(pattern) for a in starts if text[a - 1:a] in ("", " ") and text[a + len(pattern):][:1] in ("", " ")]
                best = (0, min(bordered)) if bordered else None
            elif (exact := text.find(pattern)) >= 0:
                best = (0, exact + len(pattern))
            else:
                starts.sort()
                low = high = starts[0]
                for start in [*starts[1:], None]:
                    if start is not None and start - high <= len(pattern):
                        high = start
                        continue
                    a = max(0, low - budget)
                    found = myers(pattern, text[a:high + len(pattern) + budget], budget)
                    if found and (best is None or found[0] < best[0]):
                        best = (found[0], a + found[1])
                    low = high = start
            if best and (key not in out or (best[0], best[1]) < (out[key][0], out[key][2])):
                out[key] = (best[0], budget, best[1])
        return [(key, *found) for key, found in out.items()]


def long_enough(pattern: str) -> bool:
    return pattern.count(" ") + 1 >= LEAST_WORDS


def blocks(items: DataFrame) -> list[list[tuple[int, str]]]:
    """The items, in lists of bounded size, all texts of an item in the same list; null ones and those without a word character are left out."""
    usable = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    count, chars = usable.agg(F.count("*"), F.sum(F.char_length("text"))).first()
    n = max(1, -(-count // BLOCK_ITEMS), -(-(chars or 0) // BLOCK_CHARS))
    out = []
    for k in range(n):
        rows = usable.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()  # one block
        own = [(r.item_id, normal(r.text)) for r in rows]
        own = [(key, text) for key, text in own if text]
        if own:
            out.append(own)
    return out


def leaks(docs: DataFrame, items: DataFrame, errors: float = ERRORS) -> DataFrame:
    """(doc_id, item_id, distance, budget, end_at), one row for each document and item that it holds within the item's budget.

    Null or empty texts hold nothing. Repeated rows of a document give repeated result rows, and so do different texts of one doc_id; an item_id with several texts
    counts with the one that fits best. Rows without doc_id are left out. Other columns are ignored; without usable items or documents the result is empty.
    """
    docs = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, distance int, budget int, end_at long"

    def searched(own: list[tuple[int, str]]) -> DataFrame:
        def search(batches):
            finder = Finder(own, errors)
            for whole in batches:
                for batch in pieces(whole):
                    rows = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for hit in finder.find(normal(text))]
                    columns = list(zip(*rows)) if rows else [[]] * 5
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["doc_id", "item_id", "distance", "budget", "end_at"])

        return docs.mapInArrow(search, schema)

    parts = [searched(own) for own in blocks(items)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its budget go; all others stay as they are. Every row is judged by its own text, with or without a doc_id.

    A block of items is one filter over the rows; the filters follow each other in one pass, without a shuffle.
    """
    def free_of(own: list[tuple[int, str]]):
        def keep(batches):
            finder = Finder(own)
            for whole in batches:
                for batch in pieces(whole):
                    free = [not text or not finder.find(normal(text)) for text in batch.column("text").to_pylist()]
                    yield batch.filter(pa.array(free, pa.bool_()))

        return keep

    for own in blocks(table(spark, sf_dir, "benchmark")):
        docs = docs.mapInArrow(free_of(own), docs.schema)
    return docs
