"""Toxicity scores: Levenshtein automata run over a lexicon trie, with context windows that tell quotation from abuse.

* The lexicon is learned: words and word beginnings (``term*``) that mark toxic training documents, by log odds of document frequency. Counts combine
  in the tasks and in Spark; only the chosen terms, at most ``LEXICON`` of them, reach the driver.
* All terms share one trie. The product of the trie with the Levenshtein automata of its terms is determinised as words ask for it
  and kept, so a word costs a few dictionary steps, and nearly all words die within three letters. Terms of 5 letters or more allow one edit, of 9 or more two.
* Each hit looks at ``WINDOW`` words on both sides: inside quotation marks or next to a reporting mark it counts as quoted, and other hits
  nearby strengthen it. A ridge logistic regression on eight document features gives the score.

Learning uses a bounded sample of the labelled training rows (``TRAIN_ROWS``, smallest hash of the id first). Scoring covers every row and the whole text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelbase.llm.frames import bucket_of_id, stored, table
from wheelbase.llm.words import pieces

TRAIN_ROWS = 12_000
LEXICON = 200
LEAST_LOG_ODDS = 3.0
LEAST_DOCS = 4
PREFIXES = range(4, 9)
WINDOW = 8
SEEN = 400_000
FEATURES = ("any", "exact", "fuzzy", "stem", "quoted", "window", "density", "distinct")
TOKEN = re.compile(r"[^\W_]+")
QUOTES = re.compile("[\"“”„«»‹›‘’`]")
REPORTED = re.compile(r"\b(?:quote[ds]?|quoting|said|says|wrote|called|calls|term|word|slur|insult)\b|:\s*$", re.I)


def edits_for(term: str) -> int:
    if term.endswith("*"):
        return 0
    return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


class LexiconAutomaton:
    """A trie of terms, walked with edits; ``match(word)`` gives the best (edits, term) or None."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.room = [0]
        for term in terms:
            node, room = 0, edits_for(term)
            self.room[0] = max(self.room[0], room)
            for letter in term.rstrip("*"):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.stem.append(None)
                    self.room.append(0)
                node = self.children[node][letter]
                self.room[node] = max(self.room[node], room)
            if term.endswith("*"):
                self.stem[node] = term
            else:
                self.term[node] = term
        self.states: dict[frozenset, int] = {}
        self.arcs: list[dict[str, int]] = []
        self.members: list[frozenset] = []
        self.accept: list[tuple[int, str] | None] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        """The number of the state that holds each node with its fewest edits, letters of terms left out included."""
        todo = list(edits)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                more = edits[node] + 1
                if more <= self.room[child] and more < edits.get(child, 99):
                    edits[child] = more
                    todo.append(child)
        key = frozenset(edits.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.arcs.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] and e <= edits_for(self.term[n])]
            ends += [(e, self.stem[n]) for n, e in key if self.stem[n] and e == 0]
            self.accept.append(min(ends) if ends else None)
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.room[node] and edits < after.get(node, 99):
                after[node] = edits

        for node, edits in self.members[state]:
            put(node, edits + 1)
            for other, child in self.children[node].items():
                put(child, edits + (other != letter))
            if self.stem[node] and edits == 0:
                after[node] = 0
        return self._state(after)

    def match(self, word: str) -> tuple[int, str] | None:
        state = self.start
        for letter in word:
            arcs = self.arcs[state]
            if letter not in arcs:
                arcs[letter] = self._step(state, letter)
            state = arcs[letter]
            if state == self.dead:
                return None
        return self.accept[state]


class Matcher:
    """Finds lexicon hits in texts; remembers the words it has seen, up to ``SEEN`` of them."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.automaton = weights, LexiconAutomaton(sorted(weights))
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[int, str]] = {}

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = TOKEN.findall(low)
        own = set(words)
        if len(self.seen) > SEEN:
            self.seen.clear()
        for word in own - self.seen:
            if found := self.automaton.match(word):
                self.hits[word] = found
        self.seen |= own
        if self.hits.keys().isdisjoint(own):
            return [0.0] * len(FEATURES)
        exact = fuzzy = stem = quoted = 0.0
        spans = [m for m in TOKEN.finditer(low) if m[0] in self.hits]
        index = [i for i, w in enumerate(words) if w in self.hits]
        weighed, terms = [], set()
        for span in spans:
            edits, term = self.hits[span[0]]
            value = self.weights[term]
            before, after = low[max(0, span.start() - 7 * WINDOW):span.start()], low[span.end():span.end() + 7 * WINDOW]
            if QUOTES.search(before) and QUOTES.search(after) or REPORTED.search(before[-24:]):
                quoted += value
                value *= 0.25
            elif term.endswith("*"):
                stem += value
            elif edits:
                fuzzy += value / (1 + edits)
            else:
                exact += value
            terms.add(term)
            weighed.append(value)
        best, at = 0.0, 0
        for i in range(len(index)):
            while index[i] - index[at] > 2 * WINDOW:
                at += 1
            best = max(best, sum(weighed[at:i + 1]))
        log = math.log1p
        return [1.0, log(exact), log(fuzzy), log(stem), log(quoted), log(best), log(1000 * sum(weighed) / max(len(words), 1)) / 3, log(len(terms))]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale @ self.coefficients[1:] + self.coefficients[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, train, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled rows that ``train`` admits, those with the smallest hash of the id. Null labels do not count."""
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(train)
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` pairs of numbers, so the hint is safe.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _terms(texts_: list[str], toxic: list[int], into: dict[str, list[int]]) -> None:
    for text, label in zip(texts_, toxic):
        words = {w for w in TOKEN.findall(text.lower()) if len(w) > 2}
        forms = words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}
        for form in forms:
            into.setdefault(form, [0, 0])[label] += 1


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """term -> log odds, for the terms that mark toxic rows; a stem (``term*``) replaces the words it covers when it marks more of them."""

    def count(batches):
        into: dict[str, list[int]] = {}
        for batch in batches:
            _terms(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), into)
        marked = [(k, *v) for k, v in into.items()]
        for a in range(0, len(marked), 50_000):
            part = list(zip(*marked[a:a + 50_000]))
            yield pa.record_batch([pa.array(part[0], pa.string()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())], ["term", "clean", "toxic"])

    totals = rows.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    clean_n, toxic_n = totals[0], totals[1]
    if not clean_n or not toxic_n:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (toxic_n + 1)) - F.log((F.col("clean") + 0.5) / (clean_n + 1))
    counted = rows.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = counted.filter(F.col("toxic") >= LEAST_DOCS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_LOG_ODDS)
    best = best.orderBy(F.desc("toxic"), F.desc(F.length("term")), "term").limit(20 * LEXICON).collect()
    chosen: dict[str, float] = {}
    plain = {row.term: row.toxic for row in best if not row.term.endswith("*")}
    for row in best:
        word = row.term.rstrip("*")
        covered = any(word[:n] + "*" in chosen for n in PREFIXES)
        # A stem that is little more than one word gives way to that word, which is then matched with edits.
        if row.term.endswith("*") and any(t.startswith(word) and n >= 0.8 * row.toxic for t, n in plain.items()):
            continue
        inside = any(t.rstrip("*").startswith(word) for t in chosen) if row.term.endswith("*") else False
        if not covered and not inside and len(chosen) < LEXICON:
            chosen[row.term] = float(row.odds)
    return chosen


def fit(rows: DataFrame) -> ToxicityModel:
    """Lexicon and regression from (text, toxic) rows; without both classes the score is the base rate of the rows."""
    rows = stored(rows)
    weights = learn_lexicon(rows)

    def measure(batches):
        matcher = Matcher(weights)
        for batch in batches:
            made = [matcher.features(x) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(made, pa.list_(pa.float64())), batch.column("toxic")], ["features", "toxic"])

    got = rows.mapInArrow(measure, "features array<double>, toxic int").collect()  # TRAIN_ROWS short vectors at most
    y = np.array([r.toxic for r in got], float)
    x = np.array([r.features for r in got], float).reshape(len(got), len(FEATURES))
    mean, scale = np.zeros(len(FEATURES)), np.ones(len(FEATURES))
    coefficients = np.zeros(len(FEATURES) + 1)
    coefficients[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -2.0
    if weights and 0 < y.sum() < len(y):
        scale = np.maximum(x.std(axis=0), 1e-9)
        scale[x.std(axis=0) == 0] = 1
        design = np.c_[np.ones(len(y)), (x - mean) / scale]
        ridge = np.diag([1e-6] + [0.5] * len(FEATURES))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ coefficients, -30, 30)))
            step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ coefficients)
            coefficients += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
    return ToxicityModel(weights, mean, scale, coefficients)


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; a null, empty or blank text gets the score of a text without hits."""

    def run(batches):
        matcher = Matcher(model.weights)
        for whole in batches:
            for batch in pieces(whole):
                made = np.array([matcher.features(x or "") for x in batch.column("text").to_pylist()]).reshape(batch.num_rows, len(FEATURES))
                yield pa.record_batch([batch.column("doc_id"), pa.array(model.score(made))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all rows that have a doc_id; labels are learned from the rows whose crc32 remainder is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("doc_id is not null")
    model = fit(sample(docs, table(spark, sf_dir, "labels"), bucket_of_id(5) != 0))
    out = scored(docs, model)
    return out.select("doc_id", (bucket_of_id(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; all columns of the others stay. Rows without an id are judged like any other."""
    model = fit(sample(docs, table(spark, sf_dir, "labels"), bucket_of_id(5) != 0))
    schema = docs.schema

    def keep(batches):
        matcher = Matcher(model.weights)
        for whole in batches:
            for batch in pieces(whole):
                made = np.array([matcher.features(x or "") for x in batch.column("text").to_pylist()]).reshape(batch.num_rows, len(FEATURES))
                yield batch.filter(pa.array(model.score(made) < 0.5))

    return docs.mapInArrow(keep, schema)
