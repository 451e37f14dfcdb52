"""Language ID with error-correcting output codes over byte n-gram classifiers.

Each language has a codeword. For every bit a logistic classifier over hashed byte n-grams (1 to 3 bytes, lower case, square roots of counts, unit length) predicts
whether it is set. Decoding adds up the logistic losses of all bits against each codeword, weighted by how sure a bit's classifier was in training, and
takes the codeword with the least loss; a small margin to the second one marks the row as ambiguous.

Up to ``EXHAUSTIVE`` languages all dichotomies are bits; beyond that, columns are drawn and kept where they set the closest codewords apart. Classifiers are fitted on at most
``TRAIN_ROWS`` training rows, spread evenly over the languages, smallest hash of the id first. Every row and its whole text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wheelbase.llm.frames import bucket_of_id, table
from wheelbase.llm.words import keyed, pieces, utf8

TRAIN_ROWS = 2_000
DIMENSIONS = 4096
EXHAUSTIVE = 6
LONG_CODE = 31
ROUNDS = 150
RIDGE = 1e-5
AMBIGUOUS = 0.2
UNKNOWN = "und"

# Bytes that are no letters become a space; bytes of longer characters stay.
LETTER = np.full(256, 32, np.uint32)
LETTER[97:123] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def codewords(n: int) -> np.ndarray:
    """n rows of +-1."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        columns = [[1 if m >> i & 1 else -1 for i in range(n)] for m in range(1, 2**n, 2) if m != 2**n - 1]
        return np.array(columns, float).T
    best = None
    for seed in range(64):
        bits = (keyed(n * LONG_CODE, 500 + seed) >> np.uint64(40) & np.uint64(1)).astype(float).reshape(n, LONG_CODE) * 2 - 1
        near = (bits @ bits.T - 2 * LONG_CODE * np.eye(n)).max()
        mixed = (np.abs(bits.sum(axis=0)) < n).all()
        if mixed and (best is None or near < best[0]):
            best = (near, bits)
    return best[1]


def features(column: pa.Array) -> np.ndarray:
    """One row of DIMENSIONS numbers for each text."""
    data, offsets = utf8(pc.utf8_lower(column))
    one = LETTER[data]
    two = one[:-1] | one[1:] << np.uint32(8)
    three = two[:-1] | one[2:] << np.uint32(16)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    hashed = [((x + np.uint32(977 * n)) * np.uint32(0x9E3779B1 + 2 * n)) >> shift for n, x in enumerate((one, two, three))]
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    for row, (a, b) in enumerate(zip(offsets, offsets[1:])):
        counts = sum(np.bincount(h[a:max(a, b - n)], minlength=DIMENSIONS) for n, h in enumerate(hashed))
        out[row] = np.sqrt(counts)
    return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-9)


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its share of exp(-loss), and whether the second one is close."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None]) @ self.trust
        chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
        chance /= chance.sum(axis=1, keepdims=True)
        top = np.sort(chance, axis=1)
        second = top[:, -2] if top.shape[1] > 1 else np.zeros(len(top))
        return loss.argmin(axis=1), top[:, -1], top[:, -1] - second < AMBIGUOUS


def sample(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, lang) of at most about ``rows`` rows, spread evenly over the languages; null texts and languages do not count."""
    usable = docs.filter("text is not null and lang is not null and doc_id is not null")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    each = max(20, rows // max(1, counts.count()))
    key = F.xxhash64("doc_id", "lang")
    share = F.least(F.lit(1.0), 2.0 * each / F.col("n") + 0.0)
    # A hash threshold per language leaves about twice the wanted rows; only those are ordered.
    thin = usable.select("doc_id", "lang").join(F.broadcast(counts.withColumn("share", share)) if counts.count() <= 10_000 else counts.withColumn("share", share), "lang")
    thin = thin.withColumn("key", key).filter((F.col("key") / F.lit(2.0**64) + 0.5) <= F.col("share"))
    chosen = thin.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("key", "doc_id"))).filter(F.col("place") <= each).select("doc_id").distinct()
    return usable.join(F.broadcast(chosen), "doc_id").select("text", "lang")


def fit(rows: DataFrame) -> LanguageModel | None:
    """Classifiers from (text, lang) rows, a bounded sample; None without rows."""

    def measure(batches):
        for whole in batches:
            for batch in pieces(whole):
                x = features(batch.column("text"))
                where = [np.flatnonzero(r) for r in x]
                yield pa.record_batch({"lang": batch.column("lang"), "at": pa.array([w.astype(np.int32).tobytes() for w in where], pa.binary()), "value": pa.array([r[w].tobytes() for r, w in zip(x, where)], pa.binary())})

    got = rows.mapInArrow(measure, "lang string, at binary, value binary").collect()  # TRAIN_ROWS sparse rows
    if not got:
        return None
    got.sort(key=lambda r: (r.lang, r.at, r.value))
    languages = sorted({r.lang for r in got})
    x = np.zeros((len(got), DIMENSIONS), np.float32)
    for row, r in enumerate(got):
        x[row, np.frombuffer(r.at, np.int32)] = np.frombuffer(r.value, np.float32)
    y = np.array([languages.index(r.lang) for r in got])
    codes = codewords(len(languages)).astype(np.float32)
    target = codes[y]
    share = 1 / np.bincount(y, minlength=len(languages))[y].astype(np.float32)
    share /= share.sum()
    weights, bias = np.zeros((DIMENSIONS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    first, second, first_b = np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(bias)
    for turn in range(1, ROUNDS + 1):
        slope = -target / (1 + np.exp(np.clip(target * (x @ weights + bias), -30, 30))) * share[:, None]
        grad = x.T @ slope + RIDGE * weights
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        weights -= 0.3 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-6)
        first_b = 0.9 * first_b + 0.1 * slope.sum(axis=0)
        bias -= 0.5 * first_b
    right = (share[:, None] * (np.sign(x @ weights + bias) == target)).sum(axis=0)
    trust = np.maximum(2 * right - 1, 0.05)
    return LanguageModel(languages, codes, weights, bias, (trust / trust.mean()).astype(np.float32))


def predicted(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row; a null text or one without a letter is ``und`` with score 0. Without a model all rows are."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, most=1_000_000):
                for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                    text = pc.fill_null(part.column("text"), "")
                    known = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
                    if model is None:
                        known = np.zeros(len(known), bool)
                        best, score, close = np.zeros(len(known), int), np.zeros(len(known)), known
                        names = [UNKNOWN]
                    else:
                        best, score, close = model.decode(features(text))
                        names = model.languages
                    lang = [names[i] if k else UNKNOWN for i, k in zip(best, known)]
                    yield pa.record_batch([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0).astype(float)), pa.array(close & known)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts every row that has a doc_id; repeated rows get equal predictions. Learns from the rows whose crc32 remainder is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").filter("doc_id is not null")
    model = fit(sample(docs.filter(bucket_of_id(4) != 2)))
    return predicted(docs, model).select("doc_id", (bucket_of_id(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
