"""Exact nearest neighbours by a block matrix join: int8 product tiles with error bounds, float rechecks, heaps.

Every vector x is kept as s * q with q in -127..127 and the exact length e of its rounding error. The product of two int8 tiles gives the distance
of the rounded vectors, and the true distance differs from it by at most e_x + e_y. A candidate survives if its lower bound does not exceed the k-th
smallest upper bound seen; survivors are recomputed from the original components in double precision, and heaps of k merge what tasks and tiles have found.

Queries come in blocks of bounded size (``QUERY_BLOCK``), each sent to one scan of all candidates, in tiles of ``TILE`` rows. A block's heaps
from all tasks are merged by a grouped top-k, k rows for each query and task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wheelbase.llm.frames import stored, table

K = 10
QUERY_BLOCK = 4096
TILE = 1024
CHUNK = 1024  # dimensions whose int8 products add up exactly in float32


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) without null ids and null, empty, zero or non-finite vectors; repeated rows count once."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    return rows.filter(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, squared length of the rounded vector, length of the error (a shade too large, never too small)."""
    top = np.abs(x).max(axis=1)
    scale = top / 127
    scale[scale == 0] = 1  # a subnormal top
    codes = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
    rounded = codes * scale[:, None]
    return codes, scale, (rounded**2).sum(axis=1), np.sqrt(((x - rounded) ** 2).sum(axis=1)) * (1 + 1e-9)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of two int8 tiles; float32 holds every partial sum of up to CHUNK products exactly."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], CHUNK):
        out += a[:, at:at + CHUNK].astype(np.float32) @ b[:, at:at + CHUNK].astype(np.float32).T
    return out


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in double precision; squares are added in the order of the components."""
    return np.sqrt(np.cumsum((x - y) ** 2, axis=1)[:, -1])


class Heaps:
    """The k nearest of each query so far, as (distance, vec_id)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.codes, self.scale, self.square, self.error = quantised(x)
        self.best = np.full((len(ids), k), np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, ids: np.ndarray, y: np.ndarray) -> None:
        codes, scale, square, error = quantised(y)
        near = self.square[:, None] + square[None, :] - 2 * products(self.codes, codes) * self.scale[:, None] * scale[None, :]
        near = np.sqrt(np.maximum(near, 0))
        # Rounding of these few double operations, far below the quantisation error.
        slack = (self.error[:, None] + error[None, :]) + 1e-7 * (np.sqrt(self.square)[:, None] + np.sqrt(square)[None, :])
        own = self.ids[:, None] == ids[None, :]
        upper = np.where(own, np.inf, near + slack)
        bound = self.best[:, -1]
        if upper.shape[1] >= self.k and len(np.unique(ids)) == len(ids):  # k bounds of k different ids
            bound = np.minimum(bound, np.partition(upper, self.k - 1, axis=1)[:, self.k - 1])
        q, c = np.nonzero((near - slack <= bound[:, None]) & ~own)
        if not len(q):
            return
        exact = distance(self.x[q], y[c])
        rows = np.r_[np.repeat(np.arange(len(self.ids)), self.k), q]
        d, who = np.r_[self.best.ravel(), exact], np.r_[self.who.ravel(), ids[c]]
        order = np.lexsort((d, who, rows))
        rows, d, who = rows[order], d[order], who[order]
        first = np.r_[True, (rows[1:] != rows[:-1]) | (who[1:] != who[:-1])] | ~np.isfinite(d)
        rows, d, who = rows[first], d[first], who[first]
        order = np.lexsort((who, d, rows))
        rows, d, who = rows[order], d[order], who[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(self.ids)))[rows]
        keep = place < self.k
        self.best, self.who = d[keep].reshape(-1, self.k), who[keep].reshape(-1, self.k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank int, vec_id, score): the k nearest ``vectors`` of every row of ``queries``, both (vec_id, embedding).

    Ties go to the smaller vec_id. A query is never its own neighbour; only vectors of its own dimension are. Unusable vectors (``usable``) take no
    part on either side. A candidate id that comes in several rows counts once, with its nearest vector; a query id with several vectors asks with the greatest array.
    Fewer candidates than k give fewer rows. Other columns are ignored.
    """
    candidates = usable(vectors)
    asked = stored(usable(queries).groupBy("vec_id").agg(F.max("v").alias("v")).withColumn("size", F.size("v")))
    sizes = asked.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect()
    parts = []
    for row in sizes:
        own = asked.filter(F.col("size") == row["size"])
        blocks = -(-row.n // block)
        for number in range(blocks):
            rows = own.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).orderBy("vec_id").select("vec_id", "v").collect()  # about ``block`` rows
            if rows:
                parts.append(_scan(candidates, np.array([r.vec_id for r in rows], np.int64), np.array([r.v for r in rows], float), k))
                if blocks > 1:
                    parts[-1] = stored(parts[-1])
    spark = vectors.sparkSession
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scan(candidates: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    size = x.shape[1]

    def scan(batches):
        heaps = Heaps(ids, x, k)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                tile = batch.slice(at, TILE)
                flat = tile.column("v").flatten().to_numpy(zero_copy_only=False)
                heaps.offer(tile.column("vec_id").to_numpy(zero_copy_only=False), flat.reshape(tile.num_rows, size))
        q, slot = np.nonzero(np.isfinite(heaps.best))
        yield pa.record_batch({"query_id": pa.array(ids[q]), "vec_id": pa.array(heaps.who[q, slot]), "score": pa.array(heaps.best[q, slot])})

    return candidates.filter(F.size("v") == size).mapInArrow(scan, "query_id long, vec_id long, score double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))


OP9_SQL = """
with good as (
    select vec_id, embedding::double[] as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
asked as (select vec_id, max(v) as v from good where vec_id % 100 = 0 group by vec_id),
pairs as (
    select q.vec_id as query_id, c.vec_id, min(sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) as score
    from asked q join good c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) group by q.vec_id, c.vec_id
),
ranked as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 10
"""
