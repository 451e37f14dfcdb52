"""Batches of documents asking shards of a global table about many keys at once.

A batch is a row (batch long, body binary) that stays in one place: the table of batches is dealt out by ``batch`` once and stored, so later steps join
replies to it without moving it again. A request (batch, shard, body) carries packed arrays to the shard that owns its keys; a shard sees all
requests for its keys, and answers each with a reply (batch, shard, body) in the order of the request. Keys are spread by hash and pre-aggregated in the
batch, and the number of shards follows the number of keys, so a shard holds a bounded part of the table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from wheelbase.llm.frames import stored

SIDE = -1  # replies to this batch are side results of a shard
REQUEST = "batch long, shard long, body binary"

Arrays = dict[str, np.ndarray]


def pack(arrays: Arrays) -> bytes:
    """Arrays as one compressed blob; integers take the narrowest type that holds them."""
    head, body = [], []
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        if x.dtype.kind in "iu" and x.dtype.itemsize > 1:
            top = int(x.max()) if len(x) else 0
            low = int(x.min()) if len(x) else 0
            if low >= 0:
                x = x.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)
        head.append((name, x.dtype.str, len(x)))
        # All first bytes, then all second bytes: small numbers compress to little.
        body.append(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if x.dtype.itemsize > 1 else x.tobytes())
    meta = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(meta).to_bytes(4, "little") + meta + b"".join(body))


def unpack(blob: bytes) -> Arrays:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    size = int.from_bytes(raw[:4], "little")
    at, out = 4 + size, {}
    for name, kind, n in json.loads(raw[4:at]):
        dtype = np.dtype(kind)
        flat = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at)
        at += n * dtype.itemsize
        out[name] = (flat.reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n) if dtype.itemsize > 1 else flat.view(dtype))
    return out


def rows(made: list[tuple[int, int, bytes]]) -> pa.Table:
    a, b, c = zip(*made) if made else ((), (), ())
    return pa.table({"batch": pa.array(a, pa.int64()), "shard": pa.array(b, pa.int64()), "body": pa.array(c, pa.binary())})


def dealt(batches: DataFrame) -> DataFrame:
    """The table of batches, dealt out by batch and stored, once.

    Spark remembers how a stored frame is dealt out if the plan that made it was fixed in advance, so adaptive execution rests while it is written. All later
    steps then move only requests and replies.
    """
    conf = batches.sparkSession.conf
    partitions, adaptive = int(conf.get("spark.sql.shuffle.partitions")), conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return stored(batches.repartition(partitions, "batch"))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def ask(batches: DataFrame, replies: DataFrame | None, make: Callable[[int, bytes, dict[int, Arrays]], Iterable[tuple[int, Arrays]]]) -> DataFrame:
    """Requests of all batches. ``make`` gets a batch's number and body and the replies to it by shard, and gives (shard, arrays)."""

    def one(number: int, body: bytes, got: dict[int, Arrays]) -> pa.Table:
        return rows([(number, shard, pack(arrays)) for shard, arrays in make(number, body, got)] if body else [])

    return visit(batches, replies, one, REQUEST)


def visit(batches: DataFrame, replies: DataFrame | None, make: Callable[[int, bytes, dict[int, Arrays]], pa.Table], schema: str) -> DataFrame:
    """Rows made from each batch and the replies to it; ``make`` gets an empty body for replies that belong to no batch (side results)."""
    if replies is None:

        def alone(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches_:
                for n in range(part.num_rows):
                    yield from make(part.column("batch")[n].as_py(), part.column("body")[n].as_py(), {}).to_batches()

        return batches.mapInArrow(alone, schema)

    def joined(own: pa.Table, got: pa.Table) -> pa.Table:
        if not own.num_rows:
            return make(-1, b"", {}).slice(0, 0)
        answers = {s: unpack(b) for s, b in zip(got.column("shard").to_pylist(), got.column("body").to_pylist())}
        return make(own.column("batch")[0].as_py(), own.column("body")[0].as_py(), answers)

    return batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(joined, schema)


def answered(requests: DataFrame, answer: Callable[[list[Arrays]], tuple[list[Arrays], Arrays | None]]) -> DataFrame:
    """Replies of all shards; ``answer`` gets all requests of a shard and gives one reply each and perhaps a side result. Stored, as side results are read first."""

    def reply(own: pa.Table) -> pa.Table:
        shard = own.column("shard")[0].as_py()
        got, side = answer([unpack(b) for b in own.column("body").to_pylist()])
        made = [(batch, shard, pack(arrays)) for batch, arrays in zip(own.column("batch").to_pylist(), got)]
        if side is not None:
            made.append((SIDE, shard, pack(side)))
        return rows(made)

    return stored(requests.groupBy("shard").applyInArrow(reply, REQUEST))


def sides(replies: DataFrame) -> list[Arrays]:
    """The side results, one small record for each shard."""
    return [unpack(r.body) for r in replies.filter(f"batch = {SIDE}").select("body").toLocalIterator()]


def spread(shard: np.ndarray, arrays: Arrays) -> Iterator[tuple[int, Arrays, np.ndarray]]:
    """The arrays split by shard, with the places that each part came from; within a shard the order stays."""
    order = np.argsort(shard, kind="stable")
    owner, first = np.unique(shard[order], return_index=True)
    for n, (a, b) in zip(owner.tolist(), zip(first, [*first[1:], len(order)])):
        places = order[a:b]
        yield n, {k: v[places] for k, v in arrays.items()}, places
