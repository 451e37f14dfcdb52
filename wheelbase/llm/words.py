"""Words, word fingerprints and shingles of whole batches of texts, on the UTF-8 bytes and without a Python loop per word.

A word is a maximal run of bytes outside [\\x20\\x09-\\x0D]; A-Z is lower-cased. Fingerprints have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_WORD = 2**64
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def keyed(n: int, key: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0xD1342543DE82EF95) + U(key))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = keyed(256, 11)
LOWER_VALUE = BYTE_VALUE[LOWER]
STEP = keyed(64, 12) | U(1)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2**64 for i below n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((BASE, pow(BASE, -1, _WORD))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` text bytes, so that memory does not follow the batch size. A text is never cut."""
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Words of a batch: ``hash`` per word and ``ptr`` (words of row d are ptr[d]..ptr[d + 1])."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        n = len(data)
        self.rows = len(offsets) - 1
        if n == 0:
            self.hash, self.ptr = np.zeros(0, U), np.zeros(self.rows + 1, np.int64)
            return
        space = SPACE[data]
        edge = np.empty(n + 1, bool)
        edge[0] = True
        edge[1:] = space
        edge[offsets] = True
        start = np.flatnonzero(~space & edge[:n])
        edge = edge[1:]
        edge[:-1] |= space[1:]
        edge[-1] = True
        end = np.flatnonzero(~space & edge) + 1
        # edge after position i: the next byte is a space or opens another row
        up, down = powers(n)
        total = LOWER_VALUE[data]
        total *= up
        np.cumsum(total, out=total)
        value = total[end - 1]
        value[start > 0] -= total[start[start > 0] - 1]
        value *= down[start]
        self.hash = mix(value ^ (U(0xA0761D6478BD642F) * (end - start).astype(U)))
        self.ptr = np.searchsorted(start, offsets)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints of k words in a row, not yet distinct: values, first and end position of each row's values.

        A row with fewer words has its whole sequence as one; a row without words has none.
        """
        h, ptr = self.hash, self.ptr
        n = len(h)
        value = np.zeros(max(n, 1), U)
        for j in range(min(k, n)):
            value[: n - j] += h[j:] * STEP[j]
        value = mix(value + U(k))
        first, end = ptr[:-1], np.maximum(ptr[1:] - k + 1, ptr[:-1])
        count = np.diff(ptr)
        short = np.flatnonzero((count > 0) & (count < k))
        end = end.copy()
        for d in short:
            a, m = ptr[d], count[d]
            one = np.sum(h[a:a + m] * STEP[:m], dtype=U)
            value[a] = mix(np.array([one + U(1000 + m)], U))[0]
            end[d] = a + 1
        return value, first, end

    def sets(self, k: int) -> list[np.ndarray]:
        """Distinct shingles of each row, sorted."""
        value, first, end = self.shingles(k)
        return [np.unique(value[a:b]) for a, b in zip(first, end)]
