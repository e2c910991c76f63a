"""Bounded slices of Arrow batches, and words found in their text buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20

#: The separators of words: space and the bytes 9 to 13.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about ``limit`` bytes of ``column``; a longer row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


#: Bytes that Spark puts into a batch at most (or one row); its own limit of 64 MB would be held several times over in a worker.
BATCH_BYTES = 1 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``rows.mapInArrow`` in batches of bounded bytes; workers, which outlive their tasks, give freed memory back at each end."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    rows.sparkSession.conf.set(_LIMIT, BATCH_BYTES)
    return rows.mapInArrow(tidy, schema)


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets into them; a null counts as empty."""
    kind = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
    col = pc.fill_null(col.cast(kind), b"" if kind == pa.large_binary() else "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw and len(offsets) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the number of words before it (n + 1 numbers)."""
    plain = ~SEPARATOR[data]
    first = plain.copy()
    first[1:] &= ~plain[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = plain[heads]
    last = plain.copy()
    last[:-1] &= ~plain[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = plain[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, made as far as they are asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def table(b: int) -> np.ndarray:
                out = np.full(max(n, 1 << 20), b, np.uint64)
                out[0] = 1
                return np.multiply.accumulate(out)

            self.up, self.down = table(self.base), table(self.inverse)
        return self.up, self.down


_POWERS = [Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95)]
_BYTES = [mixed(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)) for k in (11, 29)]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of 64-bit values, from prefix sums: equal spans, equal hashes, wherever they stand."""
    up, down = _POWERS[which].upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return spans_hash(_BYTES[which][data], starts, ends, which)
