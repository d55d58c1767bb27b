"""Words and hashes of whole texts as numpy arrays, and the tables the operators keep in the shared folder.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``. Texts arrive as Arrow columns and are worked off in slices of bounded
size, so memory does not follow the batch. Null texts count as empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19  # cutting a slice into words takes some thirty times as much, which a worker keeps
WHITE = b" \t\n\x0b\x0c\r"
SPACES = np.zeros(256, bool)
SPACES[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 3, 0xC2B2AE3D27D4EB4F | 3
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(df: DataFrame, text: str, mb: int = 8) -> int:
    """Number of parts of about ``mb`` million characters, at least one per shuffle partition; grows with the data."""
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / (mb * 1_000_000)))


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = byte_column(batch.column(column))[1][1:]
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    col = column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).fill_null(b"")
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        ones = np.ones(size, np.uint64)
        up, down = ones.copy(), ones.copy()
        up[1:], down[1:] = base, pow(base, -1, 1 << 64)
        if size > 16 * SLICE_BYTES:
            return np.cumprod(up), np.cumprod(down)
        _POWERS[base] = np.cumprod(up), np.cumprod(down)
    return _POWERS[base]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x + np.uint64((int(seed) * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of each span of ``values``, the same wherever the span stands."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


class Words:
    """Start and end byte, and 64-bit hash, of every word; ``first[d]:first[d + 1]`` are the words of row d.

    ``gap`` says of each byte whether it parts words, white space if not given.
    """

    def __init__(self, column: pa.Array, lower: bool = False, gap: np.ndarray = SPACES):
        self.data, offsets = byte_column(column)
        if lower:
            self.data = _LOWER[self.data]
        gap = gap[self.data]
        begin, end = ~gap, ~gap
        begin[1:] &= gap[:-1]
        end[:-1] &= gap[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(self.data))]
        begin[inner] |= ~gap[inner]
        end[inner - 1] |= ~gap[inner - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):  # pieces of bounded size, cut between words
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + SLICE_BYTES, "right")))
            values = self.data[low : self.ends[to - 1]].astype(np.uint64) + np.uint64(1)
            out[at:to] = span_sums(values, self.starts[at:to] - low, self.ends[at:to] - low, _BYTE_BASE)
            at = to
        return mixed(out + (self.ends - self.starts).astype(np.uint64))

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``size`` words within one row."""
        at = np.arange(max(0, len(self.hashes) - size + 1))
        at = at[self.row[at] == self.row[at + size - 1]]
        return at, mixed(span_sums(mixed(self.hashes, seed), at, at + size, _WORD_BASE), seed + size)
