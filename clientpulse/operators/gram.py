"""Pairwise sums of many columns over the rows where both of a pair are present, from one scan.

Tasks add up, per pair (i, j), the number of such rows and the sums of x_i, x_i² and x_i x_j over them, each less a shift per
column near its mean, so that little is lost to cancellation. Sums with different shifts are brought to one when they are merged; tasks'
results are merged in two rounds of tasks, and the driver gets features-by-features matrices only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.session import shuffle_width

PARTIAL = "slot int, state binary"


@dataclass
class Gram:
    """``sums[i, j]`` and ``squares[i, j]`` are of x_i - shift_i over the rows where i and j are present."""

    shift: np.ndarray
    count: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Gram:
        """Of rows by columns, NaN where a value is missing."""
        here = ~np.isnan(x)
        n = here.sum(axis=0)
        shift = np.where(here, x, 0.0).sum(axis=0) / np.maximum(n, 1)
        centred, mask = np.where(here, x - shift, 0.0), here.astype(float)
        return cls(shift, mask.T @ mask, centred.T @ mask, (centred * centred).T @ mask, centred.T @ centred)

    def moved(self, shift: np.ndarray) -> Gram:
        """The same sums less another shift; columns without a row have nothing to move."""
        d = np.where(np.diag(self.count) > 0, self.shift - shift, 0.0)[:, None]
        return Gram(
            shift,
            self.count,
            self.sums + self.count * d,
            self.squares + 2 * d * self.sums + self.count * d * d,
            self.products + d.T * self.sums + d * self.sums.T + self.count * d * d.T,
        )

    def plus(self, other: Gram) -> Gram:
        mine, theirs = np.diag(self.count), np.diag(other.count)
        shift = np.where(mine >= theirs, self.shift, other.shift)
        a, b = self.moved(shift), other.moved(shift)
        return Gram(shift, a.count + b.count, a.sums + b.sums, a.squares + b.squares, a.products + b.products)

    def to_bytes(self) -> bytes:
        return np.concatenate([self.shift[None], self.count, self.sums, self.squares, self.products]).tobytes()

    @classmethod
    def from_bytes(cls, state: bytes, size: int) -> Gram:
        whole = np.frombuffer(state).reshape(-1, size)
        return cls(whole[0], *(whole[1 + i * size : 1 + (i + 1) * size] for i in range(4)))

    def correlations(self) -> np.ndarray:
        """Pearson's r of every pair; NaN where a pair has no row or one side does not vary on its rows."""
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = self.squares - self.sums**2 / self.count
            flat = spread <= 1e-12 * np.maximum(self.squares, 0)
            cross = self.products - self.sums * self.sums.T / self.count
            r = cross / np.sqrt(spread * spread.T)
        return np.where(flat | flat.T | (self.count == 0), np.nan, np.clip(r, -1.0, 1.0))


def _state(grams: Iterator[Gram]) -> Iterator[pa.RecordBatch]:
    """All of a task's sums as one row, in the slot of the task; no row without sums."""
    total = None
    for gram in grams:
        total = gram if total is None else total.plus(gram)
    if total is not None:
        slot = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.to_bytes()], pa.binary())], names=["slot", "state"])


def _collected(rows: DataFrame, size: int, read: Callable[[pa.RecordBatch], np.ndarray]) -> Gram:
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _state(Gram.of(read(b)) for b in batches if b.num_rows)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _state(Gram.from_bytes(s, size) for b in batches for s in b.column("state").to_pylist())

    width = shuffle_width(rows.sparkSession)
    partial = rows.mapInArrow(first, PARTIAL)
    for parts in (width, math.isqrt(width)):
        partial = partial.repartition(parts, "slot").mapInArrow(again, PARTIAL)
    total = Gram.of(np.full((1, size), np.nan))
    for r in partial.collect():  # as many rows as the last round has tasks
        total = total.plus(Gram.from_bytes(bytes(r["state"]), size))
    return total


def gram_of_columns(df: DataFrame, cols: Sequence[str]) -> Gram:
    """Sums of the listed columns; null and NaN are missing."""

    def read(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)

    return _collected(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]), len(cols), read)


def gram_of_entries(df: DataFrame, entries: str, size: int) -> Gram:
    """Sums of rows that list their values as (place, value); places that are not listed are missing."""

    def read(batch: pa.RecordBatch) -> np.ndarray:
        column = batch.column(0)
        x = np.full((batch.num_rows, size), np.nan)
        listed = column.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
        x[row, listed.field(0).to_numpy()] = listed.field(1).to_numpy()
        return x

    return _collected(df.select(F.col(entries).alias("entries")), size, read)
