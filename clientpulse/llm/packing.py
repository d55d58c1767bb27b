"""Best-fit packing of token pieces into sequences, with bounds that certify the number of sequences.

Documents become ids plus a closing id; only longer ones are cut, into full-length pieces. Pieces are dealt over groups of bounded
size and each group is packed by best-fit decreasing. Dual-feasible functions give each group a lower bound on its sequences: a group
that meets it is certified. The others release the documents of their loosely filled sequences, which are dealt anew into fewer
groups and packed again, until all are certified, one group is left, or a round saves nothing. Only lengths move in these rounds.

Null or empty text is the closing id alone. Repeated ids are told apart by a row number within the piece's id, so equal rows are packed
one by one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.bpe import VOCABULARY, Encoder
from clientpulse.session import materialize

CAPACITY, CLOSING = 4096, 1
GROUP = 65_536  # pieces of one group, about
LOOSE = 0.005  # a sequence with more than this share free is given up by an uncertified group
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, copy long"


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, longest first, each into the fullest bin that takes it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    frees: list[int] = []  # the free spaces that occur, in order
    at: dict[int, list[int]] = {}
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = bisect_left(frees, need)
        if found == len(frees):
            free, own, made = capacity, made, made + 1
        else:
            free = frees[found]
            own = at[free].pop()
            if not at[free]:
                del at[free], frees[found]
        bins[i], offsets[i] = own, capacity - free
        left = free - need
        if left:
            if left not in at:
                at[left] = []
                insort(frees, left)
            at[left].append(own)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Largest bound that the dual-feasible functions give: plain size, large against small pieces, and rounding in k steps."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = math.ceil(int(count @ size) / capacity)
    sums, many = np.cumsum(count * size), np.cumsum(count)
    low = np.arange(1, capacity // 2 + 1)  # pieces above capacity - low count whole, those below low not at all
    whole, middle = many[-1] - many[capacity - low], sums[capacity - low] - sums[low - 1]
    best = max(best, int(np.max(whole + -(-middle // capacity))))
    for k in range(1, 33):
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # times k * capacity
        best = max(best, math.ceil(int(count @ value) / (k * capacity)))
    return best


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        closing = np.array([CLOSING], "<u4").tobytes()
        serial = 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                coded = encoder.encode(text.as_py() or "") + closing
                serial += 1
                for piece, start in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[start : start + 4 * capacity]
                    rows.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part), serial))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "copy"]
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    return run


def _packed(round_no: int, capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "copy"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = frame["length"].to_numpy(np.int64)
        bins, offsets = best_fit(lengths, capacity)
        filled = np.bincount(bins, weights=lengths)
        certified = len(filled) == lower_bound(lengths, capacity)
        out = frame[["doc_id", "piece", "copy", "length"]].copy()
        out["sequence_id"] = (round_no << 56) + (int(frame["part"].iloc[0]) << 24) + bins
        out["offset"] = offsets
        out["loose"] = False if certified else filled[bins] < capacity * (1 - LOOSE)
        out["opens"] = offsets == 0
        return out

    return run


_PACKED = "doc_id long, piece int, copy long, length long, sequence_id long, offset long, loose boolean, opens boolean"


def pack_lengths(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, copy, sequence_id, offset for pieces of known ``length``."""

    def pack(rows: DataFrame, n: int, round_no: int) -> tuple[DataFrame, int]:
        parts = max(1, math.ceil(n / group))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "copy", F.lit(round_no)), F.lit(parts)))
        done = materialize(dealt.groupBy("part").applyInPandas(_packed(round_no, capacity), _PACKED), "packed")
        return done, parts

    keys = ["doc_id", "piece", "copy", "length"]
    current, parts = pack(pieces.select(keys), pieces.count(), 0)
    settled = None
    for round_no in range(1, 64):
        loose = current.where("loose")
        n, before = loose.agg(F.count(F.lit(1)), F.sum(F.col("opens").cast("int"))).first()
        if not n or parts == 1:
            break
        again, fewer = pack(loose.select(keys), n, round_no)
        after = again.where("opens").count()
        if after >= before:
            break
        kept = current.where("not loose")
        settled = kept if settled is None else settled.unionByName(kept)
        current, parts = again, fewer
    done = current if settled is None else settled.unionByName(current)
    return done.select("doc_id", "piece", "copy", "sequence_id", "offset")


def pack(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = texts.mapInArrow(_pieces(path, capacity), _PIECE)
    pieces = materialize(pieces.withColumn("copy", F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("copy")), "pieces")
    full = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    placed = pack_lengths(rest, capacity).withColumnsRenamed({"doc_id": "_doc", "piece": "_piece", "copy": "_copy"})
    same = rest["doc_id"].eqNullSafe(placed["_doc"]) & (rest["piece"] == placed["_piece"]) & (rest["copy"] == placed["_copy"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    alone = full.select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.join(placed, same).select(*columns, "sequence_id", "offset").unionByName(alone)
