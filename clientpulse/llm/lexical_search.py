"""Ranked search over an inverted index, with bounds of term pairs in MaxScore.

The index is cut by documents: a segment holds a bounded run of texts with its own postings, so building it moves nothing, and any
segment can be searched alone. Scores need three numbers of the whole table (documents N, their terms L, documents per term df),
which are sums over the segments.

Beside postings, a search uses **pair lists**: for pairs of a query's terms, every segment's documents that hold both, with
their joint impact, and the largest impact that any document of the segment gets from the pair (from both terms or from one). A
pair's bound is at most the sum of its terms' maxima, and equals the larger one where they never meet. They serve twice:

1. the k-th largest joint impact of a pair over all segments is reached by k documents, so it is a floor for the k-th best score;
2. in a segment, pairs and unpaired terms are put in order of their bounds. The weakest, whose bounds together stay below
   the floor, cannot lift a document on their own: only documents of the others are scored, and the weak ones are looked up for
   those that can still reach the floor.

Nothing is skipped that could reach the first k, so results equal those of scoring every document; equal scores go by ascending id.

Queries are worked off in blocks of bounded text, whose terms travel with the tasks. Weights are computed in doubles, everything
else in 64-bit whole numbers.

Edge cases: null and empty texts have no terms; such documents count neither in N nor in results, such queries have no rows.
Each row is a document (or query) of its own, also with a repeated or null id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clientpulse.llm.texts import byte_column, sliced
from clientpulse.session import materialize

TOP = 20
SEGMENT_BYTES, SEGMENT_ROWS = 8 << 20, 1 << 16
BLOCK_CHARS, BLOCK_QUERIES = 500_000, 2000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased terms of all texts and the row of each."""
    data, offsets = byte_column(column)
    data = _LOWER[data]
    part = _TERM[data]
    begin, end = part.copy(), part.copy()
    begin[1:] &= ~part[:-1]
    end[:-1] &= ~part[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] |= part[inner]
    end[inner - 1] |= part[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    bounds = np.empty(2 * len(starts) + 1, np.int64)
    bounds[0:-1:2], bounds[1::2], bounds[-1] = starts, ends, len(data)
    both = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return both.take(pa.array(np.arange(0, 2 * len(starts), 2))), np.searchsorted(offsets, starts, "right") - 1


def _postings(rows: np.ndarray, tf: np.ndarray) -> bytes:
    """Rows of a segment as 16-bit numbers, then their counts in one byte each if all fit, else in four."""
    return rows.astype(np.uint16).tobytes() + tf.astype(np.uint8 if tf.max() < 256 else np.uint32).tobytes()


def _read_postings(held: bytes, df: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.frombuffer(held, np.uint8 if len(held) == 3 * df else np.uint32, df, 2 * df) if len(held) == 3 * df else np.frombuffer(held[2 * df :], np.uint32)
    return np.frombuffer(held, np.uint16, df).astype(np.int64), counts.astype(np.int64)


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Inverted index in the shared folder: per segment one row with its ids and lengths (term null) and one row per term."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for wide in sliced(_joined(batches), "text", SEGMENT_BYTES):
            for at in range(0, wide.num_rows, SEGMENT_ROWS):
                batch = wide.slice(at, SEGMENT_ROWS)
                words, row = _terms(batch.column("text"))
                coded = words.dictionary_encode()
                key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 16 | row
                cell, tf = np.unique(key, return_counts=True)
                first = np.flatnonzero(np.diff(cell >> 16, prepend=-1))
                last = np.append(first[1:], len(cell))
                lengths = np.bincount(row, minlength=batch.num_rows)
                held = [_postings(cell[a:b] & 0xFFFF, tf[a:b]) for a, b in zip(first.tolist(), last.tolist())]
                m, ids = len(held), batch.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{task}-{n}"] * (m + 1), pa.string()),
                        pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.cast(pa.string())]),
                        pa.array(np.append(np.count_nonzero(lengths), last - first), pa.int64()),
                        pa.array([None, *held], pa.binary()),
                        pa.array([ids.to_pylist()] + [None] * m, pa.list_(ids.type)),
                        pa.array([lengths.tolist()] + [None] * m, pa.list_(pa.int64())),
                    ],
                    names=["segment", "term", "df", "postings", "ids", "lengths"],
                )
                n += 1

    schema = f"segment string, term string, df long, postings binary, ids array<{kind}>, lengths array<long>"
    return materialize(rows.mapInArrow(segments, schema), "index")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together, so that segments do not follow Arrow's batch size."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SEGMENT_BYTES:
            yield _one(held)
            held, size = [], 0
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches(max_chunksize=None)[0] if sum(b.num_rows for b in batches) else batches[0]


@dataclass(frozen=True)
class Query:
    """Units are pairs of terms, or one term with None, each term with its weight times its repeats."""

    number: int
    units: tuple[tuple[tuple[str, int], tuple[str, int] | None], ...]


def _query(number: int, terms: dict[str, int], weights: dict[str, int]) -> Query:
    """Terms paired in order of weight, the most common ones with one another: their lists are long and meet most."""
    known = sorted(((weights[t] * n, t) for t, n in terms.items() if weights.get(t, 0) > 0))
    places = [(t, w) for w, t in known]
    return Query(number, tuple((places[i], places[i + 1] if i + 1 < len(places) else None) for i in range(0, len(places), 2)))


class Segment:
    """Postings of a block's terms in one segment, as impacts per unit of weight."""

    def __init__(self, rows: list[dict], n: int, total: int):
        head = next(r for r in rows if r["term"] is None)
        self.ids = head["ids"]
        lengths = np.array(head["lengths"], np.int64)
        # 64-bit as in the definition; the largest length times 25 N has to fit
        m = 100 - 25 + (25 * lengths * n) // total
        self.lists: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for r in rows:
            if r["term"] is not None:
                at, tf = _read_postings(r["postings"], r["df"])
                self.lists[r["term"]] = at, (1_000_000_000 * tf) // (1000 * tf + 12 * m[at])

    def impacts(self, term: tuple[str, int] | None) -> tuple[np.ndarray, np.ndarray]:
        if term is None or term[0] not in self.lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, impact = self.lists[term[0]]
        return rows, impact * term[1]

    def pair(self, a: tuple[str, int], b: tuple[str, int]) -> tuple[int, np.ndarray, np.ndarray]:
        """Largest impact of a document from the pair, and the documents with both terms with their joint impacts."""
        (rows_a, in_a), (rows_b, in_b) = self.impacts(a), self.impacts(b)
        both, at_a, at_b = np.intersect1d(rows_a, rows_b, assume_unique=True, return_indices=True)
        joint = in_a[at_a] + in_b[at_b]
        return max(int(x.max(initial=0)) for x in (in_a, in_b, joint)), both, joint

    def search(self, query: Query, bounds: dict[tuple, int], floor: int, top: int) -> list[tuple[int, int]]:
        """Rows and scores of the documents that may be among the first ``top``: all scores are at least ``floor``."""
        units = []
        for unit in query.units:
            a, b = unit
            bound = bounds[unit] if b is not None else int(self.impacts(a)[1].max(initial=0))
            if bound:
                units.append((bound, unit))
        units.sort(key=lambda u: u[0])
        below = np.cumsum([u[0] for u in units]) if units else np.zeros(0, np.int64)
        weak = int(np.searchsorted(below, max(floor, 1), "left"))
        if weak == len(units):
            return []
        score = np.zeros(len(self.ids), np.int64)
        seen = np.zeros(len(self.ids), bool)
        for _, unit in units[weak:]:
            for term in unit:
                rows, impact = self.impacts(term)
                score[rows] += impact
                seen[rows] = True
        left = np.flatnonzero(seen)
        for i in range(weak - 1, -1, -1):
            left, floor = self._raised(left, score[left], floor, int(below[i]), top)
            for term in units[i][1]:
                rows, impact = self.impacts(term)
                if len(rows) and len(left):
                    at = np.minimum(np.searchsorted(rows, left), len(rows) - 1)
                    score[left] += np.where(rows[at] == left, impact[at], 0)
        left, _ = self._raised(left, score[left], floor, 0, top)
        return [(int(r), int(score[r])) for r in left]

    @staticmethod
    def _raised(left: np.ndarray, reached: np.ndarray, floor: int, more: int, top: int) -> tuple[np.ndarray, int]:
        """Documents that can still reach the floor, once the ``top``-th best partial score has raised it."""
        if len(left) > top:
            floor = max(floor, int(np.partition(reached, len(left) - top)[len(left) - top]))
        return left[reached + more >= max(floor, 1)], floor


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int, Counter]]]:
    """Queries with their term counts, in blocks of bounded text; a longer text is a block of its own."""
    block, chars = [], 0
    for r in queries.toLocalIterator():
        words, _ = _terms(pa.array([r["text"]], pa.string()))
        block.append((r["number"], Counter(w.decode() for w in words.to_pylist())))
        chars += len(r["text"] or "")
        if chars >= BLOCK_CHARS or len(block) >= BLOCK_QUERIES:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _weights(index: DataFrame, wanted: DataFrame, n: int) -> dict[str, int]:
    """Weights of one block's terms: bounded as the block is."""
    found = index.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1))) for r in found.collect()}


def _segment_rows(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def search(spark: SparkSession, index: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """``<id_col>, rank, doc_id, score``: the first ``top`` documents of each query row."""
    heads = index.filter(F.col("term").isNull())
    sizes = heads.agg(F.sum("df"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n, total = sizes[0] or 0, sizes[1] or 0
    numbered = materialize(
        queries.select(F.col(id_col).alias("__id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("number")), "queries"
    )
    kind = index.schema["ids"].dataType.elementType.simpleString()
    empty = spark.createDataFrame([], f"number long, doc_id {kind}, score long")
    done = [_search_block(spark, index, block, n, total, top, kind) for block in _blocks(numbered)] if n else []
    best = reduce(DataFrame.unionByName, done) if done else empty
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranks = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranks.join(numbered, "number").select(F.col("__id").alias(id_col), "rank", "doc_id", "score")


def _search_block(
    spark: SparkSession, index: DataFrame, block: Sequence[tuple[int, Counter]], n: int, total: int, top: int, kind: str
) -> DataFrame:
    vocabulary = sorted({t for _, terms in block for t in terms})
    wanted = spark.createDataFrame([(t,) for t in vocabulary], "term string")
    weights = _weights(index, wanted, n)
    asked = [_query(number, terms, weights) for number, terms in block]
    pairs = sorted({u for q in asked for u in q.units if u[1] is not None})
    # the terms of one block: bounded by BLOCK_CHARS
    mine = index.join(F.broadcast(wanted), "term", "left_semi").select(index.columns)
    lists = mine.unionByName(index.filter(F.col("term").isNull()))

    def paired(table: pa.Table) -> pa.Table:
        segment = table.column("segment")[0].as_py()
        held = Segment(_segment_rows(table), n, total)
        bound, rows, joint, which = [], [], [], []
        for i, (a, b) in enumerate(pairs):
            if a[0] in held.lists or b[0] in held.lists:
                most, both, sums = held.pair(a, b)
                which.append(i)
                bound.append(most)
                rows.append(both.astype(np.uint16).tobytes())
                joint.append(sums.tolist())
        columns = [pa.array([segment] * len(which), pa.string()), pa.array(which, pa.int32()), pa.array(bound, pa.int64())]
        return pa.Table.from_arrays(
            [*columns, pa.array(rows, pa.binary()), pa.array(joint, pa.list_(pa.int64()))],
            names=["segment", "pair", "bound", "rows", "joint"],
        )

    schema = "segment string, pair int, bound long, rows binary, joint array<long>"
    pair_lists = materialize(lists.groupBy("segment").applyInArrow(paired, schema), "pairs")
    floors = _floors(pair_lists, asked, pairs, top)

    def best(key: tuple, table: pa.Table, bounds: pa.Table) -> pa.Table:
        held = Segment(_segment_rows(table), n, total)
        most = dict(zip((pairs[i] for i in bounds.column("pair").to_pylist()), bounds.column("bound").to_pylist()))
        most = {p: most.get(p, 0) for p in pairs}
        out = []
        for q in asked:
            found = held.search(q, most, floors.get(q.number, 0), top)
            found = [(held.ids[r], s) for r, s in found]
            found.sort(key=lambda f: (-f[1], f[0] is None, f[0] if f[0] is not None else 0))
            out += [(q.number, d, s) for d, s in found[:top]]
        columns = list(zip(*out)) if out else ([], [], [])
        ids = table.schema.field("ids").type.value_type
        return pa.Table.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], ids), pa.array(columns[2], pa.int64())],
            names=["number", "doc_id", "score"],
        )

    both = lists.groupBy("segment").cogroup(pair_lists.select("segment", "pair", "bound").groupBy("segment"))
    return materialize(both.applyInArrow(best, f"number long, doc_id {kind}, score long"), "hits")


def _floors(pair_lists: DataFrame, asked: Sequence[Query], pairs: Sequence[tuple], top: int) -> dict[int, int]:
    """A score that at least ``top`` documents reach, per query: the best of its pairs' ``top``-th largest joint impacts."""
    own = F.slice(F.reverse(F.array_sort("joint")), 1, top)
    each = pair_lists.select("pair", F.explode(own).alias("joint"))
    order = Window.partitionBy("pair").orderBy(F.desc("joint"))
    kth = each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).filter(F.col("place") == top)
    reached = {pairs[r["pair"]]: r["joint"] for r in kth.select("pair", "joint").collect()}
    return {q.number: max((reached.get(u, 0) for u in q.units), default=0) for q in asked}
