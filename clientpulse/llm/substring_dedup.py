"""Removal of passages that an earlier document already has, by Rabin-Karp hashes of every word window.

Every run of 50 words of every document is hashed by one rolling sum. Tasks send the distinct hashes of a slice, each with its
smallest document, to hash buckets as packed arrays, and tell the later documents of the slice at once. A bucket finds each hash's
smallest document over all slices and sends word back to the documents that are not the first. Each document then marks the
windows it was told about, and overlapping windows merge into maximal removal intervals.

A hash has 64 bits and the bucket comes from a second hash, so windows are told apart by more than 64 bits. The array a bucket gets
holds one entry per slice and window, however many documents share it. Parts and buckets follow the size of the data.

Null text has no words. Texts under 50 words keep all of them. Documents with the same id count as one when windows are compared:
neither is smaller. Null ids come after all others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.texts import Words, parts_for, sliced

WINDOW, SENT_BYTES = 50, 8 << 20
_NO_ID = (1 << 63) - 1
_PACKED = "part long, docs binary, counts binary, hashes binary, told boolean"
_FIELDS = ["part", "docs", "counts", "hashes", "told"]


def part_of(docs: np.ndarray, parts: int) -> np.ndarray:
    return np.mod(docs, parts)


def _prime(n: int) -> int:
    """The first prime from n on, so that ids in steps still spread over all parts."""
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _rows(to: np.ndarray, docs: np.ndarray, hashes: np.ndarray, told: bool) -> list[tuple]:
    """One packed row per destination: its documents, how many hashes each has, and the hashes."""
    order = np.lexsort((docs, to))
    to, docs, hashes = to[order], docs[order], hashes[order]
    out, edges = [], np.flatnonzero(np.diff(to, prepend=-1, append=-1)) if len(to) else []
    for low, high in zip(edges[:-1], edges[1:], strict=True) if len(edges) else ():
        own, counts = np.unique(docs[low:high], return_counts=True)
        out.append((int(to[low]), own.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), hashes[low:high].astype("<u8").tobytes(), told))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _FIELDS)


def _unpacked(docs, counts, hashes) -> tuple[np.ndarray, np.ndarray]:
    ids = [np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(c, "<u4")) for d, c in zip(docs, counts, strict=True)]
    return np.concatenate(ids), np.frombuffer(b"".join(hashes), "<u8")


def _firsts(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, document) pairs in order, and for each the smallest document of its hash."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[fresh], docs[fresh]
    head = np.ones(len(hashes), bool)
    head[1:] = hashes[1:] != hashes[:-1]
    return hashes, docs, docs[np.flatnonzero(head)[np.cumsum(head) - 1]]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _sent(size: int, parts: int, told: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SENT_BYTES):
            words = Words(batch.column("text"))
            at, hashes = words.windows(size)
            if not len(at):
                continue
            docs = _ids(batch.column("doc_id"))[words.row[at]]
            bucket = words.windows(size, 5)[1] % np.uint64(parts)
            del words
            # the bucket is part of what is compared: hashes of one bucket only meet each other
            order = np.lexsort((docs, hashes, bucket))
            bucket, hashes, docs = bucket[order].astype(np.int64), hashes[order], docs[order]
            new = np.ones(len(docs), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (hashes[1:] != hashes[:-1])
            first = docs[np.flatnonzero(new)[np.cumsum(new) - 1]]
            if told:
                again = ~new & (docs != first)
                again[1:] &= new[1:] | (docs[1:] != docs[:-1])
                yield _batch(_rows(part_of(docs[again], parts), docs[again], hashes[again], True))
            else:
                yield _batch(_rows(bucket[new], docs[new], hashes[new], False))

    return run


def _answered(parts: int):
    def run(table: pa.Table) -> pa.Table:
        docs, hashes = _unpacked(*(table.column(c).to_pylist() for c in ("docs", "counts", "hashes")))
        hashes, docs, first = _firsts(hashes, docs)
        later = docs != first
        docs, hashes = docs[later], hashes[later]
        return pa.Table.from_batches([_batch(_rows(part_of(docs, parts), docs, hashes, True))])

    return run


def _kept(size: int, names: list[str], digest: bool):
    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        told_docs, told = np.empty(0, np.int64), np.empty(0, np.uint64)
        if right.num_rows:
            told_docs, told = _unpacked(*(right.column(c).to_pylist() for c in ("docs", "counts", "hashes")))
            order = np.argsort(told_docs, kind="stable")
            told_docs, told = told_docs[order], told[order]
        out = [_answer(batch, size, names, digest, told_docs, told) for batch in sliced(left.to_batches(), "text")]
        return pa.Table.from_batches(out or [_answer(_empty(left), size, names, digest, told_docs, told)])

    return run


def _empty(left: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in left.schema], schema=left.schema)


def _answer(batch: pa.RecordBatch, size: int, names: list[str], digest: bool, told_docs: np.ndarray, told: np.ndarray) -> pa.RecordBatch:
    words = Words(batch.column("text"))
    at, hashes = words.windows(size)
    edges = np.searchsorted(at, words.first)
    depth = np.zeros(len(words.starts) + 1, np.int64)
    for row, doc in enumerate(_ids(batch.column("doc_id")).tolist()):
        low, high = edges[row], edges[row + 1]
        mine = told[np.searchsorted(told_docs, doc) : np.searchsorted(told_docs, doc, "right")]
        if high > low and len(mine):
            hit = at[low:high][np.isin(hashes[low:high], mine)]
            depth[hit] += 1
            depth[hit + size] -= 1
    gone = np.cumsum(depth)[:-1] > 0
    view, texts = words.data.tobytes(), batch.column("text")
    removed, kept = [], []
    for row in range(batch.num_rows):
        low, high = int(words.first[row]), int(words.first[row + 1])
        removed.append(int(gone[low:high].sum()))
        if removed[-1] or digest:
            stay = np.flatnonzero(~gone[low:high]) + low
            whole = b" ".join([view[a:b] for a, b in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)])
            kept.append(hashlib.sha256(whole).hexdigest() if digest else whole.decode())
        else:
            kept.append(texts[row].as_py())
    columns = [pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in names]
    counts = [pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *counts], [*names, "_n_words", "_n_removed"])


def remove_passages(docs: DataFrame, size: int = WINDOW, digest: bool = False) -> DataFrame:
    """The columns of ``docs``, with the text that stays or (``digest``) its SHA-256, and _n_words and _n_removed.

    A text that loses nothing stays as it was; otherwise the kept words are joined by one space.
    """
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    texts, names = docs.select("doc_id", "text"), docs.columns
    parts = _prime(parts_for(texts, "text"))
    first = texts.mapInArrow(_sent(size, parts, False), _PACKED).groupBy("part").applyInArrow(_answered(parts), _PACKED)
    told = first.unionByName(texts.mapInArrow(_sent(size, parts, True), _PACKED)).select(F.col("part").alias("_part"), "docs", "counts", "hashes")
    own = docs.withColumn("_part", F.pmod(F.coalesce("doc_id", F.lit(_NO_ID)), F.lit(parts)))
    schema = docs.withColumns({"_n_words": F.lit(0).cast("long"), "_n_removed": F.lit(0).cast("long")}).schema
    return own.groupBy("_part").cogroup(told.groupBy("_part")).applyInArrow(_kept(size, names, digest), schema)


def drop_passages(docs: DataFrame) -> DataFrame:
    """The documents with the text that stays, and n_chars brought up to it; no document goes."""
    done = remove_passages(docs).drop("_n_words", "_n_removed")
    return done.withColumn("n_chars", F.length("text").cast(done.schema["n_chars"].dataType)) if "n_chars" in done.columns else done
