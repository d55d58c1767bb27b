"""Exact duplicates by content-defined chunk recipes.

A text without white space is cut where a rolling gear hash of its bytes says so, chunks become identifiers, and texts are
compared by their ordered identifier lists. Only chunks travel for verification, each distinct one of a task once; a long
document never moves as a whole. An identifier found on two different chunks is answered by a new seed, so equal recipes are
equal texts.

Null or white-only text is the empty text, with the empty recipe. Of equal texts the row with most code points in the original
stays, then the smallest id; a null id loses every tie. Rows with the same id are told apart by position in the group only: each
is one member. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientpulse.llm.texts import WHITE, byte_column, sliced
from clientpulse.session import materialize

MEAN_BITS, REACH, LONGEST = 10, 32, 16_384  # a cut about every 1,024 bytes, decided by 32 bytes, forced after 16,384
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
_WHITE = np.isin(np.arange(256), list(WHITE))


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Ends of the chunks of each row, as positions in ``data``; they depend on the row's bytes alone."""
    gear, width = _GEAR[data], 1
    while width < REACH:
        gear[width:] = gear[width:] + (gear[:-width] << np.uint32(width))
        width *= 2
    cuts = np.flatnonzero(gear >> np.uint32(32 - MEAN_BITS) == 0) + 1
    found = []
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        own = cuts[np.searchsorted(cuts, low + REACH) : np.searchsorted(cuts, high)]
        own = np.append(own, high) if high > low else own[:0]
        if len(own) and np.diff(own, prepend=low).max() > LONGEST:
            edges = np.append(low, own)
            own = np.concatenate([np.append(np.arange(a + LONGEST, b, LONGEST), b) for a, b in zip(edges, edges[1:], strict=False)])
        found.append(own)
    return found


def _recipes(seed: int, with_chunks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            data, offsets = byte_column(batch.column("text"))
            keep = ~_WHITE[data]
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            data = data[keep]
            view, digests, recipes, chunks = data.tobytes(), [], [], {}
            for low, ends in zip(offsets[:-1], chunk_ends(data, offsets), strict=True):
                start, ids, whole = int(low), [], hashlib.sha256()
                for end in ends.tolist():
                    piece = view[start:end]
                    ids.append(xxhash.xxh3_128_digest(piece, seed))
                    whole.update(piece)
                    chunks[ids[-1], piece] = None
                    start = end
                digests.append(whole.hexdigest())
                recipes.append(b"".join(ids))
            if with_chunks:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in chunks], pa.binary()), pa.array([c for _, c in chunks], pa.binary())], ["chunk_id", "chunk"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(points)), pa.array(digests), pa.array(recipes, pa.binary())], ["doc_id", "n_points", "text_sha256", "recipe"])

    return run


def verified_recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_points, text_sha256, recipe; no two different chunks share an identifier."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for seed in range(8):
        chunks = texts.mapInArrow(_recipes(seed, True), "chunk_id binary, chunk binary").dropDuplicates(["chunk_id", "chunk"])
        if chunks.groupBy("chunk_id").count().where("count > 1").isEmpty():
            out = texts.mapInArrow(_recipes(seed, False), "doc_id long, n_points long, text_sha256 string, recipe binary")
            return materialize(out, "recipes")
    raise ValueError("eight seeds in turn gave two chunks the same 128-bit identifier")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The join back is by recipe; groups are sized by partial counts, and a hot recipe's rows meet one row, so Spark can split them.
    """
    recipes = verified_recipes(docs)
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("place"))).alias("best")
    groups = recipes.groupBy("recipe").agg(best, F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("recipe", (-F.col("best.place")).alias("keep_id"), "group_size")
    return recipes.join(groups, "recipe").select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: exactly one row of each group of equal texts.

    Rows are told by their id; only those with an id that several rows have, or with none, are told by their texts' digests too. Of rows
    equal in both any one stays, as they differ in white space at most.
    """
    groups = materialize(exact_groups(docs), "groups")
    gone = groups.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    shared = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_shared"))
    shared = materialize(shared, "shared")
    if shared.isEmpty():
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    bare = F.sha2(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]", "").cast("binary"), 256)
    # an id may stay for one text and go for another: rows with such ids are judged by their text
    repeated = docs.join(shared, docs["doc_id"].eqNullSafe(shared["_shared"]), "left_semi").withColumn("_digest", bare)
    plain = docs.join(shared, docs["doc_id"].eqNullSafe(shared["_shared"]), "left_anti").join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    keepers = groups.select(F.col("text_sha256").alias("_text"), F.col("keep_id").alias("_keep")).distinct()
    stays = repeated.join(keepers, (F.col("_digest") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_keep")), "left_semi")
    place = F.row_number().over(Window.partitionBy("_digest", "doc_id").orderBy("_digest"))
    return plain.unionByName(stays.withColumn("_place", place).where("_place = 1").select(docs.columns))
