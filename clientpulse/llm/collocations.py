"""Phrases whose words stand together more often than their parts suggest, from sorted count streams.

Every word opens a window of itself and up to four words after it in the same piece. Tasks sort the windows of a slice, add up equal
ones and send each range of the sort order as one packed block to the task of that range; there the blocks are merged, and the
phrases of every length are runs of the sorted windows. What is frequent enough, with the runs at the edges of a range (at most two
per length, added up afterwards), is the **count stream** of a language. All further counts come from merge joins of that stream
with itself, both sides sorted and read in lockstep (``merge`` hints, no hash tables):

* in prefix order, every cut's first part meets its own count, and a phrase meets the phrases that extend it to the right;
* in suffix order, every cut's rest meets its own count, and a phrase meets the phrases that extend it to the left.

A longer phrase counts at most as often as any phrase inside of it, so whether some longer candidate holds a phrase and is as
frequent is settled by the extensions by one word. Where ranges begin is taken from a bounded sample of windows and only balances
the work. Scores are exact: products are whole decimals of up to 38 digits.

Edge cases: null text has no words; null language is ``und``; an empty table gives no rows; repeated rows count each time; ids and
other columns are not read, so nulls or clashing names there do not matter. Ties rank by count, then by the phrase's UTF-8 bytes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.texts import byte_column, parts_for, sliced
from clientpulse.operators.ordered import ranked
from clientpulse.session import materialize

LONGEST = 5
LEAST = 100
TOP = 2000
SLICE = 4 << 20
CHUNK_WORDS = 1 << 20
SAMPLE_CHARS, SAMPLE_WINDOWS = 4_000_000, 40
_SPLIT = np.zeros(256, bool)
_SPLIT[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _SPLIT.copy()
_GAP[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODEC = pa.Codec("zstd", compression_level=1)


def _words(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased words of all texts, the piece each stands in, and the row of each."""
    data, offsets = byte_column(batch.column("text"))
    data = _LOWER[data]
    gap = _GAP[data]
    begin, end = ~gap, ~gap
    begin[1:] &= gap[:-1]
    end[:-1] &= gap[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] |= ~gap[inner]
    end[inner - 1] |= ~gap[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(_SPLIT[data])[starts] + row
    bounds = np.empty(2 * len(starts) + 1, np.int64)
    bounds[0:-1:2], bounds[1::2], bounds[-1] = starts, ends, len(data)
    both = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return both.take(pa.array(np.arange(0, 2 * len(starts), 2))), piece, row


def _coded(words: pa.Array, langs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Sorted distinct words and languages, and the place (from 1) of every word and language among them."""
    both = pa.concat_arrays([words, langs.cast(pa.large_binary())]).dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    ids = place[both.indices.to_numpy()]
    return both.dictionary.take(pa.array(order)), ids[: len(words)], ids[len(words) :]


def _packed(columns: np.ndarray, bits: int) -> list[np.ndarray]:
    """Columns of one window as few 64-bit keys, most significant first."""
    each = 63 // bits
    keys = []
    for at in range(0, len(columns), each):
        key = np.zeros(columns.shape[1], np.int64)
        for column in columns[at : at + each]:
            key = key << bits | column
        keys.append(key)
    return keys


def _summed(columns: np.ndarray, counts: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows in order, with added counts."""
    keys = _packed(columns, max(1, int(n_words).bit_length()))
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return columns[:, order[at]], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def _windows(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Sorted words, distinct windows in order (language, then words, 0 after the end of a piece) and their counts."""
    words, piece, row = _words(batch)
    langs = pc.fill_null(batch.column("lang").cast(pa.string()), "und")
    for at in range(0, len(words), CHUNK_WORDS):
        stop = min(len(words), at + CHUNK_WORDS)
        ahead = min(len(words), stop + longest - 1)
        known, ids, lang_ids = _coded(words[at:ahead], langs)
        n = stop - at
        columns = np.zeros((longest + 1, n), np.int64)
        columns[0] = lang_ids[row[at:stop]]
        for j in range(longest):
            m = max(0, min(n, ahead - at - j))
            same = piece[at + j : at + j + m] == piece[at : at + m]
            columns[j + 1, :m] = np.where(same, ids[j : j + m], 0)
        yield known, *_summed(columns, np.ones(n, np.int64), len(known))


def _block(known: pa.Array, columns: np.ndarray, counts: np.ndarray) -> bytes:
    used, ids = np.unique(columns, return_inverse=True)
    has_end = int(len(used) > 0 and used[0] == 0)
    names = known.take(pa.array(used[has_end:] - 1))
    data, offsets = byte_column(names)
    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
    head = np.array([columns.shape[1], len(names), len(data), has_end], np.int64)
    body = [head, np.diff(offsets).astype(np.uint32), data, ids.reshape(columns.shape).astype(kind), counts.astype(np.uint32)]
    raw = b"".join(part.tobytes() for part in body)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpacked(block: bytes, longest: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    raw = _CODEC.decompress(block[8:], int.from_bytes(block[:8], "little"), asbytes=True)
    n, n_names, size, has_end = np.frombuffer(raw, np.int64, 4).tolist()
    at = 32
    lengths = np.frombuffer(raw, np.uint32, n_names, at)
    at += 4 * n_names
    offsets = np.append(0, np.cumsum(lengths, dtype=np.int64))
    names = pa.Array.from_buffers(pa.large_binary(), n_names, [None, pa.py_buffer(offsets), pa.py_buffer(raw[at : at + size])])
    at += size
    kind = np.uint16 if n_names + has_end < 1 << 16 else np.uint32
    ids = np.frombuffer(raw, kind, n * (longest + 1), at).reshape(longest + 1, n).astype(np.int64) + (1 - has_end)
    return names, ids, np.frombuffer(raw[len(raw) - 4 * n :], np.uint32).astype(np.int64)


def _cuts(known: pa.Array, columns: np.ndarray, borders: list[tuple[bytes, ...]]) -> np.ndarray:
    """How many of the sorted windows lie before each border."""
    names = known.to_pylist()
    out = []
    for border in borders:
        low, high = 0, columns.shape[1]
        for column, word in zip(columns, border):
            at = bisect_left(names, word) if word else -1
            wanted = at + 1
            begin, end = np.searchsorted(column[low:high], [wanted, wanted + 1])
            low, high = low + int(begin), low + int(end)
            if low == high or (word and names[at] != word):
                break
        out.append(low)
    return np.array(out, np.int64)


def _borders(docs: DataFrame, parts: int, longest: int) -> list[tuple[bytes, ...]]:
    """Windows that cut the sort order into about equal ranges, from a bounded sample; they only balance the work."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    share = min(1.0, SAMPLE_CHARS / chars) if chars else 1.0

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            words, piece, row = _words(batch)
            langs = batch.column("lang").to_pylist()
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            found = []
            for d in range(batch.num_rows):
                a, b = int(first[d]), int(first[d + 1])
                for at in np.unique(np.linspace(a, b - 1, min(SAMPLE_WINDOWS, b - a), dtype=np.int64)).tolist() if b > a else []:
                    window = [words[i].as_py() if i < b and piece[i] == piece[at] else b"" for i in range(at, at + longest)]
                    found.append([(langs[d] or "und").encode(), *window])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary()))], names=["window"])

    picked = docs.filter(F.rand(7) < share).mapInArrow(some, "window array<binary>")
    windows = sorted({tuple(bytes(w) for w in r["window"]) for r in picked.collect()})
    at = np.unique(np.linspace(0, len(windows), parts + 1)[1:-1].astype(int)) if windows else []
    return [windows[i] for i in at if 0 < i < len(windows)]


def count_stream(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, k, phrase, f``: all phrases of up to ``longest`` words with f >= least, and with k = 0 each language's words."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = parts_for(rows, "text")
    borders = _borders(rows, parts, longest)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            for known, columns, counts in _windows(batch, longest):
                at = np.append(_cuts(known, columns, borders), columns.shape[1])
                at = np.append(0, at)
                part = np.flatnonzero(np.diff(at))
                blocks = [_block(known, columns[:, at[p] : at[p + 1]], counts[at[p] : at[p + 1]]) for p in part]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "block"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist()):
                if part != now and held:
                    yield _runs(held, least, longest)
                    held = []
                now = part
                held.append(block)
        if held:
            yield _runs(held, least, longest)

    blocks = rows.mapInArrow(sent, "part int, block binary").repartitionById(len(borders) + 1, F.col("part")).sortWithinPartitions("part")
    counted = materialize(blocks.mapInArrow(merged, "lang string, k int, phrase string, f long"), "runs")
    total = counted.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return materialize(total.filter((F.col("k") == 0) | (F.col("f") >= least)), "stream")


def _runs(blocks: list[bytes], least: int, longest: int) -> pa.RecordBatch:
    """Phrases of one range that are frequent in it or may go on in another one."""
    parts = [_unpacked(b, longest) for b in blocks]
    names = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    order = pc.sort_indices(names.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    known = names.dictionary.take(pa.array(order)).to_pylist()
    ids, at, columns = place[names.indices.to_numpy()], 0, []
    for mine, own, _ in parts:
        columns.append(np.append(0, ids[at : at + len(mine)])[own])
        at += len(mine)
    columns, counts = _summed(np.concatenate(columns, axis=1), np.concatenate([p[2] for p in parts]), len(known))
    out: list[tuple[bytes, int, bytes, int]] = []
    new = np.zeros(len(counts), bool)
    new[:1] = True
    for k in range(longest + 1):
        new[1:] |= columns[k, 1:] != columns[k, :-1]
        first = np.flatnonzero(new)
        sums = np.add.reduceat(counts, first)
        keep = (columns[k, first] > 0) & ((sums >= least) | (k == 0))
        for edge in (0, len(first) - 1):
            keep[edge] = columns[k, first[edge]] > 0
        for run in np.flatnonzero(keep).tolist():
            window = columns[: k + 1, first[run]]
            out.append((known[window[0] - 1], k, b" ".join(known[i - 1] for i in window[1:]), int(sums[run])))
    lang, k, phrase, f = zip(*out)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(lang, pa.binary()).cast(pa.string()),
            pa.array(k, pa.int32()),
            pa.array(phrase, pa.binary()).cast(pa.string()),
            pa.array(f, pa.int64()),
        ],
        names=["lang", "k", "phrase", "f"],
    )


def scored(stream: DataFrame) -> DataFrame:
    """Candidates that no longer one absorbs, with their weakest cut: ``lang, phrase, a, l, r, n, score``."""
    counts = stream.filter("k > 0").select("lang", "phrase", "f")
    # one row per language, written so that Spark knows its size
    words = materialize(stream.filter("k = 0").select("lang", F.col("f").alias("n")), "words")
    candidates = stream.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"))
    cut = candidates.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.withColumn("head", F.expr("substring_index(phrase, ' ', c)")).withColumn("tail", F.expr("substring_index(phrase, ' ', c - k)"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    parts = cut.join(heads.hint("merge"), ["lang", "head"]).join(tails.hint("merge"), ["lang", "tail"])
    parts = parts.join(words, "lang")
    whole = "cast({} as decimal(38, 0))"
    value = F.expr(f"({whole.format(1000)} * {whole.format('a')} * {whole.format('n')}) div ({whole.format('l')} * {whole.format('r')})")
    weakest = F.min(F.struct(value.alias("score"), "c", "l", "r")).alias("best")
    best = parts.groupBy("lang", "phrase").agg(weakest, F.first("a").alias("a"), F.first("n").alias("n"))
    right = cut.filter("c = k - 1 and c > 1").select("lang", F.col("head").alias("phrase"), "a")
    left = cut.filter("c = 1 and k > 2").select("lang", F.col("tail").alias("phrase"), "a")
    extended = right.unionByName(left).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(extended.hint("merge"), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    return kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def mine_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's first ``top`` phrases by score, count and phrase: ``lang, rank, phrase, a, l, r, n, score``."""
    found = scored(count_stream(docs, least, longest, text, lang))
    keyed = found.select("*", (-F.col("score")).alias("down"), (-F.col("a")).alias("rare"))
    placed = ranked(keyed, ["lang"], ["down", "rare", "phrase"], "rank").filter(F.col("rank") <= top)
    return placed.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
