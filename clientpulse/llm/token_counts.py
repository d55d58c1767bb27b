"""Exact token counts at every prefix of a text, by dynamic programming over the pieces of a BPE vocabulary.

Let the last token of a prefix be t. Then the tokens before t are the encoding of the shorter prefix without t, and t is the only
token ending there that *follows* the last token u of that shorter prefix: encoding the two strings u + t alone gives back u and
t. (Merges inside a run of neighbouring tokens do not depend on what stands outside of it, and a token string whose neighbours
all follow one another is an encoding, since the first merge across a border would also be made in the pair alone.) So

    count(prefix) = count(prefix without t) + 1

and one pass gives the count of every prefix, without ever merging. Truncation and budget questions are answered from the stored
counts (``counts_at``, ``longest_within``, ``over_budget``).

Whether t follows u is read off two short histories kept per piece: the symbols that stand at its right (left) edge while it is
merged, each with the rank of the merge that ends it. Walking both together, a piece that joins the two edges and ranks before
the merges that end them shows that t does not follow u.

A vocabulary is a sentencepiece BPE model with identity normalisation, dummy prefix and byte fallback: space is U+2581, one is
put before a text that is not empty, and a character outside the vocabulary counts as its UTF-8 bytes. Pieces hold no space after
another character, so texts are cut before spaces (and around bytes in no piece), and each distinct segment of a slice is worked
off once, all segments in step.

Edge cases: null and empty texts have no tokens and no steps. Repeated rows are each answered; null ids stay null; an empty table
gives an empty result. Columns other than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from clientpulse.llm.texts import byte_column, sliced

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SEGMENT_SLICE = 4 << 20
BATCH = 1 << 15
LONG = 96
SPACE = "▁"
NEVER = np.int32(1 << 30)
SCHEMA = "doc_id {id}, n_bytes long, n_tokens long, prefix_steps binary"


class Lookup:
    """Whole numbers to whole numbers, read many at a time; -1 where a key is missing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


class Pieces:
    """Tables of one vocabulary: pieces by their reversed characters, joins of two pieces, edge histories."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("needs a BPE model with byte fallback")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("needs identity normalisation with a dummy prefix")
        scored = [(p.piece, p.score) for p in model.pieces if p.type == 1]
        if any(a != SPACE and b == SPACE for p, _ in scored for a, b in zip(p, p[1:])):
            raise ValueError("a piece holds a space after another character")
        order = {s: i for i, s in enumerate(sorted({s for _, s in scored}, reverse=True))}
        self.rank = {p: order[s] for p, s in scored}
        chars = sorted({c for p in self.rank for c in p})
        names = [*self.rank, *[c for c in chars if c not in self.rank]]
        self.ids = {p: i for i, p in enumerate(names)}
        self.other = len(names)  # a character in no piece
        self.length = np.array([len(p) for p in names] + [1], np.int64)
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.class_of[0x20] = self.class_of[ord(SPACE)]
        self.cut = np.array([b < 128 and b != 0x20 and chr(b) not in chars for b in range(256)])
        self.single = np.append(self.other, [self.ids[c] for c in chars]).astype(np.int32)
        self.bytes_of = np.array([1] * len(names) + [0])
        for i, c in enumerate(names):
            if c not in self.rank:
                self.bytes_of[i] = len(c.encode())
        self._joins()
        self._histories(names)
        self._trie(names)

    def _joins(self) -> None:
        keys, ranks = [], []
        for piece, rank in self.rank.items():
            for at in range(1, len(piece)):
                a, b = self.ids.get(piece[:at]), self.ids.get(piece[at:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ranks.append(rank)
        self.join = Lookup(np.array(keys, np.int64), np.array(ranks, np.int32))

    def _merge(self, piece: str) -> list[tuple[int, int, list[str]]]:
        """Merges of the piece alone as (rank, place, symbols after it)."""
        symbols, done = list(piece), []
        while True:
            ranks = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.rank]
            if not ranks:
                return done
            rank, i = min(ranks)
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
            done.append((rank, i, symbols))

    def _histories(self, names: list[str]) -> None:
        """Edge symbols of every piece and the rank of the merge that ends each; a whole piece ends never."""
        right, left, self.made = [], [], np.zeros(len(names) + 1, bool)
        self.made[self.other] = True
        for i, piece in enumerate(names):
            steps = self._merge(piece)
            if any(a[0] > b[0] for a, b in zip(steps, steps[1:])):
                raise ValueError(f"the merges of piece {piece!r} are not in the order of their ranks")
            self.made[i] = len(piece) == 1 or (bool(steps) and len(steps[-1][2]) == 1)
            edges = ([], [])
            now = list(piece)
            for rank, _, after in steps:
                for side, at in ((0, -1), (1, 0)):
                    if after[at] != now[at]:
                        edges[side].append((self.ids[now[at]], rank))
                now = after
            right.append([*edges[0], (self.ids[now[-1]], NEVER)])
            left.append([*edges[1], (self.ids[now[0]], NEVER)])
        for rows in (right, left):
            rows.append([(self.other, NEVER)])
        self.right, self.right_end = _padded(right)
        self.left, self.left_end = _padded(left)

    def _trie(self, names: list[str]) -> None:
        """Reversed characters of the pieces that can be last tokens."""
        edges, self.token_at, n = {}, [-1], 1
        for i, piece in enumerate(names):
            if not self.made[i]:
                continue
            node = 0
            for c in reversed(piece):
                key = node << 16 | int(self.class_of[ord(c)])
                if key not in edges:
                    edges[key] = n
                    self.token_at.append(-1)
                    n += 1
                node = edges[key]
            self.token_at[node] = i
        self.token_at = np.array(self.token_at, np.int32)
        self.step = Lookup(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))

    def follows(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether encoding u + v alone gives u and v."""
        good = np.ones(len(u), bool)
        at = np.arange(len(u))
        i = np.zeros(len(u), np.int64)
        j = np.zeros(len(u), np.int64)
        while len(at):
            ends, ends2 = self.right_end[u, i], self.left_end[v, j]
            joined = self.join(self.right[u, i].astype(np.int64) << 20 | self.left[v, j])
            taken = (joined >= 0) & (joined < ends) & (joined <= ends2)
            good[at[taken]] = False
            on = ~taken & ((ends < NEVER) | (ends2 < NEVER))
            first = ends <= ends2
            i, j = (i + first)[on], (j + ~first)[on]
            u, v, at = u[on], v[on], at[on]
        return good

    def candidates(self, classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per place the tokens that end there, longest first: first index of each place's run, and all tokens."""
        n = len(classes)
        room = np.arange(n) - np.repeat(starts[:-1], np.diff(starts)) + 1
        at, node, length, found = np.arange(n), np.zeros(n, np.int64), 0, []
        while len(at):
            node = self.step(node << 16 | classes[at - length])
            alive = node >= 0
            at, node = at[alive], node[alive].astype(np.int64)
            tokens = self.token_at[node]
            hit = tokens >= 0
            found.append((at[hit], tokens[hit]))
            length += 1
            inside = room[at] > length
            at, node = at[inside], node[inside]
        other = np.flatnonzero(classes == 0)
        found.append((other, np.full(len(other), self.other, np.int32)))
        places = np.concatenate([p for p, _ in reversed(found)])
        tokens = np.concatenate([t for _, t in reversed(found)])
        order = np.argsort(places, kind="stable")
        return np.searchsorted(places[order], np.arange(n + 1)), tokens[order]

    def prefix_counts(self, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each segment up to each of its characters; ``sizes`` are the UTF-8 bytes of the characters.

        All segments advance together, one character a step, so segments should be of like length.
        """
        first, tokens = self.candidates(classes, starts)
        counts = np.zeros(len(classes), np.int64)
        last = np.full(len(classes), self.other, np.int64)
        lengths = np.diff(starts)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = starts[:-1][order], lengths[order]
        for i in range(int(lengths[0]) if len(lengths) else 0):
            rows = begin[: np.searchsorted(-lengths, -i, "left")]
            place, pick = rows + i, first[rows + i]
            while len(place):
                token = tokens[pick]
                before = place - self.length[token]
                inside = before >= rows
                good = np.ones(len(place), bool)
                good[inside] = self.follows(last[before[inside]], token[inside])
                done = place[good]
                earlier = np.where(inside, counts[np.maximum(before, 0)], 0)[good]
                own = np.where(token[good] == self.other, sizes[done], self.bytes_of[token[good]])
                counts[done], last[done] = earlier + own, token[good]
                rows, place, pick = rows[~good], place[~good], pick[~good] + 1
        return counts

    def long_counts(self, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same for one long segment, character by character, with a table of pairs already judged."""
        first, tokens = self.candidates(classes, np.array([0, len(classes)]))
        first, tokens = first.tolist(), tokens.tolist()
        lengths, widths = self.length.tolist(), self.bytes_of.tolist()
        counts, last, judged = [0], [-1], {}
        for i in range(len(classes)):
            for token in tokens[first[i] : first[i + 1]]:
                before = i + 1 - lengths[token]
                u = last[before]
                if u >= 0 and (u, token) not in judged:
                    judged[u, token] = bool(self.follows(np.array([u]), np.array([token]))[0])
                if u < 0 or judged[u, token]:
                    counts.append(counts[before] + (int(sizes[i]) if token == self.other else widths[token]))
                    last.append(token)
                    break
        return np.array(counts[1:], np.int64)


def _padded(rows: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, rows))
    full = np.array([r + [r[-1]] * (width - len(r)) for r in rows], np.int32)
    return np.ascontiguousarray(full[:, :, 0]), np.ascontiguousarray(full[:, :, 1])


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _segments(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Segments of all texts, a space put before each text, and the first segment of every row."""
    full = np.diff(offsets) > 0
    spaced = np.insert(data, offsets[:-1][full], 0x20)
    ends = offsets + np.append(0, np.cumsum(full))
    alone = cut[spaced]
    begin = alone.copy()
    begin[1:] |= alone[:-1]
    space = spaced == 0x20
    begin[1:] |= space[1:] & ~space[:-1] & (spaced[:-1] != 0x81)
    begin[ends[:-1][full]] = True
    starts = np.append(np.flatnonzero(begin), len(spaced))
    column = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(spaced)])
    return column, np.searchsorted(starts, ends)


def _counted(words: pa.Array, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Counts at every character of every distinct segment, and the first character of each."""
    text = words.cast(pa.large_string())
    lengths = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.append(0, np.cumsum(lengths))
    data, _ = byte_column(words)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    classes = table.class_of[points].astype(np.int64)
    sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    counts = np.zeros(len(points), np.int64)
    order = np.argsort(lengths, kind="stable")
    short = order[: np.searchsorted(lengths[order], LONG, "right")]
    for at in range(0, len(short), BATCH):
        mine = short[at : at + BATCH]
        inner = np.append(0, np.cumsum(lengths[mine]))
        places = np.repeat(starts[mine] - inner[:-1], lengths[mine]) + np.arange(inner[-1])
        counts[places] = table.prefix_counts(classes[places], inner, sizes[places])
    for w in order[len(short) :]:
        span = slice(starts[w], starts[w + 1])
        counts[span] = table.long_counts(classes[span], sizes[span])
    return counts, starts


def _steps(data: np.ndarray, offsets: np.ndarray, table: Pieces, keep: bool) -> tuple[np.ndarray, list[bytes] | None]:
    """Tokens of each text and, if asked for, the change of the count with every character."""
    segments, first = _segments(data, offsets, table.cut)
    coded = segments.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    counts, starts = _counted(coded.dictionary, table)
    total = counts[starts[1:] - 1] if len(counts) else counts
    sums = np.append(0, np.cumsum(total[which]))
    tokens = sums[first[1:]] - sums[first[:-1]]
    if not keep:
        return tokens, None
    change = counts.copy()
    change[1:] -= counts[:-1]
    change[starts[:-1]] = counts[starts[:-1]]
    lengths = np.diff(starts)[which]
    places = np.append(0, np.cumsum(lengths))
    spread = change[np.repeat(starts[which] - places[:-1], lengths) + np.arange(places[-1])]
    bounds, out = places[first], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if a == b:
            out.append(b"")
            continue
        mine = spread[a + 1 : b].copy()  # the space put before the text belongs to its first character
        mine[0] += spread[a]
        low, high = int(mine.min()), int(mine.max())
        width = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        out.append(mine.astype(width).tobytes())
    return tokens, out


def prefix_counts(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, prefix_steps``: tokens of every whole text and, with ``keep``, of every prefix of it.

    ``prefix_steps`` holds one signed little-endian number per code point, the change of the count with it, in the fewest bytes
    (1, 2, 4 or 8) that hold all of the text's numbers; null without ``keep``.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for batch in sliced(batches, "text", SEGMENT_SLICE):
            data, offsets = byte_column(batch.column("text"))
            tokens, steps = _steps(data, offsets, table, keep)
            kept = pa.array(steps if keep else [None] * batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(tokens, pa.int64()), kept],
                names=["doc_id", "n_bytes", "n_tokens", "prefix_steps"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(counted, SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()))


def _decoded(steps: bytes, n_chars: int) -> np.ndarray:
    """Counts at prefixes of 0, 1, ... code points."""
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[len(steps) // n_chars] if n_chars else np.int8
    return np.append(0, np.cumsum(np.frombuffer(steps, kind).astype(np.int64)))


def _all_counts(steps, n_chars):
    return None if steps is None else _decoded(bytes(steps), n_chars).tolist()


def _longest(steps, n_chars, budget):
    if steps is None or budget is None or budget < 0:
        return None
    return int(np.flatnonzero(_decoded(bytes(steps), n_chars) <= budget)[-1])


def counts_at(steps: Column, n_chars: Column) -> Column:
    """Array of the counts at prefixes of 0, 1, ..., n_chars code points; null where no steps were kept."""
    return F.udf(_all_counts, "array<long>")(steps, n_chars)


def longest_within(steps: Column, n_chars: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens (counts may fall with a character, so not the first excess
    decides); null where the budget is null or negative or no steps were kept."""
    return F.udf(_longest, "long")(steps, n_chars, budget)


def over_budget(counted: DataFrame, budget: int = 4096) -> DataFrame:
    """Add ``over_limit``: more than ``budget`` tokens."""
    return counted.withColumn("over_limit", F.col("n_tokens") > budget)
