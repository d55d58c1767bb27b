"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token strings that the merges produce. It starts as one state with an arc per
base symbol. Each merge (u, v) -> w adds one gadget: all u-arcs go to a copy of their target that lacks the v-arc, and every state
with a u-arc gets a w-arc to where v led. So all arcs of one token share a target at any time: a state is the last token read,
its copies differ by what was removed when, and w starts from v's state of that time. ``has`` reads an arc off these tables by
following the right part of the state's token and the left part of the arc's; answers are kept in a transition table.
Encoding follows arcs over the word's bytes; a prefix has exactly one accepted token string, so a place is entered with one state
and, once found to lead nowhere, never again. Decoding emits the labels of the arcs.

Letters are those of this machine's Unicode tables; code points that Unicode assigned only lately may split differently elsewhere.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CACHED_WORDS = 1_000_000
END = "</w>"
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_MISSING, START = -1, (1 << 20) - 1


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next code point from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.labels = {i: t for t, i in vocab.items()}
        made = {u + v for u, v in merges}
        self.tokens = {i for t, i in vocab.items() if t not in made}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = dict.fromkeys(self.tokens, 0)
        self.removed: dict[int, dict[int, int]] = {}
        self.arcs: dict[int, bool] = {}
        for time, (u, v) in enumerate(merges, 1):
            self._gadget(vocab[u], vocab[v], vocab[u + v], time)
        self.last_time = len(merges)
        self.trie: dict[int, int] = {}
        self.accepts = [_MISSING]
        symbols = {c: b for b, c in enumerate(byte_symbols())}
        for text, token in vocab.items():
            if token in self.tokens:
                self._spell([symbols[c] for c in text.removesuffix(END)], text.endswith(END), token)

    def _spell(self, symbols: list[int], ends: bool, token: int) -> None:
        """Put a token's symbols into the table that finds tokens while reading; a last symbol with end mark is 256 higher."""
        node = 0
        for at, symbol in enumerate(symbols, 1):
            key = node << 9 | symbol + 256 * (ends and at == len(symbols))
            node = self.trie.setdefault(key, len(self.accepts))
            if node == len(self.accepts):
                self.accepts.append(_MISSING)
        self.accepts[node] = token

    def _gadget(self, u: int, v: int, w: int, time: int) -> None:
        if u not in self.tokens or v not in self.tokens or not self._had(u, time - 1, v):
            return  # the pair can no longer meet: the merge never fires
        self.removed.setdefault(u, {})[v] = time
        self.left[w], self.right[w], self.born[w] = u, v, time
        self.tokens.add(w)

    def _had(self, state: int, time: int, token: int) -> bool:
        """Whether the state after token ``state``, as it was at ``time``, has an arc labelled ``token``."""
        while True:
            if self.removed.get(state, {}).get(token, time + 1) <= time:
                return False
            made, since = self.born[token], self.born[state]
            if made and made >= since:  # the arc came with its left part's
                token, time = self.left[token], min(time, made)
            elif since:  # the state came from its right part's
                state, time = self.right[state], since - 1
            else:
                return True

    def has(self, state: int, token: int) -> bool:
        """Whether the finished automaton has an arc labelled ``token`` after token ``state``; the start has every arc."""
        if len(self.arcs) > 4_000_000:
            self.arcs.clear()
        known = self.arcs[state << 20 | token] = state == START or self._had(state, self.last_time, token)
        return known

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word: arcs are tried from the longest on; a place from which no path ends is never entered again."""
        size = len(word)
        symbols = [*word[:-1], word[-1] + 256]
        trie, accepts, arcs = self.trie.get, self.accepts, self.arcs.get
        at, state, out, closed = 0, START, [], bytearray(size + 1)
        open_arcs: list[list[tuple[int, int]]] = []
        came: list[tuple[int, int]] = []
        while True:
            found, node = [], 0
            for to in range(at, size):
                node = trie(node << 9 | symbols[to])
                if node is None:
                    break
                if accepts[node] != _MISSING:
                    found.append((accepts[node], to + 1))
            while True:
                row = state << 20
                while found:
                    token, to = found.pop()
                    if not closed[to]:
                        arc = arcs(row | token)
                        if arc or arc is None and self.has(state, token):
                            break
                else:
                    if not came:
                        return []
                    closed[at] = 1
                    at, state = came.pop()
                    found = open_arcs.pop()
                    out.pop()
                    continue
                break
            out.append(token)
            if to == size:
                return out
            came.append((at, state))
            open_arcs.append(found)
            at, state = to, token


class Encoder:
    """Normalising, splitting and the automaton, as the vocabulary file prescribes.

    No word crosses white space, so what a run of other characters gives is kept for the frequent runs, as bytes of its ids.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton.labels.update({i: t for t, i in self.special.items()})
        self.marks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.spoken: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _run(self, run: str) -> bytes:
        """Ids of a run of characters without white space (or with it, which parts words)."""
        text = run if run.isascii() else unicodedata.normalize("NFC", run).replace("Σ", "σ")
        known, out = self.words, []
        for word in self.split.findall(text.lower()):
            got = known.get(word)
            if got is None:
                if len(known) >= CACHED_WORDS:
                    known.clear()
                got = known[word] = array("I", self.automaton.encode(word.encode())).tobytes()
            out.append(got)
        return b"".join(out)

    def _plain(self, text: str) -> list[bytes]:
        if _SEPARATORS.search(text):  # white space to str.split, but not to the vocabulary's pattern
            return [self._run(text)]
        runs = self.runs
        parts = text.split()
        out = list(map(runs.get, parts))
        if None in out:
            for i, part in enumerate(parts):
                if out[i] is None:
                    if len(runs) >= CACHED_WORDS:
                        runs.clear()
                    out[i] = runs[part] = self._run(part)
        return out

    def parts(self, text: str) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers, by runs of characters."""
        if self.marks is None or "<|" not in text:
            return self._plain(text)
        out = []
        for piece in self.marks.split(text):
            out += [array("I", [self.special[piece]]).tobytes()] if piece in self.special else self._plain(piece)
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(self.parts(text))

    def decode(self, ids: list[int]) -> str:
        labels = self.automaton.labels
        return " ".join([labels[i] for i in ids])

    def _say(self, part: bytes) -> bytes:
        if len(self.spoken) >= CACHED_WORDS:
            self.spoken.clear()
        said = self.spoken[part] = self.decode(np.frombuffer(part, "<u4").tolist()).encode()
        return said

    def decode_parts(self, parts: list[bytes]) -> bytes:
        """What the ids of several runs decode to, in UTF-8."""
        spoken = self.spoken.get
        return b" ".join([spoken(p) or self._say(p) for p in parts if p])


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column("text"):
                parts = encoder.parts(text.as_py() or "")
                coded, decoded = b"".join(parts), encoder.decode_parts(parts)
                counts.append(len(coded) // 4)
                ids.append(hashlib.sha256(coded).hexdigest())
                texts.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            coded = [np.frombuffer(encoder.encode(t.as_py() or ""), "<u4").tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(coded, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            texts = [encoder.decode(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids. A null text has no ids; every row is answered for itself, in any order, repeated ids included."""
    return _texts(docs).mapInArrow(_encoded(path), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, text: the labels of the ids, parted by a space. Null or empty ids give the empty text."""
    return coded.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, text string")


def token_digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding and then decoding each whole text; no shuffle."""
    return _texts(docs).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
