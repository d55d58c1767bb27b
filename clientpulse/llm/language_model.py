"""Document scores by a hierarchical Pitman-Yor model of words in context, its seating sampled by Gibbs.

Every context, the word before, has a restaurant; all of them share one parent, the restaurant of words without context, whose own parent
gives each outcome the same probability. The outcomes are the training tokens and one symbol for every other word, as in the add-one
base. A table of a context's restaurant is a customer of the parent's. Contexts are told apart by ``BITS`` bits of the previous word's hash:
words that share them share a restaurant, so that what is known of all restaurants together has a fixed size.

With c customers and t tables of a word in context u, discount d and strength s, the predictive probability is

    P(word | u) = (c - d t + (s + d t_u) P(word)) / (s + c_u)

and likewise P(word) over its even base; in every context it adds up to one over all outcomes. Discounts follow from how many
cells hold one and two customers.

A sweep takes the customers of each dish out of their restaurant and seats them again, given the tables of the others and the parent's
state of the sweep before. After ``BURN`` sweeps the predictive probabilities of the following ones are averaged.
Every draw is a hash of the word, its context, the sweep and the customer: a seating is the same however the rows are dealt, and any task
can repeat the seatings so far from the cells and the totals of the earlier sweeps, so no seating has to be kept or moved.

Tasks send the cells of a slice of texts, (word, context, document) with counts, to the part that owns the word; the part keeps them as one
row. Words that a bounded sample shows to be frequent (at most ``HOT``) are dealt by word and context, and their parent's state is kept by the
driver. Sweeps move one number per context, scores one row per part and slice.

Null text is the empty text: its only token is the end. A null id is training. Without training text every count is 0 and the unknown symbol
is certain. Rows are answered one by one, repeated ids included. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.texts import Words, byte_column, mixed, sliced
from clientpulse.session import materialize, shuffle_width

BITS = 16
CONTEXTS = 1 << BITS
SWEEPS, BURN = 4, 2
STRENGTH, ROOT_STRENGTH = 1.0, 10.0
SLICE, SLICE_ROWS = 4 << 20, 1 << 16
HOT, SAMPLE_CHARS = 4096, 4_000_000
RUN = 64
PARTS, PART_CHARS = 32, 16_000_000  # parts at least, and characters whose words meet in one
UNIT = 2.0**-24  # parts' sums are rounded to it, so a text's score is right to a few millionths
START = 0  # the context of a text's first token
END = b""  # no word is empty, so the end token has this place
BLOCK = "part int, first long, block binary"


def packed(**arrays: np.ndarray) -> bytes:
    """Arrays of any lengths as one compressed block."""
    columns = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a)) for a in arrays.values()]
    batch = pa.RecordBatch.from_arrays(columns, names=list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(block).read_next_batch()
    return {n: c.flatten().to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns)}


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def _tokens(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens, and the token and text of every place; each text closes with the end token."""
    words = Words(batch.column("text"), lower=True)
    n, texts = len(words.starts), batch.num_rows
    bounds = np.empty(2 * n + 1, np.int64)
    bounds[0:-1:2], bounds[1::2], bounds[-1] = words.starts, words.ends, len(words.data)
    data = np.ascontiguousarray(words.data)
    both = pa.Array.from_buffers(pa.large_binary(), 2 * n, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    own = both.take(pa.array(np.arange(0, 2 * n, 2)))
    coded = pa.concat_arrays([own, pa.array([END], pa.large_binary())]).dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    token, row = np.empty(n + texts, np.int64), np.repeat(np.arange(texts), np.diff(words.first) + 1)
    token[np.arange(n) + words.row] = ids[:n]
    token[words.first[1:] + np.arange(texts)] = ids[n]
    return coded.dictionary, token, row


def context_of(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes, 1) >> np.uint64(64 - BITS)).astype(np.int64)


def _sent(parts: int, hot: list[bytes]) -> Callable:
    """Blocks of (word, context, text, count) by the part that owns them, and one with what a slice's texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = pa.array(hot, pa.large_binary())
        for wide in sliced(batches, "text", SLICE):
            for at in range(0, wide.num_rows, SLICE_ROWS):
                batch = wide.slice(at, SLICE_ROWS)
                first = batch.column("row")[0].as_py()
                held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                words, token, row = _tokens(batch)
                hashes = _hashes(words)
                before = np.empty(len(token), np.int64)
                before[1:] = context_of(hashes)[token[:-1]]
                before[np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))[:-1])] = START
                entry, count = np.unique((token << BITS | before) << 16 | row, return_counts=True)
                word, context, text = entry >> (BITS + 16), entry >> 16 & CONTEXTS - 1, entry & 0xFFFF
                is_hot = pc.is_in(words, frequent).to_numpy(zero_copy_only=False)
                dealt = np.where(is_hot[word], mixed(hashes[word] + context.astype(np.uint64), 2), mixed(hashes[word], 2))
                part = (dealt % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                blocks = []
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = order[cuts[p] : cuts[p + 1]]
                    used, local = np.unique(word[mine], return_inverse=True)
                    data, offsets = byte_column(words.take(pa.array(used)))
                    block = packed(
                        bytes=data,
                        sizes=np.diff(offsets).astype(np.uint32),
                        words=np.bincount(local).astype(np.uint32),
                        contexts=context[mine].astype(np.uint16),
                        texts=text[mine].astype(np.uint16),
                        counts=count[mine].astype(np.uint32),
                        held=np.packbits(held),
                    )
                    blocks.append((p, first, block))
                ids = batch.column("doc_id")
                facts = packed(
                    ids=ids.fill_null(0).to_numpy(),
                    known=ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8),
                    held=held.astype(np.uint8),
                    tokens=np.bincount(row, minlength=batch.num_rows),
                )
                blocks.append((-1 - first % parts, first, facts))
                columns = list(zip(*blocks))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
                    names=["part", "first", "block"],
                )

    return run


def _owned(hot: list[bytes]) -> Callable:
    """One row per part: its words and cells, and the entries of every slice; the slices' facts pass through."""

    def merged(blocks: list[tuple[int, bytes]]) -> tuple:
        read = [(first, unpacked(b)) for first, b in blocks]
        names = []
        for _, b in read:
            offsets = np.append(0, np.cumsum(b["sizes"], dtype=np.int64))
            names.append(pa.Array.from_buffers(pa.large_binary(), len(b["sizes"]), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(b["bytes"]))]))
        coded = pa.concat_arrays(names).dictionary_encode()
        ids, at, keys, trained = coded.indices.to_numpy().astype(np.int64), 0, [], []
        for _, b in read:
            own = ids[at : at + len(b["sizes"])]
            at += len(b["sizes"])
            keys.append(np.repeat(own, b["words"]) << BITS | b["contexts"])
            held = np.unpackbits(b["held"]).astype(bool)
            trained.append(np.where(held[b["texts"]], 0, b["counts"]))
        cell, which = np.unique(np.concatenate(keys), return_inverse=True)
        customers = np.bincount(which, weights=np.concatenate(trained), minlength=len(cell)).astype(np.int64)
        place = {w: i for i, w in enumerate(hot)}
        words = coded.dictionary.to_pylist()
        cells = packed(
            hashes=_hashes(coded.dictionary),
            hot=np.fromiter((place.get(w, -1) for w in words), np.int32, len(words)),
            words=np.bincount(cell >> BITS, minlength=len(words)).astype(np.uint32),
            contexts=(cell & CONTEXTS - 1).astype(np.uint16),
            customers=customers.astype(np.uint32 if customers.max(initial=0) < 1 << 32 else np.int64),
        )
        entries, at = [], 0
        for first, b in read:
            mine = which[at : at + len(b["texts"])]
            at += len(b["texts"])
            entries.append(packed(cells=np.diff(mine, prepend=0).astype(np.int32), texts=b["texts"], counts=b["counts"]))
        return cells, [first for first, _ in read], entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            for part, first, block in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "block"))):
                if part != now and blocks:
                    yield _row(now, *merged(blocks))
                    blocks = []
                now = part
                if part < 0:
                    yield _row(part, None, [first], [block])
                else:
                    blocks.append((first, block))
        if blocks:
            yield _row(now, *merged(blocks))

    return run


def _row(part: int, cells: bytes | None, first: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([cells], pa.binary()), pa.array([first], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary()))],
        names=["part", "cells", "first", "blocks"],
    )


ROW = "part int, cells binary, first array<long>, blocks array<binary>"


def uniform(seeds: np.ndarray, sweep: int, customer: int) -> np.ndarray:
    """A number in (0, 1) per seed, sweep and customer."""
    step = (customer * 0xD1342543DE82EF95 + sweep * 0x9E3779B97F4A7C15) % (1 << 64)
    return ((mixed(seeds + np.uint64(step)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def seated(customers: np.ndarray, discount: float, strength: float, others: np.ndarray, base: np.ndarray, seeds: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish when its customers sit down one after another.

    With i of them seated at t tables, the next one opens a table with weight (strength + discount (others + t)) base against i - discount t.
    They come in runs of a ``RUN``-th of those seated, one at least, whose odds are those of the run's first; the new tables of a run
    are their expected number, rounded up or down at random, which for a run of one is the draw itself.
    """
    tables = np.minimum(customers, 1)
    order = np.argsort(-customers, kind="stable")
    left, pull, own, rest = customers[order], base[order], seeds[order], others[order]
    got = tables[order].astype(np.float64)
    done = 1
    while True:
        active = int(np.searchsorted(-left, -done, "left"))  # those with more customers than are seated
        if not active:
            break
        t = got[:active]
        new = (strength + discount * (rest[:active] + t)) * pull[:active]
        run = max(1, done // RUN)
        comes = np.minimum(run, left[:active] - done) if run > 1 else 1
        t += np.floor(comes * (new / (done - discount * t + new)) + uniform(own[:active], sweep, done))
        done += run
    tables[order] = got.astype(np.int64)
    return tables


@dataclass(frozen=True)
class Totals:
    """What a sweep leaves that parts have to know of one another: fixed in size."""

    tables: np.ndarray  # per context
    guests: int  # of the parent
    root_tables: int
    hot_guests: np.ndarray
    hot_tables: np.ndarray


@dataclass
class Model:
    hot: list[bytes]
    hot_hashes: np.ndarray
    hot_counts: np.ndarray = None
    customers: np.ndarray = None  # per context
    tokens: int = 0
    distinct: int = 0
    discount: float = 0.5
    root_discount: float = 0.5
    totals: list[Totals] = field(default_factory=list)

    def root(self, guests: np.ndarray, tables: np.ndarray, sweep: int) -> np.ndarray:
        """P(word) by the parent's state after a sweep."""
        t = self.totals[sweep]
        even = (ROOT_STRENGTH + self.root_discount * t.root_tables) / (self.distinct + 1)
        return (guests - self.root_discount * tables + even) / (ROOT_STRENGTH + t.guests)


@dataclass
class Part:
    """The words and cells of one part."""

    hashes: np.ndarray
    hot: np.ndarray
    word: np.ndarray
    contexts: np.ndarray
    customers: np.ndarray

    @classmethod
    def of(cls, cells: bytes) -> Part:
        read = unpacked(cells)
        word = np.repeat(np.arange(len(read["hashes"])), read["words"])
        return cls(read["hashes"], read["hot"], word, read["contexts"].astype(np.int64), read["customers"].astype(np.int64))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, weights=values, minlength=len(self.hashes)).astype(np.int64)

    def counts(self, model: Model) -> np.ndarray:
        """Training occurrences of each word, wherever they are."""
        return self._whole(self.sums(self.customers), model.hot_counts)

    def _whole(self, own: np.ndarray, of_hot: np.ndarray) -> np.ndarray:
        return np.where(self.hot >= 0, of_hot[np.maximum(self.hot, 0)], own) if len(of_hot) else own

    def seatings(self, model: Model, sweeps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tables per cell, and guests and tables of the parent per word, after each sweep; those of frequent words are the driver's.

        Sweep k needs the totals of sweeps before k, and its own only to be told the parent's state of frequent words.
        """
        seeds = mixed(self.hashes[self.word] ^ (self.contexts.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), 3)
        tables = np.minimum(self.customers, 1)
        guests = self.sums(tables)
        root = np.minimum(guests, 1)
        yield tables, guests, root
        for sweep in range(1, sweeps):
            before = model.totals[sweep - 1]
            word = model.root(self._whole(guests, before.hot_guests), self._whole(root, before.hot_tables), sweep - 1)
            others = before.tables[self.contexts] - tables
            tables = seated(self.customers, model.discount, STRENGTH, others, word[self.word], seeds, sweep)
            guests = self.sums(tables)
            root = seat_root(model, guests, root, self.hashes, sweep)
            yield tables, guests, root


def seat_root(model: Model, guests: np.ndarray, tables: np.ndarray, hashes: np.ndarray, sweep: int) -> np.ndarray:
    others = model.totals[sweep - 1].root_tables - tables
    even = np.full(len(guests), 1 / (model.distinct + 1))
    return seated(guests, model.root_discount, ROOT_STRENGTH, others, even, mixed(hashes, 4), sweep)


_FACTS = 6  # words, ones, twos, root ones, root twos, tokens


def _swept(model: Model, sweep: int) -> Callable:
    """Sums of one sweep over a task's parts: tables per context, then those of the parent, of frequent words and of the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = len(model.hot), None
        for batch in batches:
            for cells in batch.column("cells").to_pylist():
                part = Part.of(cells)
                *_, (tables, guests, root) = part.seatings(model, sweep + 1)
                mine, cold = np.zeros(2 * CONTEXTS + 2 + 2 * n + _FACTS, np.int64), part.hot < 0
                mine[:CONTEXTS] = np.bincount(part.contexts, weights=tables, minlength=CONTEXTS)
                mine[CONTEXTS : 2 * CONTEXTS] = np.bincount(part.contexts, weights=part.customers, minlength=CONTEXTS)
                counts = part.sums(part.customers)
                at = 2 * CONTEXTS + 2
                mine[at - 2], mine[at - 1] = guests.sum(), root[cold].sum()
                mine[at : at + n] = np.bincount(part.hot[~cold], weights=guests[~cold], minlength=n)[:n]
                mine[at + n : at + 2 * n] = np.bincount(part.hot[~cold], weights=counts[~cold], minlength=n)[:n]
                singles = [(counts[cold] > 0), part.customers == 1, part.customers == 2, guests[cold] == 1, guests[cold] == 2]
                mine[at + 2 * n :] = [*(s.sum() for s in singles), part.customers.sum()]
                total = mine if total is None else total + mine
        if total is not None:
            slot = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([packed(sums=total)], pa.binary())], names=["slot", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for block in batch.column("sums").to_pylist():
            mine = unpacked(block)["sums"]
            total = mine if total is None else total + mine
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([packed(sums=total)], pa.binary())], names=["slot", "sums"])


def _collected(parts: DataFrame, model: Model, sweep: int) -> np.ndarray:
    """The sums of a sweep over all parts, added up by two rounds of tasks; the driver gets a few rows of fixed size."""
    width = shuffle_width(parts.sparkSession)
    sums = parts.mapInArrow(_swept(model, sweep), "slot int, sums binary").repartition(max(1, width // 8), "slot")
    total = np.zeros(2 * CONTEXTS + 2 + 2 * len(model.hot) + _FACTS, np.int64)
    for r in sums.mapInArrow(_added, "slot int, sums binary").collect():
        total += unpacked(bytes(r["sums"]))["sums"]
    return total


def _discount(ones: int, twos: int) -> float:
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones + twos else 0.5


def sample_model(parts: DataFrame, hot: list[bytes], sweeps: int = SWEEPS) -> Model:
    """The totals after each sweep, from rows of ``cells``."""
    model = Model(hot, _hashes(pa.array(hot, pa.large_binary())))
    n, at = len(hot), 2 * CONTEXTS + 2
    model.hot_counts = np.zeros(n, np.int64)
    for sweep in range(sweeps):
        sums = _collected(parts, model, sweep)
        guests = sums[at : at + n]
        if sweep == 0:
            model.customers, model.hot_counts = sums[CONTEXTS : 2 * CONTEXTS], sums[at + n : at + 2 * n]
            words, ones, twos, root_ones, root_twos, model.tokens = (int(x) for x in sums[at + 2 * n :])
            model.distinct = words + int((model.hot_counts > 0).sum())
            model.discount = _discount(ones, twos)
            model.root_discount = _discount(root_ones + int((guests == 1).sum()), root_twos + int((guests == 2).sum()))
            tables = np.minimum(guests, 1)
        else:
            tables = seat_root(model, guests, model.totals[-1].hot_tables, model.hot_hashes, sweep)
        model.totals.append(Totals(sums[:CONTEXTS], int(sums[at - 2]), int(sums[at - 1] + tables.sum()), guests, tables))
    return model


def probabilities(part: Part, model: Model, burn: int = BURN) -> tuple[np.ndarray, np.ndarray]:
    """P(word | context) of every cell, averaged over the kept sweeps (of the unknown symbol where the word is not known), and each
    word's training occurrences."""
    counts = part.counts(model)
    out = np.zeros(len(part.word))
    kept = range(min(burn, len(model.totals) - 1), len(model.totals))
    for sweep, (tables, guests, root) in enumerate(part.seatings(model, len(model.totals))):
        if sweep not in kept:
            continue
        t = model.totals[sweep]
        word = model.root(part._whole(guests, t.hot_guests), part._whole(root, t.hot_tables), sweep)
        word = np.where(counts > 0, word, model.root(np.zeros(1), np.zeros(1), sweep))
        spread = (STRENGTH + model.discount * t.tables) / (STRENGTH + model.customers)
        own = (part.customers - model.discount * tables) / (STRENGTH + model.customers[part.contexts])
        out += own + spread[part.contexts] * word[part.word]
    return out / len(kept), counts


def _units(sums: np.ndarray) -> np.ndarray:
    """Sums of logarithms as whole multiples of ``UNIT``, half as wide and the same in whatever order they are added."""
    whole = np.rint(sums / UNIT).astype(np.int64)
    return whole.astype(np.int32) if np.abs(whole).max(initial=0) < 1 << 31 else whole


def _scored(model: Model) -> Callable:
    """Per part and slice, the sums over the texts' tokens that the part owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part.of(batch.column("cells")[i].as_py())
                p, counts = probabilities(part, model)
                score = np.log10(np.maximum(p, 1e-300))
                base = np.log10((counts + 1) / (model.tokens + model.distinct + 1))
                known = (counts > 0)[part.word]
                base = base[part.word]
                firsts, blocks = batch.column("first")[i].as_py(), []
                for block in batch.column("blocks")[i]:
                    b = unpacked(block.as_py())
                    cell, weight = np.cumsum(b["cells"]), b["counts"].astype(np.float64)
                    text, at = np.unique(b["texts"], return_inverse=True)
                    sums = {n: np.bincount(at, weights=weight * v[cell], minlength=len(text)) for n, v in (("score", score), ("base", base), ("known", known))}
                    blocks.append(packed(texts=text, score=_units(sums["score"]), base=_units(sums["base"]), known=sums["known"].astype(np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(blocks, pa.binary())], names=["first", "block"])

    return run


def _answered(tokens: int) -> Callable:
    """The rows of one slice: its facts and the sums of all parts."""

    def run(table: pa.Table) -> pa.Table:
        read = [unpacked(b) for b in table.column("block").to_pylist()]
        facts = next(b for b in read if "ids" in b)
        n = len(facts["ids"])
        score, base, known = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in read:
            if "ids" not in b:
                score[b["texts"]] += b["score"]
                base[b["texts"]] += b["base"]
                known[b["texts"]] += b["known"]
        ids = pa.array(facts["ids"], pa.int64(), mask=facts["known"] == 0)
        return pa.table(
            {
                "doc_id": ids,
                "held_out": pa.array(facts["held"].astype(bool)),
                "n_tokens": pa.array(facts["tokens"], pa.int64()),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(n, tokens), pa.int64()),
                "base_score": pa.array(base * UNIT),
                "score": pa.array(score * UNIT),
            }
        )

    return run


def _frequent(texts: DataFrame) -> list[bytes]:
    """At most ``HOT`` words that make up a large share of a bounded sample; being among them changes where a word is counted only."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    share = min(1.0, SAMPLE_CHARS / chars) if chars else 1.0

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            words, token, _ = _tokens(batch)
            n = np.bincount(token, minlength=len(words))
            yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    counts = texts.filter(F.rand(7) < share).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") * HOT >= F.lit(total)).orderBy(F.desc("n"), "word").limit(HOT).collect()
    return sorted(bytes(r["word"]) for r in found)


def seat_documents(docs: DataFrame, held_out: Column) -> tuple[DataFrame, list[bytes]]:
    """The parts' rows, and those of the slices' facts (part below 0), with the frequent words."""
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    # not as many as the session's partitions: a text's sum is rounded part by part, so its score would follow that setting
    parts, hot = max(PARTS, math.ceil(chars / PART_CHARS)), _frequent(texts.select("text"))
    sent = texts.mapInArrow(_sent(parts, hot), BLOCK)
    dealt = sent.repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int")).sortWithinPartitions("part", "first")
    return materialize(dealt.mapInArrow(_owned(hot), ROW), "parts"), hot


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``held_out`` says which rows the model doesn't learn from."""
    rows, hot = seat_documents(docs, held_out)
    parts = rows.filter("part >= 0")
    model = sample_model(parts.select("cells"), hot)
    sums = parts.select("cells", "first", "blocks").mapInArrow(_scored(model), "first long, block binary")
    facts = rows.filter("part < 0").select(F.col("first")[0].alias("first"), F.col("blocks")[0].alias("block"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return facts.unionByName(sums).groupBy("first").applyInArrow(_answered(model.tokens), schema)
