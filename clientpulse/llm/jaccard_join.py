"""Exact n-gram Jaccard join by prefix trees, and the groups its links form.

A document's set is its distinct word shingles. Equal sets become one class. A shingle of one class alone adds to no overlap, so each class
first learns how many of its shingles others have too, and leaves if these are fewer than a link needs. The classes that stay learn which
shingles they share, and how common those are among them: that is the global order, rarest first. Sets that reach the threshold share one
of their first shared elements, so every class reports those; each element names the smallest class that reports it, its pivot, and a class
joins the buckets of its pivots: any two that share a first element meet in one bucket.
Members without another of like size, or whose
odd sketch differs from all others by more bits than a link allows, leave the bucket before any text moves. In a bucket the sets stand in a trie of shared beginnings. Each set walks it, adding up the overlap with every shared segment once, and leaves
a subtree when no length in it can still reach the threshold, or when all of it already belongs to the walker's group.

Buckets over ``BLOCK`` shingles are cut into blocks that all hold the pivot. Whatever is then outside the bucket's largest group is compared
with all its blocks, so no link between different sets is lost and nothing is compared that is already together. Links are one per set and
bucket; groups come from alternating stars over them.

A class is known by a 64-bit name; where two different sets get the same one, all are named anew.

Null, empty or white-only text has the empty set and is linked with nothing. Repeated ids are one document each and count as equal ids in groups;
a null id is never the smallest unless alone. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.shared_shingles import PART_MB, rarest_shared, shared_counts
from clientpulse.llm.texts import Words, mixed, parts_for, sliced
from clientpulse.session import materialize

SIZE, LEAST = 4, 85  # words of a shingle; percent
NAMINGS = 16  # tries to name all sets apart
ENTRIES = 1 << 20  # shingles that a task sorts at a time
SMALL = 200  # what a set of any size counts for in a block
BLOCK = 600_000  # shingles of the sets that one trie holds, about


class Sets:
    """The distinct shingles of every row, as ``items[first[d]:first[d + 1]]`` in order of their hashes."""

    def __init__(self, column: pa.Array, size: int):
        words = Words(column, lower=True)
        at, hashes = words.windows(size)
        row = words.row[at]
        count = np.diff(words.first)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):  # the whole sequence is the one shingle
            whole = [mixed(np.array([np.bitwise_xor.reduce(mixed(words.hashes[words.first[d] : words.first[d + 1]] + np.arange(count[d], dtype=np.uint64)))], np.uint64), 77 + count[d])[0] for d in short]
            row, hashes = np.concatenate([row, short]), np.concatenate([hashes, np.array(whole, np.uint64)])
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
        self.row, self.items = row[fresh], hashes[fresh]
        self.first = np.searchsorted(self.row, np.arange(len(column) + 1))

    def parities(self) -> list[bytes]:
        """Odd sketch of each set: a bit per hash value, flipped by every element; two bits or more per element.

        Two sketches differ in no more bits than their sets differ in elements. A bit's place is the hash's first digits, so a sketch
        is halved by joining neighbours.
        """
        spread, out = mixed(self.items, 9), []
        for low, high in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            bits = 64 << max(0, (2 * (high - low) - 1).bit_length() - 6)
            flips = np.bincount((spread[low:high] >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits)
            out.append(np.packbits((flips & 1).astype(np.uint8)).tobytes())
        return out

    def names(self, naming: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit names of each row's set."""
        out = []
        for seed in (2 * naming + 1, 2 * naming + 2):
            sums = np.zeros(len(self.items) + 1, np.uint64)
            np.cumsum(mixed(self.items, seed), out=sums[1:])
            out.append(mixed(sums[self.first[1:]] - sums[self.first[:-1]], seed).astype(np.int64))
        return out[0], out[1]


def _named(size: int, naming: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per document."""
        for batch in sliced(batches, "text"):
            sets = Sets(batch.column("text"), size)
            n = np.diff(sets.first)
            name, check = sets.names(naming)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(name, mask=n == 0), pa.array(check)], ["doc_id", "n", "set_id", "other"])

    return run


def _entries(size: int, naming: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Set and shingle of every entry of the sets that have an id, about ``ENTRIES`` at a time; each set once."""
        names, items, seen = [], [], set()
        for batch in sliced(batches, "text"):
            sets = Sets(batch.column("text"), size)
            name = sets.names(naming)[0]
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False) & (np.diff(sets.first) > 0)
            once = np.zeros(len(name), bool)
            once[[d for d in np.flatnonzero(known).tolist() if not (int(name[d]) in seen or seen.add(int(name[d])))]] = True
            taken = once[sets.row]
            names.append(name[sets.row[taken]])
            items.append(sets.items[taken])
            if sum(map(len, items)) >= ENTRIES:
                names, items = np.concatenate(names), np.concatenate(items)
                yield names, items
                names, items, seen = [], [], set()
        if items:
            yield np.concatenate(names), np.concatenate(items)

    return run


def _owned(size: int, naming: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows whose text has the set they stand for, with its size and odd sketch."""
        for batch in sliced(batches, "text"):
            sets = Sets(batch.column("text"), size)
            # a repeated id brings other texts along
            own = pa.array(sets.names(naming)[0] == batch.column("set_id").to_numpy(zero_copy_only=False))
            columns = [batch.column("set_id"), batch.column("doc_id"), pa.array(np.diff(sets.first)), pa.array(sets.parities(), pa.binary()), batch.column("text")]
            yield pa.RecordBatch.from_arrays([c.filter(own) for c in columns], ["set_id", "doc_id", "n", "parity", "text"])

    return run


class Trie:
    """Sets in order of their items; a node is a run of items that the sets ``low`` to ``high`` share from its depth on."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.nodes: list[tuple] = []  # low, high, segment, shortest, longest, ended, children
        stack = [(0, len(sets), 0, None)]
        while stack:
            low, high, depth, above = stack.pop()
            a, b = sets[low], sets[high - 1]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:m] != b[depth:m])
            to = depth + int(differ[0]) if len(differ) else m
            children: list[int] = []
            lengths = [len(s) for s in sets[low:high]]
            here = len(self.nodes)
            self.nodes.append((low, high, a[depth:to], min(lengths), max(lengths), len(a) == to, children))
            if above is not None:
                self.nodes[above][6].append(here)
            at = low + (len(a) == to)
            heads = np.array([s[to] for s in sets[at:high]])
            edges = np.flatnonzero(np.diff(heads)) + 1
            for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(heads)], strict=True):
                if y > x:
                    stack.append((at + x, at + y, to, here))

    def links(self, groups: np.ndarray, least: int, walkers: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Pairs of sets that reach ``least`` percent and join two groups; ``groups`` is brought up to date.

        Every set walks over the ones after it; with ``walkers`` only those walk, over all sets.
        """
        out = []
        size = int(max((s[-1] for s in self.sets), default=-1)) + 1
        present = np.zeros(size, bool)
        for i in range(len(self.sets)) if walkers is None else walkers.tolist():
            mine = self.sets[i]
            present[mine] = True
            q, after = len(mine), i + 1 if walkers is None else 0
            stack = [(0, 0, 0)] if self.sets else []
            while stack:
                at, overlap, depth = stack.pop()
                low, high, segment, shortest, longest, ended, children = self.nodes[at]
                if high <= after or (groups[low:high] == groups[i]).all():
                    continue
                if len(segment):
                    overlap += int(np.count_nonzero(present[segment]))
                    depth += len(segment)
                    left = q - int(np.searchsorted(mine, segment[-1], "right"))
                    if (100 + least) * (overlap + longest - depth) < least * (q + longest) or (100 + least) * (overlap + left) < least * (q + shortest):
                        continue
                if ended and low >= after and groups[low] != groups[i] and (100 + least) * overlap >= least * (q + depth):
                    out.append((i, low))
                    groups[groups == groups[low]] = groups[i]
                stack += [(c, overlap, depth) for c in children]
            present[mine] = False
        return out


def _linked(size: int, naming: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        """Links within each (bucket, block) of the slot; rows marked ``walker`` are compared with all, others only through them if there are any."""
        keys = list(zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), strict=True))
        ids, walks, group_of = (table.column(c).to_numpy() for c in ("set_id", "walker", "label"))
        members: dict[tuple, list[int]] = {}
        for i, k in enumerate(keys):
            members.setdefault(k, []).append(i)
        left, right = [], []
        for rows in members.values():
            items, named = [], []
            for batch in sliced(iter(table.select(["text"]).take(rows).combine_chunks().to_batches()), "text"):
                sets = Sets(batch.column("text"), size)
                items += np.split(sets.items, sets.first[1:-1])
                named += sets.names(naming)[0].tolist()
            # a repeated row comes again, and a repeated id brings other texts along: a class takes one row, with its own set
            right_ones = {int(ids[r]): i for i, r in enumerate(rows) if named[i] == ids[r]}
            rows = [rows[i] for i in right_ones.values()]
            items = [items[i] for i in right_ones.values()]
            if not rows:
                continue
            rank = np.unique(np.concatenate(items), return_inverse=True)[1].astype(np.int64)
            ranked = np.split(rank, np.cumsum([len(x) for x in items])[:-1])
            order = sorted(range(len(rows)), key=lambda i: ranked[i].astype(">u4").tobytes())
            own = ids[rows][order]
            walkers = np.flatnonzero(walks[rows][order])
            found = Trie([ranked[i] for i in order]).links(group_of[rows][order].copy(), least, walkers if len(walkers) else None)
            left += [int(own[a]) for a, _ in found]
            right += [int(own[b]) for _, b in found]
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is connected with), by alternating large and small stars until nothing changes."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")


def _compared(owned: DataFrame, work: DataFrame, size: int, naming: int, least: int, slots: int) -> DataFrame:
    """Links among the rows of ``work`` (bucket, block, set_id, rep, walker, label); only texts of sets with candidates move."""
    rows = work.join(owned.select("set_id", "text"), "set_id").select("bucket", "block", "set_id", "walker", "label", "text")
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("bucket", "block"), F.lit(slots)))
    return materialize(rows.groupBy("slot").applyInArrow(_linked(size, naming, least), "a long, b long"), "links")


def _classes(texts: DataFrame, size: int) -> tuple[DataFrame, DataFrame, int]:
    """Documents with the name of their set, the sets with their smallest document, and the naming that tells all sets apart."""
    for naming in range(NAMINGS):
        members = materialize(texts.mapInArrow(_named(size, naming), "doc_id long, n long, set_id long, other long"), "members")
        classes = members.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min("other").alias("x"), F.max("other").alias("y"))
        classes = materialize(classes, "classes")
        if classes.where("x <> y").isEmpty():
            return members, classes.where("rep is not null").select("set_id", "rep", "n"), naming
    raise ValueError("too many different sets for 64-bit names")


def jaccard_groups(docs: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, set_id (class of equal sets), component_id. ``least`` is 50 percent or more: odd sketches of linked sets are then at most a factor of two apart."""
    if not 50 <= least <= 100:
        raise ValueError("least must be from 50 to 100")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members, named, naming = _classes(texts, size)
    entries = _entries(size, naming)
    counted = shared_counts(texts, entries, parts_for(texts, "text", PART_MB))
    enough = named.join(counted, "set_id").where(F.col("shared") * 100 >= F.col("n") * least)
    owned = texts.join(enough.select(F.col("rep").alias("doc_id"), "set_id"), "doc_id")
    owned = materialize(owned.mapInArrow(_owned(size, naming), "set_id long, doc_id long, n long, parity binary, text string"), "owned")
    slots = parts_for(owned, "text", 4)
    classes = owned.groupBy("set_id").agg(F.first("doc_id").alias("rep"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    classes = materialize(classes, "sharing")
    heads = rarest_shared(owned.select("doc_id", "text"), classes, entries, parts_for(owned, "text", PART_MB), least)
    heads = materialize(heads, "heads").select("set_id", F.explode("heads").alias("item"))
    pivots = heads.groupBy("item").agg(F.min("set_id").alias("bucket"), F.max("set_id").alias("y")).where("bucket <> y").select("item", "bucket")
    met = heads.join(pivots, "item").select("set_id", "bucket").distinct()
    rows = _of_like_size(met.join(classes.select("set_id", "rep", "n"), "set_id"), least)
    sizes = rows.groupBy("bucket").agg(F.ceil(F.sum(F.col("n") + SMALL) / BLOCK).cast("int").alias("blocks"))
    placed = materialize(rows.join(sizes, "bucket"), "placed")
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    everywhere = F.when((F.col("set_id") == F.col("bucket")), F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<long>")).otherwise(F.array(block))
    first = placed.select("bucket", F.explode(everywhere).alias("block"), "set_id", "rep", F.lit(False).alias("walker"), F.col("set_id").alias("label"))
    links = _compared(owned, _promising(first, classes, least, slots), size, naming, least, slots)
    roots = components(links)
    cut = placed.where("blocks > 1")
    if not cut.isEmpty():
        links = links.unionByName(_compared(owned, _promising(_across(cut, roots), classes, least, slots), size, naming, least, slots))
        roots = components(links)
    joined = members.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    smallest = joined.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = joined.join(smallest, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "set_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _of_like_size(met: DataFrame, least: int) -> DataFrame:
    """The rows of a bucket that have another row there whose size lets the two be linked; most chance meetings end here.

    Linked sizes differ by at most the threshold, so they stand in the same or in neighbouring powers of it.
    """
    level = F.floor(F.ln("n") / math.log(100 / least)).cast("int")
    rows = met.withColumn("level", level)
    near = rows.select("bucket", F.explode(F.array(*(F.col("level") + k for k in (-1, 0, 1)))).alias("level"))
    enough = near.groupBy("bucket", "level").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return materialize(rows.join(enough, ["bucket", "level"]).drop("level"), "met")


def _paired(least: int):
    def run(table: pa.Table) -> pa.Table:
        """The rows of each (bucket, block) that differ from another group's row by no more sketch bits than a link allows elements.

        Where a block has walkers, only pairs with a walker count.
        """
        kept = np.zeros(table.num_rows, bool)
        sizes, walks, labels = (table.column(c).to_numpy() for c in ("n", "walker", "label"))
        raw = table.column("parity").to_pylist()
        members: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), strict=True)):
            members.setdefault(k, []).append(i)
        for rows in members.values():
            all_walk = not walks[rows].any()
            by_width: dict[int, list[int]] = {}
            for i in sorted(rows, key=lambda i: not walks[i]):
                by_width.setdefault(len(raw[i]), []).append(i)
            for width, own in by_width.items():
                more = by_width.get(2 * width, [])
                both = np.frombuffer(b"".join(raw[i] for i in own), np.uint64).reshape(len(own), -1)
                if more:
                    both = np.concatenate([both, _halved(np.frombuffer(b"".join(raw[i] for i in more), np.uint64).reshape(len(more), -1))])
                others = np.array(own + more)
                wide_walkers = len(own) + int(walks[more].sum())
                for i, one in enumerate(own):
                    span = slice(i + 1, None) if all_walk or walks[one] else slice(len(own), wide_walkers)
                    far = others[span]
                    if not len(far):
                        continue
                    differ = np.bitwise_count(both[span] ^ both[i]).sum(1, dtype=np.int64)
                    near = ((100 + least) * differ <= (100 - least) * (sizes[far] + sizes[one])) & (labels[far] != labels[one])
                    if near.any():
                        kept[one] = True
                        kept[far[near]] = True
        return table.select(["bucket", "block", "set_id", "rep", "walker", "label"]).filter(pa.array(kept))

    return run


def _halved(wide: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(wide.view(np.uint8), axis=1)
    return np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1).view(np.uint64)


def _promising(work: DataFrame, classes: DataFrame, least: int, slots: int) -> DataFrame:
    """The rows of ``work`` (bucket, block, set_id, rep, walker, label) that may have a link in their block, by odd sketches."""
    dealt = work.join(classes.select("set_id", "n", "parity"), "set_id").withColumn("slot", F.pmod(F.xxhash64("bucket", "block"), F.lit(slots)))
    schema = "bucket long, block long, set_id long, rep long, walker boolean, label long"
    return materialize(dealt.groupBy("slot").applyInArrow(_paired(least), schema), "candidates")


def _across(cut: DataFrame, roots: DataFrame) -> DataFrame:
    """What may link between blocks of one bucket: whatever is outside the bucket's largest group against every block."""
    labelled = cut.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("root", "set_id")).drop("root")
    labelled = materialize(labelled, "labelled")
    counts = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = counts.groupBy("bucket").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    outside = labelled.join(largest, "bucket").where("label <> main")
    groups = outside.groupBy("bucket").agg(F.ceil(F.sum(F.col("n") + SMALL) / BLOCK).cast("int").alias("parts"))
    walkers = outside.join(groups, "bucket").select(
        "bucket", "set_id", "rep", "label", F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own")
    )
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    rest = labelled.join(groups, "bucket").select("bucket", "set_id", "rep", "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), own.alias("own"))
    marked = walkers.withColumn("walker", F.lit(True)).unionByName(rest.withColumn("walker", F.lit(False)))
    once = marked.groupBy("bucket", "set_id", "rep", "label", "part", "own").agg(F.max("walker").alias("walker"))
    return once.select("bucket", F.shiftleft(F.col("part").cast("long"), 32).bitwiseOR(F.col("own").cast("long")).alias("block"), "set_id", "rep", "walker", "label")


def drop_near(docs: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """The documents whose id is the smallest of their group, with all their columns; a document without shingles or id stays."""
    gone = jaccard_groups(docs, size, least).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
