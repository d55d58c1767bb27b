"""Which elements of sets occur in other sets too, told back to the sets in packed arrays.

An element of one set alone never adds to an overlap. Tasks send the elements of a slice of sets to hash parts; a part counts in how many sets
each element is and answers the sets. ``shared_counts`` answers with numbers only, for which 32 bits of an element within its part are enough:
parts follow the size of the data, so chance agreement stays as rare at every size, and it only makes a number too large.
``rarest_shared`` answers with the elements and how common they are, from which each set takes its first ones in an order that is the same for all sets.

An element that several sets of a slice hold is sent once for the slice, so that a part gets at most one entry (``rarest_shared``: ``COMMON``
entries) per slice of any element, however common.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.texts import byte_column, mixed

COMMON = 16  # an element in more sets than this counts as common, the last level of the order
STEPS = 8  # steps of equal width in which a part goes through its elements, to hold less beside them
PART_MB = 16  # million characters of text whose elements meet in one part
_NOBODY = -1 << 63  # stands for sets of a slice that were told by the slice itself
_ASKED = "part long, sets binary, counts binary, items binary, sure binary"
_TOLD = "part long, sets binary, counts binary, items binary, levels binary"

Slices = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]
"""Turns batches into (set of each entry, element of each entry), a slice at a time; a set comes once in a slice."""


def _table(fields: str, rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in fields.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    kinds = [pa.int64() if f.endswith("long") else pa.binary() for f in fields.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins, and the end."""
    if not len(keys[0]):
        return np.zeros(1, np.int64)
    fresh = np.ones(len(keys[0]) + 1, bool)
    fresh[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(fresh)


def _packed(to: np.ndarray, sets: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """One row per destination: its sets, how many values each has, and the values in that order."""
    order = np.lexsort((sets, to))
    to, sets, values = to[order], sets[order], [v[order] for v in values]
    edges = _runs(to)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        at = _runs(sets[low:high])
        yield int(to[low]), sets[low:high][at[:-1]].astype("<i8").tobytes(), np.diff(at).astype("<u4").tobytes(), *(v[low:high].tobytes() for v in values)


def _flat(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    sets, counts, items = (byte_column(table.column(c))[0].view(k) for c, k in (("sets", "<i8"), ("counts", "<u4"), ("items", kind)))
    return np.repeat(sets, counts), items


def _dealt(items: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(items, 21) % np.uint64(parts)).astype(np.int64)


def _holders(part: np.ndarray, keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the entries by element and set, the number of the element, and in how many sets that element is."""
    order = np.lexsort((sets, keys, part))
    p, k, s = part[order], keys[order], sets[order]
    edges = _runs(p, k)
    element = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (element[1:] != element[:-1]) | (s[1:] != s[:-1])
    return order, element, np.bincount(element[fresh], minlength=len(edges) - 1)[element]


def _asked_counts(slices: Slices, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, items in slices(batches):
            part, keys = _dealt(items, parts), mixed(items, 22).astype(np.uint32)
            del items
            order, element, holders = _holders(part, keys, sets)
            part, keys, sets = part[order], keys[order], sets[order]
            first = np.ones(len(element), bool)
            first[1:] = element[1:] != element[:-1]
            known = holders > 1
            del order, element, holders
            own, sure = np.unique(sets[known], return_counts=True)
            once = ~known | first
            sender = np.where(known, _NOBODY, sets)[once]
            rows = [(*r, None) for r in _packed(part[once], sender, keys[once].astype("<u4"))]
            # what the slice knows itself travels along, without elements
            rows += [(to, ids, bytes(len(counts)), b"", n) for to, ids, counts, n in _packed(np.mod(own, parts), own, sure.astype("<u4"))]
            yield _table(_ASKED, rows)

    return run


def _in_steps(sets: np.ndarray, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The entries by the first digits of their elements, which are spread evenly; equal elements come together."""
    width = np.iinfo(items.dtype).bits - (STEPS - 1).bit_length()
    step = (items >> items.dtype.type(width)).astype(np.uint8)
    for k in range(STEPS):
        own = np.flatnonzero(step == k)
        if len(own):
            yield sets[own], items[own]


def _shared(sets: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The set of every entry whose element another set has too."""
    order, _, holders = _holders(np.zeros(len(keys), np.uint8), keys, sets)
    sets, keys = sets[order], keys[order]
    from_slice = sets == _NOBODY
    # an element that a slice sent for several of its sets is shared, whoever else holds it
    edges = _runs(keys)
    any_slice = np.repeat(np.logical_or.reduceat(from_slice, edges[:-1]), np.diff(edges))
    return sets[((holders > 1) | any_slice) & ~from_slice]


def _told_counts(parts: int):
    def run(table: pa.Table) -> pa.Table:
        found = [_shared(*step) for step in _in_steps(*_flat(table, "<u4"))]
        # equal keys of one set are its rows in several slices, or agree by chance: all count, as the number may only be too large
        own, found = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
        rows = [(to, ids, b"", b"", n) for to, ids, _, n in _packed(np.mod(own, parts), own, found.astype("<u4"))]
        # what slices know themselves is passed on
        known = [(s, n) for s, n in zip(table.column("sets").to_pylist(), table.column("sure").to_pylist(), strict=True) if n is not None]
        if known:
            rows.append((table.column("part")[0].as_py(), b"".join(s for s, _ in known), b"", b"", b"".join(n for _, n in known)))
        return pa.Table.from_batches([_table(_ASKED, rows)])

    return run


def _added(table: pa.Table) -> pa.Table:
    sets, found = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("sets", "<i8"), ("sure", "<u4")))
    own, at = np.unique(sets, return_inverse=True)
    return pa.table({"set_id": own, "shared": np.bincount(at, found, len(own)).astype(np.int64)})


def shared_counts(rows: DataFrame, slices: Slices, parts: int) -> DataFrame:
    """set_id, shared: at least the number of its elements that other sets have; sets without any are left out."""
    asked = rows.mapInArrow(_asked_counts(slices, parts), _ASKED)
    told = asked.groupBy("part").applyInArrow(_told_counts(parts), _ASKED)
    return told.groupBy("part").applyInArrow(_added, "set_id long, shared long")


def _asked_items(slices: Slices, parts: int, told: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, items in slices(batches):
            order, element, holders = _holders(np.zeros(len(items), np.int64), items, sets)
            sets, items = sets[order], items[order]
            common = holders > COMMON
            if told:
                sets, items = sets[common], items[common]
                yield _table(_TOLD, list(_packed(np.mod(sets, parts), sets, items.astype("<u8"), np.full(len(sets), COMMON + 1, np.uint8))))
                continue
            first = np.ones(len(element), bool)
            first[1:] = element[1:] != element[:-1]
            once = ~common | first
            sender = np.where(common, _NOBODY, sets)[once]
            yield _table(_ASKED, [(*r, None) for r in _packed(_dealt(items[once], parts), sender, items[once].astype("<u8"))])

    return run


def _levels(most: int, sets: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set, element and level of the entries whose element another set has too."""
    order, _, holders = _holders(np.zeros(len(items), np.uint8), items, sets)
    sets, items = sets[order], items[order]
    edges = _runs(items)
    common = np.repeat(np.logical_or.reduceat(sets == _NOBODY, edges[:-1]), np.diff(edges))
    level = np.where(common, most + 1, np.minimum(holders, most + 1)).astype(np.uint8)
    stay = (level > 1) & (sets != _NOBODY)
    return sets[stay], items[stay], level[stay]


def _told_items(parts: int):
    def run(table: pa.Table) -> pa.Table:
        found = [_levels(COMMON, *step) for step in _in_steps(*_flat(table, "<u8"))]
        if not found:
            return pa.Table.from_batches([_table(_TOLD, [])])
        sets, items, level = (np.concatenate(c) for c in zip(*found, strict=True))
        del found
        return pa.Table.from_batches([_table(_TOLD, list(_packed(np.mod(sets, parts), sets, items.astype("<u8"), level)))])

    return run


def _first_ones(least: int):
    def run(table: pa.Table) -> pa.Table:
        sets, items = _flat(table, "<u8")
        level = np.frombuffer(b"".join(table.column("levels").to_pylist()), np.uint8)
        need = dict(zip(*(np.frombuffer(b"".join(x for x in table.column(c).to_pylist() if x), "<i8").tolist() for c in ("wanted", "sizes")), strict=True))
        order = np.lexsort((items, level, sets))
        sets, items, level = sets[order], items[order], level[order]
        fresh = np.ones(len(sets), bool)
        fresh[1:] = (sets[1:] != sets[:-1]) | (items[1:] != items[:-1])
        sets, items = sets[fresh], items[fresh].astype(np.int64)
        edges = _runs(sets)
        own, heads = [], []
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n = need[int(sets[low])]
            first = high - low + (-least * n // 100) + 1  # fewer elements than a link needs give none
            if first > 0:
                own.append(int(sets[low]))
                heads.append(items[low : low + first])
        at = np.cumsum([0, *map(len, heads)]).astype(np.int32)
        flat = np.concatenate(heads) if heads else np.empty(0, np.int64)
        return pa.table({"set_id": pa.array(own, pa.int64()), "heads": pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int64()))})

    return run


def rarest_shared(rows: DataFrame, sizes: DataFrame, slices: Slices, parts: int, least: int) -> DataFrame:
    """set_id, heads: of a set's elements that other sets have, the rarest that a linked set cannot all lack.

    ``sizes`` has set_id and n of every set. With s such elements of n, of which a link of ``least`` percent needs c = ceil(n least / 100),
    these are the first s - c + 1; two sets that overlap in c elements of each have one of them in common. Sets with s < c are left out.
    """
    asked = rows.mapInArrow(_asked_items(slices, parts, False), _ASKED)
    told = asked.groupBy("part").applyInArrow(_told_items(parts), _TOLD)
    told = told.unionByName(rows.mapInArrow(_asked_items(slices, parts, True), _TOLD))
    nothing = F.lit(None).cast("binary")
    told = told.withColumns({"wanted": nothing, "sizes": nothing})
    by_part = sizes.select(F.pmod("set_id", F.lit(parts)).alias("part"), "set_id", "n")
    wanted = by_part.mapInArrow(_sizes, "part long, wanted binary, sizes binary")
    wanted = wanted.withColumns({c: F.lit(b"") for c in ("sets", "counts", "items", "levels")}).select(told.columns)
    return told.unionByName(wanted).groupBy("part").applyInArrow(_first_ones(least), "set_id long, heads array<long>")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part, own, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "set_id", "n"))
        order = np.argsort(part, kind="stable")
        edges = _runs(part[order])
        spans = [order[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        rows = [(int(part[x[0]]), own[x].astype("<i8").tobytes(), n[x].astype("<i8").tobytes()) for x in spans]
        yield _table("part long, wanted binary, sizes binary", rows)
