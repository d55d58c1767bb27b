"""What sets learn about shingles that others have too, against plain counting; and the join with small slices and clashing names."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow.compute as pc
import pytest
from brute import brute_groups, texts_of

from clientpulse.llm import jaccard_join, shared_shingles

LEAST = 80


@pytest.fixture(scope="module")
def held():
    """Numbers of each set: one in all sets, some in a few, some in one."""
    rng = random.Random(11)
    return {s: {1, *(rng.randrange(2, 400) for _ in range(rng.randrange(1, 40))), 10_000 + s} for s in range(-30, 50)}


def slices():
    def run(batches):
        for batch in batches:
            rows = [(s, v) for s, values in zip(batch.column("set_id").to_pylist(), batch.column("held").to_pylist(), strict=True) for v in values]
            for low in range(0, len(rows), 300):
                part = rows[low : low + 300]
                yield np.array([s for s, _ in part], np.int64), np.array([v for _, v in part], np.uint64)

    return run


@pytest.mark.parametrize("common", [2, shared_shingles.COMMON])
def test_sets_learn_what_others_have(spark, held, monkeypatch, common):
    monkeypatch.setattr(shared_shingles, "COMMON", common)
    rows = spark.createDataFrame([(s, sorted(v)) for s, v in held.items()], "set_id long, held array<long>").repartition(3)
    many = Counter(v for values in held.values() for v in values)
    shared = {s: {v for v in values if many[v] > 1} for s, values in held.items()}
    got = {r["set_id"]: r["shared"] for r in shared_shingles.shared_counts(rows, slices(), 5).collect()}
    assert got == {s: len(v) for s, v in shared.items()}
    sizes = spark.createDataFrame([(s, len(v)) for s, v in held.items()], "set_id long, n long")
    heads = {r["set_id"]: r["heads"] for r in shared_shingles.rarest_shared(rows, sizes, slices(), 5, LEAST).collect()}
    for s, values in held.items():
        first = len(shared[s]) - math.ceil(LEAST * len(values) / 100) + 1
        order = sorted(shared[s], key=lambda v: (min(many[v], common + 1), v))
        assert heads.get(s, []) == order[: max(first, 0)]


def test_join_in_small_slices_and_with_names_dealt_anew(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"v{rng.randrange(900)}" for _ in range(60)]
    rows = []
    for i in range(60):
        text = list(base) if i % 2 else [f"u{rng.randrange(40)}" for _ in range(rng.randrange(1, 30))]
        for _ in range(rng.randrange(0, 3)):
            text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = jaccard_join._named

    def clashing(size, naming):
        named = plain(size, naming)

        def run(batches):
            for batch in named(batches):
                at = batch.schema.get_field_index("set_id")
                yield batch if naming else batch.set_column(at, "set_id", pc.bit_wise_and(batch.column(at), 15))

        return run

    monkeypatch.setattr(jaccard_join, "ENTRIES", 100)
    monkeypatch.setattr(jaccard_join, "_named", clashing)
    assert jaccard_join._classes(docs, 4)[2] == 1
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(docs).collect()}
    assert got == brute_groups(texts_of(docs), 4, 85)


def test_a_part_holds_little_beside_its_elements():
    """What a part takes while it counts, over what it was sent."""
    rng = np.random.default_rng(5)
    sets, keys = rng.integers(0, 1 << 40, 4000), [rng.integers(0, 1 << 32, 200, dtype=np.uint32) for _ in range(4000)]
    rows = [(0, s.tobytes(), np.array([len(k)], "<u4").tobytes(), k.tobytes(), None) for s, k in zip(sets, keys, strict=True)]
    table = shared_shingles.pa.Table.from_batches([shared_shingles._table(shared_shingles._ASKED, rows)])
    tracemalloc.start()
    told = shared_shingles._told_counts(3)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {}
    for ids, n in zip(told.column("sets").to_pylist(), told.column("sure").to_pylist(), strict=True):
        got |= dict(zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(n, "<u4").tolist(), strict=True))
    many = Counter(np.concatenate(keys).tolist())
    want = {int(s): sum(many[v] > 1 for v in k.tolist()) for s, k in zip(sets, keys, strict=True)}
    assert got == {s: n for s, n in want.items() if n}
    assert peak < 30 * 800_000
