"""The Pitman-Yor model of words in context."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientpulse.llm import language_model as L


@pytest.fixture(scope="module")
def chain(spark):
    """Texts in which the next word follows from the last one, most of the time."""
    rng, rows = random.Random(3), []
    names = [f"w{i}" for i in range(30)]
    for d in range(120):
        word, text = rng.choice(names), []
        for _ in range(rng.randrange(0, 60)):
            word = names[(names.index(word) * 7 + 3) % 30] if rng.random() < 0.8 else rng.choice(names)
            text.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((d, " ".join(text)))
    rows += [(200, "new " * 5), (201, ""), (202, None), (None, "w1 w2"), (7, "w3")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def scored(docs):
    return {(r["doc_id"], r["n_tokens"]): r for r in L.score_documents(docs, F.col("doc_id") % 5 == 0).collect()}


def test_outcomes_sum_to_one_in_every_context(spark, chain, monkeypatch):
    for hot in (L.HOT, 40, 1):  # all words are frequent, some are, none is
        monkeypatch.setattr(L, "HOT", hot)
        rows, frequent = L.seat_documents(chain, F.col("doc_id") % 5 == 0)
        assert len(frequent) <= hot and (len(frequent) > 0) == (hot > 1)
        cells = rows.filter("part >= 0").select("cells")
        model = L.sample_model(cells, frequent)
        assert len(model.totals) == L.SWEEPS and model.tokens > 0
        root, known = {}, {}
        for r in cells.collect():
            part = L.Part.of(bytes(r["cells"]))
            p, counts = L.probabilities(part, model)
            states = list(part.seatings(model, L.SWEEPS))
            for w in np.flatnonzero(counts > 0):
                root[int(part.hashes[w])] = [
                    float(model.root(part._whole(g, model.totals[s].hot_guests), part._whole(t, model.totals[s].hot_tables), s)[w])
                    for s, (_, g, t) in enumerate(states)
                ]
            for i, w in enumerate(part.word):
                if counts[w] > 0:
                    known[int(part.hashes[w]), int(part.contexts[i])] = float(p[i])
        assert len(root) == model.distinct
        kept = range(L.BURN, L.SWEEPS)
        contexts = [u for u in range(L.CONTEXTS) if model.customers[u] > 0]
        assert len(contexts) > 25
        for u in [*contexts, next(u for u in range(L.CONTEXTS) if model.customers[u] == 0)]:
            spread = {s: (L.STRENGTH + model.discount * model.totals[s].tables[u]) / (L.STRENGTH + model.customers[u]) for s in kept}
            alone = lambda p: np.mean([spread[s] * p[s] for s in kept])
            total = sum(known.get((w, u), alone(p)) for w, p in root.items())
            total += alone([float(model.root(np.zeros(1), np.zeros(1), s)[0]) for s in range(L.SWEEPS)])
            assert abs(total - 1) < 1e-9


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, chain):
    one = scored(chain)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        two = scored(chain.repartition(5).orderBy(F.rand(1)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(one) == 125 and set(one) == set(two)
    for key, row in one.items():
        assert row["score"] == pytest.approx(two[key]["score"], abs=1e-9) and row["base_score"] == pytest.approx(two[key]["base_score"], abs=1e-9)


def test_order_and_context_matter(spark, chain):
    rng = random.Random(8)
    held = chain.filter("doc_id % 5 = 0 and doc_id < 120").collect()
    mixed = []
    for r in held:
        w = (r["text"] or "").split()
        rng.shuffle(w)
        mixed.append((r["doc_id"] + 1000, " ".join(w)))
    both = chain.unionByName(spark.createDataFrame(mixed, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in L.score_documents(both, (F.col("doc_id") % 5 == 0) | (F.col("doc_id") >= 1000)).collect()}
    own = [r["doc_id"] for r in held]
    right, wrong = (sum(got[d + k]["score"] for d in own) for k in (0, 1000))
    base = sum(got[d]["base_score"] for d in own)
    assert right > 0.75 * wrong and right > 0.75 * base  # scores are negative: a quarter better at least
    assert sum(got[d + 1000]["base_score"] for d in own) == pytest.approx(base)
    assert got[200]["held_out"] and got[200]["n_known"] == 1


def test_seating_follows_the_law():
    rng = np.random.default_rng(1)

    def one_by_one(n, discount, strength, base):
        tables = 1
        for i in range(1, n):
            new = (strength + discount * tables) * base
            tables += rng.random() * (i - discount * tables + new) < new
        return tables

    for n, base in ((40, 0.5), (300, 0.3)):
        want = [one_by_one(n, 0.5, 1.0, base) for _ in range(3000)]
        seeds = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
        got = L.seated(np.full(3000, n), 0.5, 1.0, np.zeros(3000), np.full(3000, base), seeds, 2)
        assert abs(np.mean(want) - got.mean()) < 5 * np.std(want) / math.sqrt(1500) and abs(np.std(want) / got.std() - 1) < 0.15
    few = L.seated(np.array([0, 1, 2, 100_000]), 0.5, 1.0, np.zeros(4), np.full(4, 0.5), np.arange(4).astype(np.uint64), 1)
    assert few[0] == 0 and few[1] == 1 and 1 <= few[2] <= 2 and 2 < few[3] < 5000
