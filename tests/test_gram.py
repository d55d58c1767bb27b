"""Pairwise sums from one scan, capped distinct counts, quartiles by group."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clientpulse.operators.gram import Gram, gram_of_columns
from clientpulse.operators.rollup import describe_by
from clientpulse.operators.statistics import capped_distinct, column_types, correlation


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 4)) * [1, 1e-3, 1e3, 1] + [0, 5, 1e8, 0]
    x[:, 3] = np.round(x[:, 0])
    x[rng.random(x.shape) < 0.2] = np.nan
    frame = pd.DataFrame(x, columns=list("abcd")).assign(k=7.0, e=np.nan)
    rows = [tuple(None if math.isnan(v) else v for v in r) for r in frame.itertuples(index=False)]
    return frame, spark.createDataFrame(rows, "a double, b double, c double, d double, k double, e double").repartition(5)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_pairwise_complete_correlations(table, method):
    frame, rows = table
    cols = list("abcdke")
    want = frame.rank().corr() if method == "spearman" else frame.corr()
    for r in correlation(rows, cols, method).collect():
        if math.isnan(want.loc[r.a, r.b]):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(want.loc[r.a, r.b], abs=1e-6)


def test_no_rows_and_one_column(spark, table):
    assert [r["corr"] for r in correlation(table[1].limit(0), ["a", "b"]).collect()] == [None]
    assert correlation(table[1], ["a"]).count() == 0
    assert gram_of_columns(table[1], ["k"]).count[0, 0] == 700


def test_merging_is_like_adding_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) + [0, 1e6, -5]
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:20, 2] = np.nan
    parts = [Gram.of(p) for p in np.split(x, [20, 25])]
    for order in ((0, 1, 2), (2, 0, 1)):
        total = parts[order[0]].plus(parts[order[1]]).plus(parts[order[2]])
        again = Gram.from_bytes(total.to_bytes(), 3)
        assert (again.count == Gram.of(x).count).all()
        assert again.correlations() == pytest.approx(Gram.of(x).correlations(), nan_ok=True, abs=1e-9)


def test_capped_distinct_counts(spark):
    rows = [(i, i % 3, None if i % 2 else "s", None) for i in range(500)]
    frame = spark.createDataFrame(rows, "a int, b int, c string, d string").repartition(7)
    got = {r.feature: r.n_distinct for r in capped_distinct(frame, list("abcd"), 4).collect()}
    assert got == {"a": 4, "b": 3, "c": 1, "d": 0}
    kinds = {r.feature: r.kind for r in column_types(frame, [], exact=False).collect()}
    assert kinds == {r.feature: r.kind for r in column_types(frame, []).collect()}
    assert {r.n_distinct for r in capped_distinct(frame.limit(0), ["a"], 4).collect()} == {0}


def test_quartiles_of_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else None, float(rng.randrange(40)), None if i % 5 else float(i)) for i in range(900)]
    got = {r.g: r for r in describe_by(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], ["x", "y"]).collect()}
    frame = pd.DataFrame(rows, columns=["g", "x", "y"])
    for g, part in ((g, frame[frame.g.isna()] if g is None else frame[frame.g == g]) for g in ("hot", None)):
        for c in ("x", "y"):
            want = part[c].describe()
            row = got[g]
            assert [row[f"{c}_{n}"] for n in ("count", "mean", "std", "min", "q1", "q2", "q3", "max")] == pytest.approx(list(want))
