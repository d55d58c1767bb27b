"""Skew-safe ordered operators against brute force, with one group holding a third of all rows."""

import bisect
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clientpulse.operators.ordered import exact_quantiles, in_ranges, next_point, previous_row, ranked, running_totals


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(3000):
        group = 1 if i % 3 == 0 else None if i % 50 == 1 else rng.randint(2, 200)
        out.append((group, i, rng.randint(0, 5)))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, at int, x long").repartition(5)


def groups(rows):
    found = defaultdict(list)
    for g, at, x in sorted(rows, key=lambda r: r[1]):
        found[g].append((at, x))
    return found


def test_hot_group_is_spread(frame):
    ranged = in_ranges(frame, ["g"], ["at"])
    assert ranged.filter("g = 1").select("__range").distinct().count() >= 3


def test_running_totals(frame, rows):
    got = {r.at: (r.x_run, r.x_all) for r in running_totals(frame, ["g"], ["at"], ["x"]).collect()}
    assert len(got) == len(rows)
    for members in groups(rows).values():
        total, run = sum(x for _, x in members), 0
        for at, x in members:
            run += x
            assert got[at] == (run, total)


def test_running_totals_without_groups(frame, rows):
    got = {r.at: r.x_run for r in running_totals(frame, [], ["at"], ["x"]).collect()}
    run = 0
    for _, at, x in sorted(rows, key=lambda r: r[1]):
        run += x
        assert got[at] == run


def test_previous_row_keeps_null_values(spark):
    frame = spark.createDataFrame([(1, i, None if i % 4 == 0 else i) for i in range(400)], "g int, at int, v int")
    got = {r.at: r.previous for r in previous_row(frame, ["g"], ["at"], ["at", "v"]).collect()}
    assert got[0] is None
    for i in range(1, 400):
        assert (got[i].at, got[i].v) == (i - 1, None if (i - 1) % 4 == 0 else i - 1)


def test_ranked(frame, rows):
    got = {r.at: r["rank"] for r in ranked(frame, ["g"], ["at"]).collect()}
    for members in groups(rows).values():
        assert [got[at] for at, _ in members] == list(range(1, len(members) + 1))


def test_exact_quantiles(frame):
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    value = frame.withColumn("v", (F.col("at") * 37 % 101).cast("double"))
    got = exact_quantiles(value, ["g"], "v", probs)
    want = value.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(f"w_{n}") for n, p in probs.items()])
    off = " or ".join(f"abs({n} - w_{n}) > 1e-9" for n in probs)
    joined = got.join(want, got.g.eqNullSafe(want.g))
    assert joined.count() == want.count()
    assert joined.filter(off).count() == 0


def test_next_point(spark):
    rng = random.Random(3)
    points = sorted(rng.random() for _ in range(100)) + [1.0]
    asked = [rng.random() for _ in range(500)] + points[:5]
    left = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "id int, at double")
    right = spark.createDataFrame([(p, float(i)) for i, p in enumerate(points)], "at double, v double")
    got = {r.id: r.point.v for r in next_point(left, right, "at", ["v"]).collect()}
    for i, a in enumerate(asked):
        assert got[i] == bisect.bisect_left(points, a)
