import math
import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from clientpulse.prep import CategoryImputer, NumericImputer, OutlierCapper, Scaler, SignedLog, WoeEncoder, impute
from clientpulse.prep import woe as W
from clientpulse.prep.woe import merge_similar, rare_levels


def test_all_equal_column(spark):
    frame = spark.createDataFrame([(5.0,)] * 10, "x double")
    capped = OutlierCapper(inputCols=["x"]).fit(frame).transform(frame)
    scaled = Scaler(inputCols=["x"], kind="robust").fit(frame).transform(frame)
    assert {r.x for r in capped.collect()} == {5.0}
    assert {r.x for r in scaled.collect()} == {0.0}


def test_capping_needs_both_tests(spark):
    values = [float(v) for v in range(100)] + [1000.0]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    model = OutlierCapper(inputCols=["x"]).fit(frame)
    fitted = model.values["x"]
    assert not fitted["symmetric"]
    assert fitted["spread"] == pytest.approx(25.0 / 0.6744897501960817)
    assert model.transform(frame).agg(F.max("x")).first()[0] == pytest.approx(fitted["upper"])


def test_all_null_category_stays_null(spark):
    frame = spark.createDataFrame([(None, "a"), (None, None)], "c string, d string")
    out = CategoryImputer(inputCols=["c", "d"]).fit(frame).transform(frame).collect()
    assert [r.c for r in out] == [None, None]
    assert [(r.d, r.d_null) for r in out] == [("a", 0), ("a", 1)]


def test_fixed_values_have_no_flag(spark):
    frame = spark.createDataFrame([(None, 1.0), (2.0, None)], "x double, y double")
    out = NumericImputer(inputCols=["x", "y"], fixed={"y": -1.0}).fit(frame).transform(frame)
    assert "y_null" not in out.columns and "x_null" in out.columns
    assert [(r.x, r.y) for r in out.orderBy("y").collect()] == [(2.0, -1.0), (2.0, 1.0)]


@pytest.mark.parametrize("strategy", ["mean", "median", "random"])
def test_column_without_values(spark, strategy):
    frame = spark.createDataFrame([(1, None, 2.0), (2, None, None)], "id int, x double, y double")
    model = NumericImputer(inputCols=["x", "y"], strategy=strategy, keyCols=["id"]).fit(frame)
    assert [(r.x, r.x_null, r.y) for r in model.transform(frame).orderBy("id").collect()] == [(0.0, 1, 2.0), (0.0, 1, 2.0)]
    assert NumericImputer(inputCols=["x"], strategy=strategy, keyCols=["id"]).fit(frame.limit(0)).values["x"]["value"] == 0.0


def test_random_imputation_is_stable_and_inside_the_range(spark):
    rng = random.Random(1)
    rows = [(i, None if i % 3 == 0 else round(rng.gauss(0, 1), 3)) for i in range(600)]
    frame = spark.createDataFrame(rows, "id int, x double")
    model = NumericImputer(inputCols=["x"], strategy="random", keyCols=["id"]).fit(frame)
    first, again = ({r.id: r.x for r in model.transform(frame.repartition(n)).collect()} for n in (2, 6))
    assert first == again and len(first) == 600
    known = [x for _, x in rows if x is not None]
    assert all(min(known) <= v <= max(known) for v in first.values())
    drawn = [first[i] for i, x in rows if x is None]
    assert abs(sum(drawn) / len(drawn)) < 0.3


def greedy(counts, share):
    total = sum(counts.values())
    rare = sorted((c for c in counts.items() if c[1] / total < share), key=lambda c: (-c[1], c[0]))
    slot, acc, out = 0, 0, {}
    for level, n in rare:
        out[level] = slot
        acc += n
        if acc / total >= share:
            slot, acc = slot + 1, 0
    return out


def test_rare_levels_follow_the_greedy_rule(spark):
    rng = random.Random(5)
    counts = {f"v{i:03d}": rng.randint(1, 40) for i in range(60)} | {"big": 900}
    levels = spark.createDataFrame([("f", v, n, n // 2) for v, n in counts.items()], "feature string, value string, n long, bad long")
    got = rare_levels(levels, 0.05).collect()
    assert {r.value: r.slot for r in got if r.slot is not None} == greedy(counts, 0.05)
    assert [r.value for r in got if r.slot is None] == ["big"]


def test_similarity_anchors_on_the_first_member():
    assert merge_similar({"a": 0.0, "b": 0.08, "c": 0.16, "d": 0.5}, 0.1) == [["a", "b"], ["c"], ["d"]]


def test_woe_of_unseen_levels_and_outside_values_is_zero(spark):
    rows = [("a", 1.0, 1), ("a", 2.0, 0), ("a", 3.0, 0), ("b", 4.0, 1), ("b", 5.0, 1), ("b", 6.0, 0)]
    frame = spark.createDataFrame(rows, "c string, x double, target int")
    model = WoeEncoder(numericCols=["x"], categoricalCols=["c"], bins=2, similarity=0.0).fit(frame)
    new = spark.createDataFrame([("z", 99.0, 0), ("a", 1.0, 0)], "c string, x double, target int")
    got = [(r.c, r.x) for r in model.transform(new).collect()]
    assert (0.0, 0.0) in got
    want = W.woe(2, 1, 3, 3)
    assert any(c == pytest.approx(want) and x == pytest.approx(want) for c, x in got)
    assert set(model.information_values()) == {"c", "x"}


def test_many_levels_are_kept_in_a_table(spark):
    rows = [(f"l{i % 40}", i % 3 % 2) for i in range(400)]
    frame = spark.createDataFrame(rows, "c string, target int")
    stored = WoeEncoder(categoricalCols=["c"]).fit(frame)
    assert stored.mapping.count() == 40 and "levels" not in stored.values
    coded = {r.c: r.woe for r in stored.transform(frame.withColumn("was", F.col("c"))).select(F.col("was").alias("c"), F.col("c").alias("woe")).collect()}
    assert coded == {r.value: r.woe for r in stored.mapping.collect()}


def test_pipeline_survives_saving(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), None if i % 9 == 0 else math.exp(rng.gauss(0, 2)), i % 2) for i in range(200)]
    frame = spark.createDataFrame(rows, "c string, x double, target int")
    stages = [
        OutlierCapper(inputCols=["x"]),
        NumericImputer(inputCols=["x"], strategy="median"),
        WoeEncoder(categoricalCols=["c"]),
        SignedLog(inputCols=["x"]),
        Scaler(inputCols=["x"], kind="standard"),
    ]
    model = Pipeline(stages=stages).fit(frame)
    model.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    a, b = (sorted(map(tuple, m.transform(frame).collect())) for m in (model, again))
    assert a == b
    mean = model.transform(frame).agg(F.avg("x")).first()[0]
    assert mean == pytest.approx(0.0, abs=1e-9)


def test_random_fills_do_not_depend_on_how_points_are_found(spark, monkeypatch):
    rows = [(None if i % 50 == 0 else i % 90, 1.0 * (i % 7) if i % 3 else None, i / 8 if i % 4 == 0 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    imputer = NumericImputer(inputCols=["a", "b"], strategy="random", keyCols=["k"])
    found = {}
    for bound in (0, 50, 4096):  # both columns sorted, one of them, none
        monkeypatch.setattr(impute, "POINTS_IN_PLAN", bound)
        filled = imputer.fit(df).transform(df)
        found[bound] = sorted(filled.collect(), key=str)
        assert ("Join" in filled._jdf.queryExecution().optimizedPlan().toString()) == (bound < 4096)
    assert found[0] == found[50] == found[4096]
    assert all(r["a"] is not None and r["b"] is not None for r in found[0])
