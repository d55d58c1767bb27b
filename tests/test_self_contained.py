"""Saved models that need nothing but their folder, per-product preparation, early stopping."""

import math
import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from clientpulse.plans import boosting as BO
from clientpulse.plans import models as ML
from clientpulse.prep import NumericImputer, WoeEncoder
from clientpulse.session import materialize, releasing, scratch_path


@pytest.fixture(scope="module")
def many_levels(spark):
    rng = random.Random(3)
    rows = [
        (i, f"l{i % 5000}", None if i % 7 == 0 else round(rng.gauss(0, 1), 4), None if i % 11 == 0 else float(i % 13), int(rng.random() < 0.4))
        for i in range(15_000)
    ]
    return spark.createDataFrame(rows, "id int, c string, x double, y double, target int")


def test_model_is_whole_without_scratch(spark, many_levels, tmp_path):
    path = str(tmp_path / "model")
    with releasing(spark):
        stages = [NumericImputer(inputCols=["x", "y"], strategy="random", keyCols=["id"]), WoeEncoder(categoricalCols=["c"], minShare=0.0001)]
        model = Pipeline(stages=stages).fit(many_levels)
        want = sorted(map(tuple, model.transform(many_levels).collect()))
        model.write().save(path)
        assert model.stages[1].mapping.count() == 5000
    again = PipelineModel.load(path)
    assert sorted(map(tuple, again.transform(many_levels).collect())) == want
    again.write().save(str(tmp_path / "copy"))
    third = PipelineModel.load(str(tmp_path / "copy"))
    assert sorted(map(tuple, third.transform(many_levels).collect())) == want
    assert all(None not in row for row in want)


def test_scratch_is_released(spark):
    with releasing(spark):
        table = materialize(spark.range(5), "kept")
        path = scratch_path(spark, "named")
        spark.range(3).write.parquet(path)
        assert table.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_draws_of_two_columns_are_their_own(spark):
    frame = spark.createDataFrame([(i, float(i), 100.0 + i) if i < 50 else (i, None, None) for i in range(100)], "id int, a double, b double")
    model = NumericImputer(inputCols=["a", "b"], strategy="random", keyCols=["id"], addFlags=False).fit(frame)
    drawn = model.transform(frame).filter("id >= 50").collect()
    assert len(drawn) == 50 and all(0 <= r.a <= 49 and 100 <= r.b <= 149 for r in drawn)
    assert len({round(r.a - (r.b - 100), 6) for r in drawn}) > 40
    twice = frame.unionByName(frame)
    assert model.transform(twice).count() == 200


@pytest.mark.parametrize("product", [1, 3, 4])
def test_product_settings(spark, product):
    rng = random.Random(product)
    rows = [
        (i, None if i % 5 == 0 else rng.gauss(0, 1), None if i % 6 == 0 else 3.0, None if i % 9 == 0 else i % 2, None if i % 4 == 0 else i % 2, rng.choice("ab"), i % 2)
        for i in range(400)
    ]
    names = "id int, x double, trans_type_currency_cnt_m double, pur_any_purchase int, trx_growth_streak_3m int, c string, target int"
    frame = spark.createDataFrame(rows, names)
    categories = ["pur_any_purchase", "trx_growth_streak_3m", "c"]
    stages = ML.product_preprocessing(product, ["id"], ["x", "trans_type_currency_cnt_m"], categories, "target")
    how = {s.__class__.__name__: s for s in stages}
    fills = ML.PREPARATIONS[product].category_fills
    assert how["CategoryImputer"].getOrDefault("fixed") == dict(fills)
    assert set(how["WoeEncoder"].getOrDefault("categoricalCols")) == set(categories) - set(fills)
    assert how["NumericImputer"].getOrDefault("strategy") == "random" and how["Scaler"].getOrDefault("kind") == "standard"
    if product != 3:
        return
    model = Pipeline(stages=stages).fit(frame)
    seen = ML.feature_names(model)
    assert "x_null" in seen and "trans_type_currency_cnt_m_null" not in seen
    assert ("trx_growth_streak_3m_null" in seen) == ("trx_growth_streak_3m" not in fills)
    out = model.transform(frame)
    assert out.filter("x is null or trans_type_currency_cnt_m is null").isEmpty()
    assert abs(out.agg(F.avg("x")).first()[0]) < 1e-9
    assert len(out.first().features) == len(seen)


@pytest.mark.parametrize(
    "losses, patience, want",
    [
        ([3.0, 2.0, 1.0], 2, (3, False)),
        ([3.0, 1.0, 2.0, 2.0, 0.5], 2, (2, True)),
        ([3.0, 1.0, 2.0, 0.5, 0.6], 2, (4, False)),
        ([1.0], 1, (1, False)),
        ([1.0, 1.0], 1, (1, True)),
    ],
)
def test_best_round(losses, patience, want):
    assert BO.best_round(losses, patience) == want


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(9)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1), i % 3) for i in range(900)]
    rows = [(a, b, int(a + rng.gauss(0, 1.5) > 0), part) for a, b, part in rows]
    frame = spark.createDataFrame(rows, "a double, b double, target int, part int")
    frame = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(frame).withColumn("weight", F.lit(1.0))
    return materialize(frame.filter("part < 2"), "fit"), materialize(frame.filter("part = 2"), "valid")


def test_boosting_stops_at_its_best_round(spark, noisy, tmp_path):
    train, valid = noisy
    booster = GBTClassifier(featuresCol="features", labelCol="target", weightCol="weight", maxIter=60, maxDepth=4, stepSize=0.4, seed=1)
    model, losses = BO.fit_with_patience(booster, train, valid, patience=6)
    whole = booster.copy({booster.maxIter: len(losses)}).fit(train)
    best, stopped = BO.best_round(BO.validation_losses(whole, valid), 6)
    assert model.getNumTrees == best < len(losses) and stopped
    margins = [
        [r.m for r in m.transform(valid).select(F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("m")).collect()]
        for m in (model, BO.truncated(whole, best))
    ]
    assert margins[0] == margins[1]
    trees, weights = whole.trees[:best], whole.treeWeights[:best]
    row = valid.first()
    assert math.isclose(sum(w * t.predict(row.features) for t, w in zip(trees, weights)), margins[0][0] / 2, abs_tol=1e-9) or math.isclose(
        sum(w * t.predict(row.features) for t, w in zip(trees, weights)), margins[0][0], abs_tol=1e-9
    )
    model.write().save(str(tmp_path / "short"))
    again = GBTClassificationModel.load(str(tmp_path / "short"))
    assert again.getNumTrees == best and again.getFeaturesCol() == "features" and again.numFeatures == 2
    empty = BO.fit_with_patience(booster.copy({booster.maxIter: 3}), train, valid.limit(0), patience=2)
    assert empty[0].getNumTrees == 3 and empty[1] == []
    with pytest.raises(ValueError):
        BO.truncated(model, 0)
