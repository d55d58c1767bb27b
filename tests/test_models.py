import random
from datetime import date

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from clientpulse.plans import models as ML
from clientpulse.plans import reasons as R
from clientpulse.plans import search as SE

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng, rows = random.Random(11), []
    for i in range(900):
        a, b, c = rng.gauss(0, 1), rng.expovariate(1), rng.choice("xyz")
        y = int(a + 0.5 * b + (c == "x") + rng.gauss(0, 1) > 0.8)
        rows.append((i, date(2020, 1 + i % 6, 1), None if i % 17 == 0 else a, b, c, y))
    return spark.createDataFrame(rows, "client_id int, mon date, a double, b double, c string, target int").cache()


@pytest.fixture(scope="module")
def stages():
    return lambda: ML.preprocessing(["client_id", "mon"], ["a", "b"], ["c"], "target")


@pytest.mark.parametrize(
    "family, params",
    [("forest", {"numTrees": 5, "maxDepth": 4}), ("boosted", {"maxIter": 4, "maxDepth": 3}), ("logistic", {"regParam": 0.01})],
)
def test_contributions_explain_the_score(data, stages, family, params, monkeypatch):
    monkeypatch.setattr(R, "NODES_PER_PASS", 20)
    model = ML.train(data, stages(), family, "target", **params)
    scored = model.stages[-1].transform(ML.prefix(model).transform(data))
    second = lambda c: F.get(vector_to_array(c), F.lit(1))
    scored = scored.withColumn("score", second("probability") if family == "forest" else second("rawPrediction"))
    added = F.aggregate("contribs", F.lit(0.0), lambda acc, c: acc + c["contribution"])
    if family == "logistic":
        rows = R.contributions(scored, ["client_id", "score"], model.stages[-1], FEATURES)
        mean = scored.agg(F.avg("score")).first()[0]
        rows = rows.select("score", (added + mean).alias("explained"))
    else:
        rows = R.tree_contributions(scored, ["client_id", "score"], model.stages[-1], FEATURES)
        rows = rows.select("score", (F.col("base") + added).alias("explained"))
    assert rows.count() == 900
    assert rows.agg(F.max(F.abs(F.col("score") - F.col("explained")))).first()[0] < 1e-9
    raw = scored.withColumn("shown", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    first = R.contributions(raw, ["client_id"], model.stages[-1], FEATURES).first().contribs
    assert [(c.feature, c.value) for c in first] == [("a", 1.0), ("b", 2.0), ("c", 3.0)]


def test_explain_reports_raw_values(spark, data, stages):
    model = ML.train(data, stages(), "forest", "target", numTrees=3, maxDepth=3)
    wanted = spark.createDataFrame([(1, 1), (2, 1), (3, 4)], "client_id int, product_id int")
    got = R.explain(wanted, data, {1: model}, ["client_id", "mon"]).collect()
    known = {r.client_id: r for r in data.filter("client_id in (1, 2)").collect()}
    assert {r.client_id for r in got} == {1, 2}
    for r in got:
        assert [c.value for c in r.contribs][:2] == [known[r.client_id].a, known[r.client_id].b]


def test_versions(spark, data, stages, tmp_path):
    root = str(tmp_path)
    assert ML.latest_version(spark, root, 1) == 1
    model = ML.train(data, stages(), "logistic", "target", regParam=0.1)
    assert [ML.save(model, spark, root, 1), ML.save(model, spark, root, 1), ML.save(model, spark, root, 3)] == [1, 2, 1]
    assert ML.latest_version(spark, root, 1) == 2
    a, b = (ML.score(data, m).orderBy("client_id").select("prob").collect() for m in (model, ML.load_latest(spark, root, 1)))
    assert a == b


def test_threshold_is_strict(spark, data, stages):
    model = ML.train(data, stages(), "logistic", "target", regParam=0.1)
    p = ML.score(data, model).agg(F.max("prob")).first()[0]
    assert ML.score(data, model, p).agg(F.max("pred")).first()[0] == 0


def test_folds_are_disjoint_in_time(data):
    cuts = ML.fold_cuts(data, "mon")
    assert cuts == [date(2020, m, 1) for m in range(2, 7)]
    for cut in cuts:
        before, after = ML.fold_parts(data, "mon", cut)
        assert before.agg(F.max("mon")).first()[0] < cut == after.agg(F.min("mon")).first()[0]
    rolling, _ = ML.fold_parts(data, "mon", cuts[-1], span=1)
    assert rolling.select("mon").distinct().count() == 1


def test_search_is_seeded(data, stages):
    assert SE.draw("forest", 3) == SE.draw("forest", 3)
    table = SE.summary(SE.search(data, stages(), "target", "mon", "logistic", n_trials=2, last_folds=1)).collect()
    assert len(table) == 2 and table[0].mean_f1 >= table[1].mean_f1 > 0


def test_batch_inference_is_long(data, stages):
    model = ML.train(data, stages(), "logistic", "target", regParam=0.1)
    rows = ML.batch_inference(data.limit(10).drop("target"), {1: (model, 0.5), 3: (model, 0.9)})
    assert rows.columns == ["mon", "client_id", "product_id", "name_product", "prob", "pred"]
    assert rows.count() == 20


def test_small_folds_make_few_tasks(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 8)
    assert ML.few_tasks(rows).rdd.getNumPartitions() == 1
    assert ML.few_tasks(rows.filter("id < 0")).rdd.getNumPartitions() == 1
    monkeypatch.setattr(ML, "ROWS_PER_TASK", 10)
    kept = ML.few_tasks(rows)
    assert kept.rdd.getNumPartitions() == 8 and kept.count() == 1000


def test_every_recommended_client_gets_its_reasons(spark, data, stages, monkeypatch):
    from clientpulse.catalog import answers as A

    model = ML.train(data, stages(), "forest", "target", numTrees=3, maxDepth=3)
    later = data.filter("client_id < 300").withColumn("mon", F.lit(date(2021, 1, 1)))
    rows = data.unionByName(later).drop("target")
    monkeypatch.setattr(A, "KEY", ["client_id", "mon"])
    monkeypatch.setattr(A, "chosen", lambda s, d: {1: (model, None), 3: (model, None)})
    monkeypatch.setattr(A, "test_master", lambda s, d: rows)
    got = [(r.client_id, r.mon, r.product_id) for r in A._model_reasons(spark, "").collect()]
    newest = {r.client_id: r for r in sorted(rows.collect(), key=lambda r: r.mon)}
    want = set()
    for product in (1, 3):
        scored = ML.score(rows, model, ML.THRESHOLDS[product]).filter("pred = 1").select("client_id", "mon").collect()
        want |= {(r.client_id, r.mon, product) for r in scored if newest[r.client_id].mon == r.mon}
    assert len(want) > 200 and len(got) == len(set(got)) and set(got) == want
