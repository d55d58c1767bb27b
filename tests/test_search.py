"""The parameter search as a race over folds."""

import random
import threading
from datetime import date

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from clientpulse.plans import models as ML
from clientpulse.plans import search as SE
from clientpulse.prep import NumericImputer

SMALL = {"logistic": {"inverse_strength": (0.001, 0.1), "elasticNetParam": (1.0, 0.0, 0.5), "balanced": [True, False], "maxIter": (5, 20), "weight_root": SE.ROOTS}}


@pytest.fixture(scope="module")
def data(spark):
    rng, rows = random.Random(4), []
    for i in range(600):
        a, b = rng.gauss(0, 1), rng.expovariate(1)
        rows.append((i, date(2020, 1 + i % 5, 1), None if i % 17 == 0 else a, b, rng.choice("xyz"), int(a + rng.gauss(0, 1) > 0.5)))
    return spark.createDataFrame(rows, "client_id int, mon date, a double, b double, c string, target int").cache()


def stages():
    return [NumericImputer(inputCols=["a", "b"], addFlags=False), VectorAssembler(inputCols=["a", "b"], outputCol="features")]


def test_draws_lie_in_their_ranges():
    for family in SE.SPACES:
        assert SE.draw(family, 4) == SE.draw(family, 4) and SE.draw(family, 4)[:2] == SE.draw(family, 2)
    roots = {t["weight_root"] for t in SE.draw("logistic", 200)}
    assert roots == set(SE.ROOTS) and {t["balanced"] for t in SE.draw("logistic", 50)} == {True, False}
    for t in SE.draw("forest", 50):
        assert 500 <= t["numTrees"] <= 2000 and 5 <= t["maxDepth"] <= 12 and t["impurity"] in ("gini", "entropy")
    for t in SE.draw("boosted", 50):
        assert 0.001 <= t["stepSize"] <= 0.1 and 0.5 <= float(t["featureSubsetStrategy"]) <= 0.95


def scores(rows):
    return {(t, f): {"f1": v} for t, values in enumerate(rows) for f, v in enumerate(values) if v is not None}


def test_who_leaves_the_race():
    rows = [[0.5] * 4, [0.6] * 4, [0.7] * 4, [0.4] * 4, [0.65] * 4]
    assert SE.leavers(scores(rows), 5, 4, 3, 1) == {3: 1}
    assert SE.leavers(scores(rows), 5, 4, 5, 1) == {}
    # nothing is certain behind a trial that has not come as far
    assert SE.leavers(scores([[0.5] * 4, [0.6, None, None, None], [0.7] * 4, [0.4] * 4, [0.1] * 4]), 5, 4, 3, 1) == {}
    # what is certain stays so when more is known
    rng = random.Random(1)
    for _ in range(200):
        full = [[rng.random() for _ in range(6)] for _ in range(7)]
        final = SE.leavers(scores(full), 7, 6, 2, 2)
        known = scores(full)
        for key in list(known):
            if rng.random() < 0.2 or known.get((key[0], key[1] - 1)) is None and key[1] > 0:
                known.pop(key)
        early = SE.leavers(known, 7, 6, 2, 2)
        assert all(final.get(t) == f for t, f in early.items())


def run(data, **more):
    return SE.search(data, stages(), "target", "mon", "logistic", n_trials=4, spaces=SMALL, startup=1, warmup=1, **more)


def test_pruned_trials_have_the_same_prefix(spark, data, tmp_path):
    ledger = str(tmp_path / "ledger")
    whole = {(r.trial, r.fold): r for r in run(data, prune=False).collect()}
    cut = {(r.trial, r.fold): r for r in run(data, ledger=ledger).collect()}
    assert len(whole) == 4 * 4 and set(cut) < set(whole)
    for key, row in cut.items():
        assert (row.f1, row.precision, row.recall, row.ks) == pytest.approx((whole[key].f1, whole[key].precision, whole[key].recall, whole[key].ks))
        assert 0 <= row.ks <= 1
    left = {r.trial for r in cut.values() if r.left}
    assert left and 0 not in left
    table = SE.summary(spark.createDataFrame(list(cut.values()))).collect()
    assert not table[0].left and table[0].folds == 4
    # the same search from its ledger fits nothing again
    fitted, SE.fitted = SE.fitted, None
    try:
        again = {(r.trial, r.fold): r for r in run(data, ledger=ledger).collect()}
    finally:
        SE.fitted = fitted
    assert {k: (v.f1, v.ks, v.left) for k, v in again.items()} == {k: (v.f1, v.ks, v.left) for k, v in cut.items()}


def test_metrics_against_counts(spark, data, tmp_path):
    scored = spark.createDataFrame([(1, 0.9, 1), (1, 0.2, 0), (0, 0.8, 1), (0, 0.1, 0), (1, 0.7, 1)], "target int, prob double, pred int")
    got = SE.fold_metrics(scored, "target", str(tmp_path / "h"))
    assert got == pytest.approx({"f1": 2 / 3, "precision": 2 / 3, "recall": 2 / 3})
    one_class = SE.fold_metrics(scored.filter("pred = 1"), "target", str(tmp_path / "h1"))
    assert one_class["precision"] == 0 and one_class["recall"] == 1
    nothing = SE.fold_metrics(scored.filter("pred > 1"), "target", str(tmp_path / "h2"))
    assert nothing == {"f1": 0.0, "precision": 0.0, "recall": 0.0}


def test_leaking_folds_are_refused(data, monkeypatch):
    monkeypatch.setattr(ML, "fold_parts", lambda df, *_: (df, df))
    with pytest.raises(ValueError, match="reach into"):
        ML.prepared_fold(data, "mon", date(2020, 3, 1), stages())


def test_weights(data):
    rows = ML.weighted(data, "target", None)
    assert rows.agg(F.min("weight"), F.max("weight")).first() == (1.0, 1.0)
    even = ML.weighted(data, "target", None, balanced=True).groupBy("target").agg(F.sum("weight").alias("w")).collect()
    assert even[0].w == pytest.approx(even[1].w) and sum(r.w for r in even) == pytest.approx(600)


@pytest.mark.parametrize("root, balanced", [(None, False), (3, False), (1, True), (None, True)])
def test_known_counts_weigh_as_a_pass_over_the_rows(data, root, balanced):
    counts = ML.class_counts(data, "target")
    with_pass, without = (ML.weighted(data, "target", root, balanced, c) for c in (None, counts))
    assert without.exceptAll(with_pass).isEmpty() and without.count() == 600
    totals = [ML._total_weight(with_pass, root, balanced, c) for c in (None, counts)]
    assert totals[1] == pytest.approx(totals[0], rel=1e-12)


def test_small_fits_take_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert ML.fits_at_once(spark, 90_000) == max(ML.PARALLEL_FITS, cores) and ML.fits_at_once(spark, 10**9) == ML.PARALLEL_FITS
    assert ML.fits_at_once(spark, 0) >= ML.PARALLEL_FITS


def test_trials_do_not_count_their_fold_again(data, monkeypatch):
    seen = []
    original = SE.fitted
    monkeypatch.setattr(SE, "fitted", lambda *a, **k: seen.append(k["counts"]) or original(*a, **k))
    run(data)
    assert seen and all(n == n0 + n1 for n0, n1, n in seen) and len(set(seen)) == 4


def test_trials_run_while_later_folds_are_prepared(data, monkeypatch):
    begun, prepare, fit = threading.Event(), SE.prepared_fold, SE.fitted

    def waiting(df, time_col, cut, *rest):
        assert cut < date(2020, 5, 1) or begun.wait(60)
        return prepare(df, time_col, cut, *rest)

    def noted(*args, **settings):
        begun.set()
        return fit(*args, **settings)

    monkeypatch.setattr(SE, "prepared_fold", waiting)
    monkeypatch.setattr(SE, "fitted", noted)
    assert run(data, prune=False).count() == 4 * 4


def test_random_draws_are_made_once(data):
    drawn = [NumericImputer(inputCols=["a", "b"], strategy="random", keyCols=["client_id", "mon"]), VectorAssembler(inputCols=["a", "b"], outputCol="features")]
    model, rows = ML.fitted_stages(drawn, data)
    again = Pipeline(stages=drawn).fit(data).transform(data)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (rows, again)]
    assert ["ArrowEvalPython" in p for p in plans] == [False, True]
    assert sorted(map(str, rows.collect())) == sorted(map(str, again.collect())) == sorted(map(str, model.transform(data).collect()))
