"""Cases that once gave wrong answers."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from clientpulse.operators.statistics import anova, vif, vif_eliminate
from clientpulse.plans import models as ML
from clientpulse.plans import reasons as R
from clientpulse.prep import NumericImputer
from clientpulse.streaming import requests as ST


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, float(i * 37 % 101), float(i * 53 % 97), 3.0, i % 2) for i in range(400)]
    return spark.createDataFrame(rows, "id int, a double, b double, k double, y int").withColumn("b2", F.col("b"))


def test_duplicate_and_constant_columns(frame):
    got = {r.feature: r.vif for r in vif(frame, ["a", "b", "b2", "k"]).collect()}
    assert got["a"] < 1.5 and got["b"] == got["b2"] == math.inf and got["k"] is None
    kept = {r.feature: r.dropped_at for r in vif_eliminate(frame, ["a", "b", "b2", "k"]).collect()}
    assert kept["a"] is None and kept["k"] == 1 and sorted([kept["b"] or 0, kept["b2"] or 0]) == [0, 2]
    assert vif_eliminate(frame, ["k"]).first().dropped_at == 1


def test_random_draw_needs_keys(frame):
    with pytest.raises(ValueError):
        NumericImputer(inputCols=["a"], strategy="random").fit(frame)


def test_perfect_predictor(frame):
    rows = frame.withColumn("same", F.col("y") * 0.1)
    got = {r.feature: (r.f, r.p_value) for r in anova(rows, "y", ["same", "k", "a"]).collect()}
    assert got["same"] == (math.inf, 0.0) and got["k"] == (None, None) and got["a"][1] > 0


def test_null_contribution_is_last(spark):
    packed = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(1.0).alias("value"), F.lit(c).cast("double").alias("contribution")) for f, c in (("a", None), ("b", 0.0), ("c", 2.0))])
    row = R.top_reasons(spark.range(1).select("id", packed.alias("contribs"))).first()
    assert row.reasons == [f"{R.UP} c = 1.0", f"{R.DOWN} b = 1.0"]


def test_client_explained_alone(spark, tmp_path):
    rows = [(i, date(2020, 1 + m, 1), float(i * 37 % 101) + m, float(i * 53 % 97), "xy"[i % 2], int(i * 37 % 101 > 40)) for i in range(120) for m in range(2)]
    data = spark.createDataFrame(rows, "client_id int, mon date, a double, b double, c string, target int")
    model = ML.train(data, ML.preprocessing(["client_id", "mon"], ["a", "b"], ["c"], "target"), "logistic", "target", regParam=0.1)
    ML.save(model, spark, str(tmp_path), 1)
    model = ML.load_latest(spark, str(tmp_path), 1)
    ask = lambda rows: {r.client_id: r for r in R.explain(rows, data, {1: model}, ["client_id", "mon"]).collect()}
    everyone = ask(data.select("client_id", F.lit(1).alias("product_id")))
    alone = ask(spark.createDataFrame([(7, 1)], "client_id int, product_id int"))
    assert len(everyone) == 120 and set(alone) == {7} and alone[7].mon == date(2020, 2, 1)
    assert [c.contribution for c in alone[7].contribs] == pytest.approx([c.contribution for c in everyone[7].contribs])
    assert any(abs(c.contribution) > 1e-6 for c in alone[7].contribs)


def test_late_and_repeated_requests_are_answered_once(spark, tmp_path):
    def deliver(*ids):
        rows = [(i, 7, "hola", None, datetime(2024, 2, 20 - i)) for i in ids]
        spark.createDataFrame(rows, "update_id long, chat_id long, text string, reply_json string, received_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = (
            ST.first_deliveries(ST.read_requests(spark, str(tmp_path / "in")))
            .writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")))
            .option("checkpointLocation", str(tmp_path / "check"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    deliver(1, 2, 2)
    deliver(15, 1)  # two weeks late, and one repeated
    deliver(2, 15, 3)
    got = sorted(r.update_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [1, 2, 3, 15]
