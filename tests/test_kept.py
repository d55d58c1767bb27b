"""Tables that are kept up: bucketed masters, monthly features, reasons; and the request stream's state."""

import os
from datetime import date, datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from clientpulse.catalog import modelling
from clientpulse.plans import maintain as MT
from clientpulse.plans.features import feats_purchase
from clientpulse.plans.master import join_features
from clientpulse.plans.reason_store import ReasonStore
from clientpulse.plans.target import build_target, lookahead_label, lookahead_labels
from clientpulse.session import materialize, scratch_path
from clientpulse.sources import bindings as B
from clientpulse.sources import bucketed as BU
from clientpulse.streaming import requests as ST

SF = "/root/testdata/sf0.001"
KEY = ["client_id", "mon"]


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_bucketed_tables_join_in_place(spark):
    label = spark.createDataFrame([(i % 40, date(2020, 1 + i // 40, 1), i) for i in range(400)], "client_id int, mon date, y int")
    left = label.filter("y % 3 > 0").select(*KEY, (F.col("y") * 2).alias("a"))
    right = label.filter("y % 2 > 0").select(*KEY, (F.col("y") * 5).alias("b"))
    names = [BU.write_bucketed(t, KEY, 4) for t in (label, left, right)]
    joined = BU.co_located(spark, names[0], names[1:], KEY)
    assert BU.exchanges(joined) == 0 < BU.exchanges(join_features(label, left.hint("merge"), right.hint("merge")))
    assert rows_of(joined) == rows_of(join_features(label, left, right))
    assert BU.bucket_counts(label, KEY, 4).agg(F.sum("n")).first()[0] == 400


def test_month_by_month_equals_the_full_build(spark, tmp_path):
    purchase = B.purchase(spark, SF).cache()
    months = sorted(r.mon for r in purchase.select("mon").distinct().collect())[:8]
    known = purchase.filter(F.col("mon") <= F.lit(months[-1]))
    for month in months:
        done = MT.advance(spark, purchase, str(tmp_path), month)
        if month in (months[0], months[-1]):
            full = feats_purchase(known).filter(F.col("mon") == F.add_months(F.lit(month), 1))
            assert rows_of(done.select(*full.columns)) == rows_of(full)
    # a month that is repeated replaces itself
    again = MT.advance(spark, purchase, str(tmp_path), months[-1])
    full = feats_purchase(known).filter(F.col("mon") == F.add_months(F.lit(months[-1]), 1))
    assert rows_of(again.select(*full.columns)) == rows_of(full)
    assert spark.read.parquet(str(tmp_path / "features")).count() == known.count()


def test_reasons_are_computed_once_per_version(spark, tmp_path):
    pairs = spark.createDataFrame([(c, p) for c in "abcd" for p in (1, 3)], "client_id string, product_id int")
    one = F.struct(F.lit("x").alias("feature"), F.lit(1.0).alias("value"), F.lit(2.0).alias("contribution"))
    contribs = pairs.withColumn("contribs", F.array(one))
    store = ReasonStore(spark, str(tmp_path), 1)
    assert store.read() is None
    assert store.complete(pairs.filter("product_id = 1"), contribs).count() == 4
    first = {(r.client_id, r.product_id): r.run for r in store.complete(pairs, contribs).collect()}
    assert sorted(first.values()) == [1] * 4 + [2] * 4
    # nothing is computed again, even from nothing
    again = store.complete(pairs, contribs.limit(0)).collect()
    assert {(r.client_id, r.product_id): r.run for r in again} == first
    store.compact()
    assert {(r.client_id, r.product_id): r.run for r in store.read().collect()} == first
    other = ReasonStore(spark, str(tmp_path), 2)
    assert other.read() is None and other.complete(pairs.limit(1), contribs).first().run == 1


def test_label_build(spark):
    few = B.purchase(spark, SF).withColumn("target_3", F.when(F.col("client_id") % 7 == 0, F.col("target_3")).otherwise(0))
    built = materialize(build_target(few, 3), "built")
    label = materialize(lookahead_label(few, "target_3", "target_3"), "label")
    counts = [{r.target_3: r["count"] for r in t.groupBy("target_3").count().collect()} for t in (built, label)]
    # every positive stays; negatives are thinned out to their share
    assert counts[0][1] == counts[1][1] and counts[0][0] < counts[1][0]
    assert built.count() == built.select(*KEY).distinct().count() and built.exceptAll(label).isEmpty()


def test_labels_of_all_products_in_one_pass(spark):
    rows = [(i % 9, date(2020, 1 + i % 11, 1), int(i % 5 == 0), int(i % 7 == 0)) for i in range(99)] + [(None, date(2020, 3, 1), 1, 0)]
    purchase = spark.createDataFrame(rows, "client_id int, mon date, target_1 int, target_3 int")
    together = lookahead_labels(purchase, {"label_1": "target_1", "label_3": "target_3"})
    for k in (1, 3):
        alone = lookahead_label(purchase, f"target_{k}", f"label_{k}")
        own = together.select(*KEY, f"label_{k}")
        assert alone.count() == own.count() > 0 and own.exceptAll(alone).isEmpty()


def test_product_datasets_share_one_join(spark, tmp_path):
    priorities = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    orders = [(i, i % 13 or None, datetime(2020, 1 + i * 7 % 12, 1 + i % 28), priorities[i * i % 5], "O") for i in range(300)]
    items = [(i // 2, 1 + i % 7, 10.0 + i, "O", "NRA"[i % 3]) for i in range(600)]
    named = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_orderstatus string"),
        "lineitem": (items, "l_orderkey long, l_linenumber long, l_extendedprice double, l_linestatus string, l_returnflag string"),
    }
    for name, (rows, schema) in named.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    tables = {k: modelling.dataset(spark, str(tmp_path), k) for k in B.PRODUCTS}
    assert len({tuple(sorted(t.inputFiles())) for t in tables.values()}) == 1
    for k, table in tables.items():
        label = lookahead_label(B.purchase(spark, str(tmp_path)), f"target_{k}", "target")
        joined = join_features(label, modelling.features(spark, str(tmp_path)))
        assert table.columns == joined.columns and table.count() == joined.count() > 0
        assert table.exceptAll(joined).isEmpty()


def ask(spark, *ids):
    rows = [(i, 7, f"hola {i}", None, datetime(2024, 1, 1)) for i in ids]
    return spark.createDataFrame(rows, "update_id long, chat_id long, text string, reply_json string, received_at timestamp").coalesce(1)


def reply(rows, *_):
    return rows.select("update_id", F.col("chat_id").cast("long").alias("chat_id"), F.lit(1).alias("section"), F.lit(1).alias("part_no"), F.col("text").alias("body"))


def strict(rows, *_):
    """Fails in a task on texts that end with 3, and on the driver where there is a request 5."""
    if not rows.filter("update_id = 5").isEmpty():
        raise RuntimeError("five")
    number = F.when(F.col("update_id") == 3, F.lit("three")).otherwise(F.lit("1")).cast("int")
    return reply(rows).withColumn("section", number)


def start(spark, root, respond):
    query = ST.answer_stream(ST.read_requests(spark, f"{root}/in"), f"{root}/out", f"{root}/check", None, None, None, None, respond=respond)
    query.awaitTermination()


def test_one_bad_request_does_not_spoil_its_batch(spark, tmp_path):
    ask(spark, *range(8)).write.parquet(str(tmp_path / "in"))
    start(spark, tmp_path, strict)
    got = {r.update_id: r.body for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: ST.FAILED if i in (3, 5) else f"hola {i}" for i in range(8)}
    dead = {r.update_id: r.error for r in spark.read.parquet(str(tmp_path / "out-dead")).collect()}
    assert set(dead) == {3, 5} and "five" in dead[5] and "three" in dead[3]


def test_a_broken_off_batch_is_answered_again(spark, tmp_path, monkeypatch):
    ask(spark, 1, 2).write.parquet(str(tmp_path / "in"))
    whole = ST.by_row

    def lost(*_):
        raise StreamingQueryException("executor lost")

    monkeypatch.setattr(ST, "by_row", lost)
    with pytest.raises(Exception):
        start(spark, tmp_path, reply)
    monkeypatch.setattr(ST, "by_row", whole)
    start(spark, tmp_path, reply)
    ask(spark, 2, 3, 3).write.mode("append").parquet(str(tmp_path / "in"))
    start(spark, tmp_path, reply)
    got = [r.update_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [1, 2, 3]


def test_answers_are_built_and_written_once(spark, tmp_path):
    """The batch that only moves the watermark is not answered, and no copy of the answers is kept elsewhere."""
    ask(spark, *range(6)).write.parquet(str(tmp_path / "in"))
    asked = []

    def counted(rows, *_):
        asked.append(rows.count())
        return reply(rows)

    made = scratch_path(spark, "x").rsplit("/", 1)[0]
    before = set(os.listdir(made))
    start(spark, tmp_path, counted)
    assert asked == [6]
    assert not [x for x in set(os.listdir(made)) - before if x.startswith("messages")]
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.update_id for r in got.collect()) == list(range(6))
    ask(spark).write.mode("append").parquet(str(tmp_path / "in"))
    start(spark, tmp_path, counted)
    assert asked == [6] and spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_requests_without_an_id_are_left_out(spark):
    rows = ask(spark, 1).unionByName(ask(spark, 2).withColumn("update_id", F.lit(None).cast("long")))
    assert [r.update_id for r in ST.usable(rows).collect()] == [1]
