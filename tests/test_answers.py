from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clientpulse.functions.text import reply_ids, reply_intents
from clientpulse.plans import recommend as RC
from clientpulse.plans.reasons import DOWN, UP, complete_reasons, global_reasons, linear_contributions, top_reasons
from clientpulse.streaming import requests as ST

IN, OTHER, OUT = "a" * 16, "b" * 16, "c" * 16


@pytest.fixture(scope="module")
def tables(spark):
    positives = spark.createDataFrame(
        [(IN, 1, "product_1", 0.835), (IN, 3, "product_3", 0.9), (OTHER, 4, None, 0.5)],
        "client_id string, product_id int, name_product string, prob double",
    )
    reasons = spark.createDataFrame(
        [(IN, 1, [f"{UP} x = 1.0", f"{DOWN} y = 2.0"]), (OTHER, 4, [f"{UP} x = 3.0"])],
        "client_id string, product_id int, reasons array<string>",
    )
    portfolio = spark.createDataFrame([(IN, 7), (OTHER, 7), ("d" * 16, 7)], "client_id string, chat_id long")
    names = spark.createDataFrame([(1, "product_1"), (4, "product_4")], "product_id int, name_product string")
    return positives, reasons, portfolio, names


def ask(spark, *rows):
    full = [(i, c, t, r, datetime(2024, 1, 1, 0, i)) for i, (c, t, r) in enumerate(rows)]
    return spark.createDataFrame(full, "update_id long, chat_id long, text string, reply_json string, received_at timestamp")


def test_four_outcomes(spark, tables):
    requests = ask(
        spark,
        (9, "hola", None),
        (7, "hola", None),
        (7, f"cliente {IN.upper()} y {OUT}", None),
        (7, f"cliente {OUT}", None),
        (7, f"cliente {'d' * 16}", None),
    )
    got = {r.update_id: r for r in RC.resolve_scope(requests, tables[2]).collect()}
    assert [got[i].outcome for i in range(5)] == ["empty", "whole", "subset", "fallback", "subset"]
    assert got[2].inside == [IN] and got[2].outside == [OUT] and OUT in got[2].notice
    # a portfolio client without recommendations is not reported as outside
    assert got[4].notice is None


@pytest.mark.parametrize(
    "reply, intents, ids",
    [
        (None, ["recs"], []),
        ("", ["recs"], []),
        ("{broken", ["recs"], []),
        ('{"intents": []}', ["recs"], []),
        ('{"intents": 5}', ["recs"], []),
        ('{"intent": "razones"}', ["razones"], []),
        ('{"intents": ["razones", "otro", "razones", "recs"], "client_ids": [" ABC "]}', ["razones", "recs"], ["abc"]),
        ('{"intents": ["recs"], "client_ids": "abc"}', ["recs"], []),
    ],
)
def test_reply_parsing(spark, reply, intents, ids):
    row = spark.createDataFrame([(reply,)], "r string").select(reply_intents("r").alias("i"), reply_ids("r").alias("c")).first()
    assert (row.i, row.c) == (intents, ids)


def test_texts(spark, tables):
    positives, reasons, portfolio, names = tables
    blocks = {r.client_id: r.block for r in RC.recommendation_blocks(positives).collect()}
    assert blocks[IN] == f"Cliente: {IN}\n- product_3 — Prob 90%\n- product_1 — Prob 84%"
    assert blocks[OTHER] == f"Cliente: {OTHER}\n- Producto 4 — Prob 50%"
    personal = {r.client_id: r.block for r in RC.personal_blocks(positives, reasons).collect()}
    assert "x = 1.0 (al alza); y = 2.0 (a la baja)." in personal[IN]
    general = RC.general_text(reasons, names).first().body
    assert "product_1: product_1 se recomienda porque en tu cartera destacan al alza: x." in general


def test_portfolio_is_paged_without_loss(spark):
    positives = spark.range(130).select(
        F.format_string("%016x", "id").alias("client_id"), F.lit(1).alias("product_id"), F.lit("p").alias("name_product"), F.lit(0.5).alias("prob")
    )
    portfolio = positives.select("client_id", F.lit(1).alias("chat_id"))
    pages = RC.portfolio_messages(positives, portfolio, 50).orderBy("part_no").collect()
    assert [p.body.count("Cliente: ") for p in pages] == [50, 50, 30]


def test_answers_and_stream_agree(spark, tables, tmp_path):
    positives, reasons, portfolio, names = tables
    requests = ask(
        spark,
        (7, "hola", '{"intents": ["recs", "razones"]}'),
        (7, f"por favor {IN}", '{"intents": ["recs", "razones"]}'),
        (7, f"por favor {'d' * 16}", '{"intents": ["recs", "razones"]}'),
        (7, "", None),
        (None, "hola", None),
        (9, "hola", None),
    )
    batch = RC.answer(ST.usable(requests), positives, reasons, portfolio, names)
    want = sorted(map(tuple, batch.collect()))
    sections = {(r[0], r[2]) for r in want}
    assert sections == {(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2), (5, 0)}
    assert [r[4] for r in want if r[0] == 2] == [RC.NO_RECS, RC.NO_PERSONAL]
    for _ in range(2):
        requests.write.mode("append").parquet(str(tmp_path / "in"))
    source = ST.read_requests(spark, str(tmp_path / "in"), files_per_trigger=1)
    query = ST.answer_stream(source, str(tmp_path / "out"), str(tmp_path / "check"), positives, reasons, portfolio, names)
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("update_id", "chat_id", "section", "part_no", "body")
    assert sorted(map(tuple, got.collect())) == want


def test_equal_messages_of_several_requests_lie_together(spark, tables):
    clients = [f"{i:016x}" for i in range(160)]
    positives = spark.createDataFrame([(c, 1, "product_1", 0.5) for c in clients], tables[0].schema)
    portfolio = spark.createDataFrame([(c, 7) for c in clients] + [("e" * 16, 8)], "client_id string, chat_id long")
    requests = ask(spark, *[(7, "hola", None)] * 5, (8, "hola", None))
    got = RC.answer(requests, positives, tables[1], portfolio, tables[3]).collect()
    parts = [r.part_no for r in got if r.chat_id == 7]
    assert sorted(parts) == [p for p in (1, 2, 3, 4) for _ in range(5)]
    assert sum(a != b for a, b in zip(parts, parts[1:])) == 3
    assert [(r.update_id, r.section, r.part_no, r.body) for r in got if r.chat_id == 8] == [(5, 1, 1, RC.NO_RECS)]


def test_refused_and_failed_requests(spark, tables, tmp_path):
    requests = ask(spark, (7, "hola", None), (8, "hola", None))
    requests.write.parquet(str(tmp_path / "in"))

    def broken(*_):
        raise RuntimeError("no answer")

    query = ST.answer_stream(
        ST.read_requests(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), *tables, whitelist=[7], respond=broken
    )
    query.awaitTermination()
    got = {r.update_id: r.body for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: ST.FAILED, 1: ST.NOT_ALLOWED}


def test_linear_contributions_add_up(spark):
    frame = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(20)], "id int, a double, b double")
    weights = {"a": 2.0, "b": -0.5}
    rows = linear_contributions(frame, ["id", "a", "b"], weights).collect()
    mean = sum(2.0 * r.a - 0.5 * r.b for r in rows) / len(rows)
    for r in rows:
        assert sum(c.contribution for c in r.contribs) == pytest.approx(2.0 * r.a - 0.5 * r.b - mean)


def test_top_reasons_and_counts(spark):
    packed = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("value"), F.lit(c).alias("contribution")) for f, v, c in (("a", 1.0, 0.1), ("b", 2.0, -3.0), ("c", 3.0, 2.0))]
    )
    keys = spark.createDataFrame([("x", 1), ("y", 1)], "client_id string, product_id int")
    contribs = keys.withColumn("contribs", packed)
    top = top_reasons(contribs)
    assert top.first().reasons == [f"{DOWN} b = 2.0", f"{UP} c = 3.0"]
    counts = {(r.direction, r.feature): r.n for r in global_reasons(top).collect()}
    assert counts == {("down", "b"): 2, ("up", "c"): 2}
    stored = top.filter("client_id = 'x'")
    assert complete_reasons(keys, stored, contribs).count() == 2
