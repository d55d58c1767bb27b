"""The stages against brute force on the small table, and the queries that SQL can express."""

import os
import sys

import corpus_pipeline
import pytest

from clientpulse.llm import queries

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from brute import brute_groups, brute_removed, texts_of, words  # noqa: E402
from check_oracles import compare, duck, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_duckdb(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck(SF).execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert compare(rows_of(df.columns, df.collect()), rows_of(names, rel.fetchall())) is None


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language_id"](spark, docs, SF)
    assert one.columns == docs.columns and one.count() == docs.count()
    two = stage["exact_dedup"](spark, one, SF)
    bare = {}
    for doc, text in sorted(texts_of(docs), key=lambda r: (-len(r[1]), r[0])):
        bare.setdefault(b"".join(words(text)), doc)
    assert {r["doc_id"] for r in two.collect()} == set(bare.values())
    three = stage["near_dedup"](spark, two, SF)
    groups = brute_groups(texts_of(two), 5, 80)
    assert {r["doc_id"] for r in three.collect()} == {d for d, (_, c) in groups.items() if c == d}
    four = stage["substring_dedup"](spark, three, SF)
    assert four.columns == docs.columns
    assert {r["doc_id"]: len(words(r["text"])) for r in four.collect()} == {d: n - k for d, (n, k, _) in brute_removed(texts_of(three)).items()}
    assert {r["doc_id"] for r in stage["best_fit_packing"](spark, four, SF).collect()} == {d for d, _ in texts_of(four)}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_hand_whole_texts_over_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "a text", "en", "a", 6)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        for held, wanted in (("10000", "1000"), ("0", "1000"), ("300", "300")):
            spark.conf.set(key, held)
            corpus_pipeline.exact_dedup(spark, docs, "")
            assert spark.conf.get(key) == wanted
    finally:
        spark.conf.set(key, before)
