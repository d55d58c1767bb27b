"""Token counts, phrases and ranked search against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from clientpulse.llm import collocations as C
from clientpulse.llm import lexical_search as S
from clientpulse.llm import queries
from clientpulse.llm import token_counts as T

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=T.VOCABULARY)


@pytest.fixture(scope="module")
def hard():
    rng, names = random.Random(1), list(T.pieces(T.VOCABULARY).rank)
    bits = ["  ", " ", "   ", "▁", "\n", "\t", "a", "b", "th", "é", "中", "日本", "😀", "é", "\x00", "ing", "000", "123", ".", "</s>", "<0x41>", " " * 17]
    bits += [names[rng.randrange(len(names))] for _ in range(200)]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(600)]
    return [*texts, "", None, " ", "a" * 3000, "ab" * 400 + " " * 300 + "x", "中文" * 200, " " * 700]


def test_counts_of_whole_texts_and_prefixes(spark, library, hard):
    docs = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in T.prefix_counts(docs).collect()}
    for i, text in enumerate(hard):
        text = text or ""
        assert rows[i]["n_tokens"] == len(library.encode(text)) and rows[i]["n_bytes"] == len(text.encode())
        counts = T._decoded(bytes(rows[i]["prefix_steps"]), len(text))
        assert len(counts) == len(text) + 1 and counts[-1] == rows[i]["n_tokens"]
        for at in range(len(text)) if i < 80 else (len(text) // 2,):
            assert counts[at] == len(library.encode(text[:at]))


def test_budgets_are_answered_from_the_counts(spark, library, hard):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(hard[:40])], "doc_id long, text string")
    counted = T.prefix_counts(docs).join(docs, "doc_id").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    cut = counted.withColumns({"at": T.longest_within(F.col("prefix_steps"), F.col("n"), F.lit(9)), "all": T.counts_at(F.col("prefix_steps"), F.col("n"))})
    for r in cut.collect():
        text = r["text"] or ""
        fits = [i for i in range(len(text) + 1) if len(library.encode(text[:i])) <= 9]
        assert r["at"] == fits[-1] and r["all"][r["at"]] <= 9 and r["all"][-1] == r["n_tokens"]
    none = counted.select(T.longest_within(F.col("prefix_steps"), F.col("n"), F.lit(-1)).alias("a"), T.longest_within(F.col("prefix_steps"), F.col("n"), F.lit(None)).alias("b"))
    assert {(r["a"], r["b"]) for r in none.collect()} == {(None, None)}
    assert {r["over_limit"] for r in T.over_budget(T.prefix_counts(docs, keep=False), 3).select("over_limit").collect()} == {True, False}


def test_count_edges(spark, library, edge_docs, no_docs):
    rows = T.prefix_counts(edge_docs).collect()
    assert len(rows) == 11
    want = Counter((r["doc_id"], len(library.encode(r["text"] or ""))) for r in edge_docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == want
    assert T.prefix_counts(no_docs).count() == 0
    assert all(r["prefix_steps"] is None for r in T.prefix_counts(edge_docs, keep=False).collect())
    got = {r["doc_id"]: r for r in queries.op11_token_counts(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n = len(library.encode(r["text"] or ""))
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["over_limit"]) == (n, n > 4096)


def plain_phrases(rows, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in found.items():
        inside = lambda long: any(long[i : i + len(words)] == words for i in range(len(long) - len(words) + 1))
        if any(other == lang and len(long) > len(words) and b >= a and inside(long) for (other, long), b in found.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right, n[lang]))
    return {(lang, i + 1, p.decode(), -a, left, right, m, -s) for lang, own in out.items() for i, (s, a, p, left, right, m) in enumerate(sorted(own)[:top])}


@pytest.mark.parametrize("parts", [1, 6])
def test_phrases(spark, monkeypatch, parts):
    rng, rows = random.Random(parts), []
    vocabulary = ["the", "The", "of", "a", "é", "\x01b", "b", "x" * 40, "|", "New", "york"]
    for _ in range(250):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "?!", "\x0b"]) for _ in range(rng.randrange(0, 30)))
        rows.append((rng.choice(["en", "en", "de", None]), text + ("New York of the\n" * rng.randrange(3))))
    rows += [("fr", None), ("en", ""), ("und", "the of the of the of"), (None, "the of")]
    monkeypatch.setattr(C, "parts_for", lambda *_: parts)
    monkeypatch.setattr(C, "CHUNK_WORDS", 300)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = C.mine_phrases(docs, least=4, longest=5, top=60).collect()
    assert {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got} == plain_phrases(rows, 4, 5, 60)
    assert len(got) == len({(r["lang"], r["rank"]) for r in got}) > 60


def test_phrase_edges(spark, edge_docs, no_docs):
    assert C.mine_phrases(no_docs).count() == 0
    got = C.mine_phrases(edge_docs, least=2).collect()
    assert {r["lang"] for r in got} <= {"en", "de", "fr", "und"} and any(r["phrase"] == "lang wort" and r["a"] == 3000 for r in C.count_stream(edge_docs).selectExpr("phrase", "f as a").collect())


def test_exact_scores_beyond_64_bits(spark):
    stream = [("en", 0, "", 10**13), ("en", 1, "a", 10**12), ("en", 1, "b", 10**12 + 1), ("en", 2, "a b", 10**12)]
    row = C.scored(spark.createDataFrame(stream, "lang string, k int, phrase string, f long")).first()
    assert row["score"] == 1000 * 10**12 * 10**13 // (10**12 * (10**12 + 1))


def plain_search(docs, items, top):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    found = [(d, Counter(term.findall((t or "").translate(UPPER)))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = set()
    for item, text in items:
        asked, scores = Counter(term.findall((text or "").translate(UPPER))), []
        for d, c in found:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, k in asked.items() if c[t])
            if score > 0:
                scores.append((-score, d))
        out |= {(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:top])}
    return out


@pytest.mark.parametrize("rows_each, block", [(1 << 16, 2000), (9, 3)])
def test_search(spark, monkeypatch, rows_each, block):
    rng = random.Random(rows_each)
    words = [f"t{int(rng.expovariate(0.08))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", ".", "'s", "É"]) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(30)] + [(300, None), (301, "  ...")]  # ties beyond the top
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))) for i in range(12)] + [(50, None), (51, "unknown word"), (52, "t1 T1 t1 t2"), (53, docs[3][1])]
    monkeypatch.setattr(S, "SEGMENT_ROWS", rows_each)
    monkeypatch.setattr(S, "BLOCK_QUERIES", block)
    frames = [spark.createDataFrame(r, s) for r, s in ((docs, "doc_id long, text string"), (items, "item_id long, text string"))]
    index = S.build_index(frames[0].repartition(2))
    got = S.search(spark, index, frames[1], top=5).collect()
    assert {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got} == plain_search(docs, items, 5)
    assert index.filter("term is null").count() >= (2 if rows_each > 100 else 18)


def test_pair_bounds_hold_and_tighten(spark):
    rng = np.random.default_rng(4)
    rows = [dict(term=None, ids=list(range(300)), lengths=[50] * 300, df=300, postings=None)]
    for name, size in (("a", 120), ("b", 90), ("c", 200)):
        at = np.sort(rng.choice(300, size, replace=False))
        rows.append(dict(term=name, ids=None, lengths=None, df=size, postings=S._postings(at, rng.integers(1, 400, size))))
    held = S.Segment(rows, 300, 15_000)
    for a, b in (("a", "b"), ("a", "c")):
        most, both, joint = held.pair((a, 7), (b, 3))
        whole = np.zeros(300, np.int64)
        for t in ((a, 7), (b, 3)):
            at, impact = held.impacts(t)
            whole[at] += impact
        assert most == whole.max() <= sum(int(held.impacts(t)[1].max()) for t in ((a, 7), (b, 3)))
        assert (whole[both] == joint).all()
    assert held.pair(("a", 7), ("zz", 5))[0] == held.impacts(("a", 7))[1].max()
    assert S._read_postings(S._postings(np.array([3]), np.array([70_000])), 1)[1].tolist() == [70_000]


def test_search_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "lang"), (None, "w5 w6"), (1, "lang"), (3, None)], "item_id long, text string")
    assert S.search(spark, S.build_index(no_docs), items).count() == 0
    index = S.build_index(edge_docs)
    assert S.search(spark, index, items.limit(0)).count() == 0
    got = S.search(spark, index, items).collect()
    assert Counter(r["item_id"] for r in got) == {1: 2, None: 4}
    assert [r["doc_id"] for r in sorted((r for r in got if r["item_id"] is None), key=lambda r: r["rank"])] == [1, 2, 2, 3]


def test_segments_are_read_alone():
    terms, row = S._terms(pa.array(["Ab cD", None, "é1-2", "AB"], pa.string()))
    assert [t.decode() for t in terms.to_pylist()] == ["ab", "cd", "é1", "2", "ab"] and row.tolist() == [0, 0, 2, 2, 3]
