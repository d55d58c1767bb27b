"""Operators against brute force on small frames, and their defined answers at the edges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from brute import brute_groups, brute_removed, texts_of, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clientpulse.llm import bpe, exact_dedup, jaccard_join, language_id, language_model, ordinal, packing, queries, substring_dedup, warc, weighted_sampling
from clientpulse.session import scratch_path

SF = "/root/testdata/sf0.001"


def mutated(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def near_docs(spark):
    rng = random.Random(5)
    rows, family = [], [f"v{rng.randrange(400)}" for _ in range(150)]
    for i in range(160):
        if i % 3:
            family_words = mutated(rng, family, rng.randrange(0, 7))
        else:
            family_words = [f"u{rng.randrange(300)}" for _ in range(rng.randrange(1, 90))]
        rows.append((i + 1, " ".join(family_words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 900])  # the small one cuts the family's bucket into blocks
def test_jaccard_groups_match_brute_force(near_docs, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(near_docs).collect()}
    assert got == brute_groups(texts_of(near_docs), 4, 85)


def test_jaccard_edges(edge_docs, no_docs):
    rows = jaccard_join.jaccard_groups(edge_docs).collect()
    assert len(rows) == 11
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got[2][1] == got[3][1] == 1 and got[4] == (0, 4) and got[6] == (0, 6) and got[7] == (1, 7)
    assert jaccard_join.jaccard_groups(no_docs).count() == 0
    kept = jaccard_join.drop_near(edge_docs)
    assert kept.columns == edge_docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 4, 5, 6, 7, None, 9, 10}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    roots = {r["node"]: r["root"] for r in jaccard_join.components(edges).collect()}
    assert all(roots[i] == 1 for i in range(2, 41)) and roots[101] == 100


def test_passages_match_brute_force(spark, near_docs):
    rng = random.Random(2)
    shared = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(60):
        own = [f"q{rng.randrange(50)}" for _ in range(rng.randrange(0, 120))]
        at = rng.randrange(len(own) + 1)
        cut = rng.randrange(0, 25)
        rows.append((i * 7, " ".join(own[:at] + (shared[cut:] if i % 2 else []) + own[at:])))
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), near_docs):
        done = substring_dedup.remove_passages(docs, digest=True).collect()
        assert {r["doc_id"]: (r["_n_words"], r["_n_removed"], r["text"]) for r in done} == brute_removed(texts_of(docs))


def test_passage_edges(edge_docs, no_docs):
    done = substring_dedup.drop_passages(edge_docs)
    assert done.columns == edge_docs.columns and done.count() == 11
    got = {r["doc_id"]: r["text"] for r in done.collect()}
    assert got[2] == "" and got[3] == "tail" and got[4] in (None, "") and got[6] == " \t\n"
    assert substring_dedup.drop_passages(no_docs).count() == 0


def test_recipes(edge_docs, no_docs):
    rows = exact_dedup.exact_groups(edge_docs).collect()
    assert len(rows) == 11
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows}
    assert got[1] == (1, 3, True) and got[2] == (1, 3, False)
    assert got[6] == (6, 3, True) and got[4] == (6, 3, False)  # most code points first
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert sorted(str(r["doc_id"]) for r in exact_dedup.drop_exact(edge_docs).collect()) == sorted(map(str, [1, 3, 6, 7, None, 9, 10]))


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(1, "x y"), (1, "x y"), (None, "xy"), (3, "q")], [(1, "xy"), (3, "q")]),
        ([(None, "a"), (None, " a"), (None, "b")], [(None, "a"), (None, "b")]),
        ([(1, "a"), (1, "b"), (0, "b")], [(0, "b"), (1, "a")]),
        ([(2, "a"), (2, "a "), (2, "a")], [(2, "a")]),
    ],
)
def test_one_row_of_a_group_stays(spark, rows, want):
    got = exact_dedup.drop_exact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"].replace(" ", "")) for r in got), key=str) == sorted(want, key=str)


def test_a_shared_identifier_gets_a_new_seed(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one text"), (2, "other text"), (3, "one  text")], "doc_id long, text string")
    assert sorted(r["group_size"] for r in exact_dedup.exact_groups(docs).collect()) == [1, 2, 2]


def test_chunks_depend_on_own_bytes_alone():
    rng = np.random.default_rng(1)
    a, b = rng.integers(33, 120, 60_000).astype(np.uint8), np.full(50_000, 65, np.uint8)
    alone = exact_dedup.chunk_ends(a, np.array([0, len(a)]))[0]
    after = exact_dedup.chunk_ends(np.concatenate([b, a]), np.array([0, len(b), len(a) + len(b)]))
    assert (after[1] - len(b) == alone).all() and len(alone) > 20
    assert np.diff(after[0], prepend=0).max() <= exact_dedup.LONGEST


def test_bpe_matches_the_library(spark, edge_docs, no_docs):
    library, mine = Tokenizer.from_file(bpe.VOCABULARY), bpe.Encoder.of(bpe.VOCABULARY)
    rng = random.Random(1)
    hard = ["".join(rng.choice("abcdeinghtorsäßΣ'. 1\n") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    hard += [t for _, t in texts_of(edge_docs)] + ["a" * 400, "<|endoftext|>x<|startoftext|>", "ΟΔΟΣ İ é \x1d a\x85b"]
    for text in hard:
        ids = library.encode(text, add_special_tokens=False).ids
        parts = mine.parts(text)
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == ids
        assert mine.decode_parts(parts).decode() == library.decode(ids, skip_special_tokens=False)
    coded = bpe.encode(edge_docs)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()}[4] == []
    assert bpe.decode(coded).count() == 11 and bpe.token_digests(no_docs).count() == 0


def test_packing(spark, edge_docs, no_docs):
    for docs, rows in ((edge_docs, 11), (spark.read.parquet(f"{SF}/documents.parquet"), 200)):
        got = packing.pack(docs).collect()
        assert len({(r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in got}) == len(got) >= rows
        bins = {}
        for r in got:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= packing.CAPACITY
        bound = packing.lower_bound(np.array([r["length"] for r in got]))
        assert bound <= len(bins) <= bound + 1
    assert packing.pack(no_docs).count() == 0


def test_uncertified_groups_exchange_documents(spark):
    rng = random.Random(4)
    lengths = [rng.randrange(1, 4096) for _ in range(3000)]
    pieces = spark.createDataFrame([(i, 0, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, copy long, length long")
    placed = packing.pack_lengths(pieces, group=200).collect()
    used = len({r["sequence_id"] for r in placed})
    alone = sum(packing.best_fit(np.array(lengths[i : i + 200]))[0].max() + 1 for i in range(0, 3000, 200))
    bound = packing.lower_bound(np.array(lengths))
    assert len(placed) == 3000 and bound <= used < alone


def brute_bound(lengths, capacity):
    return -(-sum(lengths) // capacity)


def test_bounds():
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3
    assert packing.lower_bound(np.array([34, 34, 34]), 100) == 2
    rng = random.Random(1)
    for _ in range(200):
        own = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 40))]
        assert brute_bound(own, 100) <= packing.lower_bound(np.array(own), 100) <= packing.best_fit(np.array(own), 100)[0].max() + 1


def test_warc_round_trip_with_magic_in_payloads(spark):
    trap = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u v", ""), (5, "http://c", "a" + trap + trap + "z"), (6, "http://d", warc.MAGIC), (7, "http://e", "é" * 5000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, file string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert set(got) == set(range(1, 8))
    for page, _, html in rows:
        payload = (html or "").encode()
        assert got[page]["payload_bytes"] == len(payload) and got[page]["payload_digest"] == warc._digest(payload)
    assert (got[1]["record_type"], got[1]["refers_to"], got[2]["record_type"]) == ("revisit", 2, "response")
    assert (got[3]["record_type"], got[3]["refers_to"]) == ("revisit", 4)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_rows_with_one_id(spark):
    """An id with several payloads, as a revisit and as what a revisit refers to."""
    for rows, want in (
        ([(1, "aaa"), (1, "bbbbb"), (2, "aaa")], [(1, 3, "revisit", 2), (1, 5, "response", None), (2, 3, "response", None)]),
        ([(5, "aaa"), (5, "cc"), (2, "aaa")], [(2, 3, "revisit", 5), (5, 2, "response", None), (5, 3, "response", None)]),
        ([(None, "aaa"), (1, "aaa"), (1, "aaa")], [(1, 3, "response", None), (1, 3, "response", None), (None, 3, "response", None)]),
    ):
        pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
        got = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_splits(spark):
    """The same records wherever Spark cuts the archives."""
    path = scratch_path(spark, "archives")
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit(warc.MAGIC), F.repeat(F.col("id").cast("string"), 40)).alias("html"))
    warc.write_archives(pages.coalesce(2), path)
    whole = sorted(map(str, warc.read_archives(spark, path).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert sorted(map(str, warc.read_archives(spark, path).collect())) == whole and len(whole) == 300
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fingerprints(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = weighted_sampling.fingerprints(docs).collect()
    by_id = {r["doc_id"]: r for r in rows}
    ordered = sorted(texts_of(docs))
    errors = []
    for i, (doc, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        part = len(text) // 4
        edited = text[: len(text) - part] + after[:part]
        assert by_id[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and by_id[doc]["n_chars"] == len(text)

        def terms(t):
            w = ["", *[x.decode() for x in words(t)], ""]
            return Counter(zip(w, w[1:], strict=False))

        a, b = terms(text), terms(edited)
        errors.append(by_id[doc]["near_edited"] - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12
    edges = weighted_sampling.fingerprints(edge_docs).collect()
    assert len(edges) == 11 and len({r["fingerprint"] for r in edges if r["doc_id"] in (1, 2)}) == 1
    assert weighted_sampling.fingerprints(no_docs).count() == 0


def test_fingerprints_build_no_table_of_terms(spark):
    """Terms stay inside their text's row, and the samples are those of terms counted and dealt over bins by a table."""
    texts = ["a b a b a b", "one two  three\tone two", "", " ", "x " * 300 + "y", "b a b a b"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = weighted_sampling.fingerprints(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    rows = {r["doc_id"]: r for r in got.collect()}
    pairs = [(i, a, b) for i, text in enumerate(texts) for w in [["", *text.split(), ""]] for a, b in zip(w, w[1:], strict=False)]
    terms = spark.createDataFrame(pairs, "doc_id long, a string, b string").groupBy("doc_id", F.xxhash64("a", "b").alias("term")).agg(F.count(F.lit(1)).alias("weight"))
    values = terms.groupBy("doc_id", F.pmod("term", F.lit(weighted_sampling.BINS)).cast("int").alias("bin")).agg(F.min(weighted_sampling.sampled(F.col("term"), F.col("weight"))).alias("value"))
    want = {i: "" for i in range(len(texts))}
    for r in values.withColumn("digits", F.lpad(F.hex(F.xxhash64("value")), 16, "0")).orderBy("doc_id", "bin").collect():
        want[r["doc_id"]] += f"{r['bin']:02x}{r['digits'][:8].lower()}"
    assert {i: r["fingerprint"] for i, r in rows.items()} == want


def test_grades_on_held_out_rows(spark, edge_docs, no_docs):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = ordinal.fit_on_labels(docs, labels.where("doc_id % 3 <> 0"))
    assert (np.diff(model.thresholds) > 0).all()
    rated = ordinal.ratings(labels).where("doc_id % 3 = 0 and grade is not null")
    rows = ordinal.grade(docs, model).join(rated, "doc_id").collect()
    means = [np.mean([r["expected_grade"] for r in rows if r["grade"] == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    assert np.mean([r["kept"] for r in rows if r["grade"] == 2]) > 0.97
    assert np.mean([r["kept"] for r in rows if r["grade"] < 2]) < 0.6
    # tail probabilities are those of the rated rows
    assert abs(np.mean([r["p_clean"] for r in rows]) - np.mean([r["grade"] == 2 for r in rows])) < 0.1
    assert ordinal.grade(edge_docs, model).count() == 11 and ordinal.grade(no_docs, model).count() == 0
    both = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 1), (3, None, None), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["grade"] for r in ordinal.ratings(both).collect()} == {1: 0, 2: 0, 3: None, 4: 2}
    none = ordinal.fit_on_labels(no_docs, labels.limit(0))
    assert all(r["kept"] for r in ordinal.grade(edge_docs, none).collect())


def test_languages(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.document_rows(docs)
    odd = rows.where("id % 2 = 1").select("id", "text", F.col("declared").alias("label"))
    got = {r["id"]: r for r in language_id.identify(rows.withColumn("declared", F.lit(None).cast("string")), odd).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert np.mean([got[d]["language"] == truth[d] for d in truth if d % 2 == 0]) > 0.97
    edges = language_id.identify(language_id.document_rows(edge_docs), odd).collect()
    assert len(edges) == 11 and not any(r["kept"] for r in edges if r["id"] in (4, 5, 6))
    kept = language_id.drop_rejected(edge_docs)
    assert kept.columns == edge_docs.columns and language_id.drop_rejected(no_docs).count() == 0


def test_other_evidence_decides_a_short_text(spark, near_docs):
    labelled = spark.createDataFrame([(i, "the and of with that " * 9, "en") for i in range(9)] + [(i + 9, "und der die das nicht " * 9, "de") for i in range(9)], "id long, text string, label string")
    hosts = [(100 + i, "und der die das nicht " * 5, "de", "de", "h.de") for i in range(60)] + [(200 + i, "the and of with that " * 5, "en", "com", "h.com") for i in range(60)]
    unsure = [(1, "ok", None, "de", "h.de"), (2, "ok", None, "com", "h.com"), (3, "ok", None, "de", "new.de"), (4, "ok", "en", None, None)]
    rows = spark.createDataFrame(hosts + unsure, "id long, text string, declared string, suffix string, host string")
    got = {r["id"]: r["language"] for r in language_id.identify(rows, labelled).where("id < 10").collect()}
    assert got == {1: "de", 2: "en", 3: "de", 4: "en"}


def test_page_evidence(spark):
    page = spark.createDataFrame([(1, "https://u@www.x.de:80/a", '<HTML class=a lang="de-AT"><script>var b</script><p>Gr&uuml;n</p>'), (2, None, None)], "page_id long, url string, html string")
    row = {r["id"]: r for r in language_id.page_rows(page).collect()}
    assert (row[1]["declared"], row[1]["suffix"], row[1]["host"]) == ("de-AT", "de", "www.x.de") and "var" not in row[1]["text"]


def test_language_model(spark, edge_docs, no_docs):
    rows = queries.op5_pitman_yor(spark, SF).collect()
    texts = dict(texts_of(spark.read.parquet(f"{SF}/documents.parquet")))
    import zlib

    held = {d for d in texts if zlib.crc32(str(d).encode()) % 7 == 2}
    counts = Counter(w for d, t in texts.items() if d not in held for w in [*(x.lower() for x in words(t)), b""])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        tokens = [*(x.lower() for x in words(texts[r["doc_id"]])), b""]
        want = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        assert r["held_out"] == (r["doc_id"] in held) and r["n_tokens"] == len(tokens) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens) and abs(r["base_score"] - want) < 1e-6 * max(1, abs(want))
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    assert language_model.score_documents(edge_docs, F.lit(False)).count() == 11
    assert all(r["score"] <= 0 for r in language_model.score_documents(edge_docs, F.lit(True)).collect())
    assert language_model.score_documents(no_docs, F.lit(False)).count() == 0
