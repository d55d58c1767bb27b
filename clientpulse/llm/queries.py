"""The operators of this folder over the given tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientpulse.llm.bpe import token_digests
from clientpulse.llm.collocations import mine_phrases
from clientpulse.llm.exact_dedup import exact_groups
from clientpulse.llm.jaccard_join import jaccard_groups
from clientpulse.llm.language_id import document_rows, identify, page_rows
from clientpulse.llm.language_model import score_documents
from clientpulse.llm.lexical_search import build_index, search
from clientpulse.llm.ordinal import fit_on_labels, grade
from clientpulse.llm.packing import pack
from clientpulse.llm.substring_dedup import remove_passages
from clientpulse.llm.texts import table
from clientpulse.llm.token_counts import over_budget, prefix_counts
from clientpulse.llm.warc import round_trip
from clientpulse.llm.weighted_sampling import fingerprints


def op1_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages together, so that priors rest on both; a page has the id -1 - page_id."""
    docs = document_rows(table(spark, sf_dir, "documents"))
    pages = page_rows(table(spark, sf_dir, "pages")).withColumn("id", -1 - F.col("id"))
    found = identify(docs.unionByName(pages), docs.select("id", "text", F.col("declared").alias("label")))
    return found.withColumnRenamed("id", "doc_id").withColumn("posterior", F.round("posterior", 9))


def op2_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op3_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = round_trip(table(spark, sf_dir, "pages"))
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade(docs, fit_on_labels(docs, table(spark, sf_dir, "labels")))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    done = score_documents(table(spark, sf_dir, "documents"), remainder == 2)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return done.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("text").alias("kept_sha256"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op10_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = over_budget(prefix_counts(table(spark, sf_dir, "documents")))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "prefix_steps")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"))
    return search(spark, index, table(spark, sf_dir, "benchmark"))


WHITE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op3_warc_chain": """
with t as (select page_id, encode(coalesce(html, '')) as payload, coalesce(html, '') as html from pages),
k as (select page_id, octet_length(payload) as payload_bytes, sha1(html) as hex, max(page_id) over (partition by html) as top from t),
bits as (select *, list_transform(range(0, 40), lambda i: lpad(bin(cast('0x' || substr(hex, i + 1, 1) as int)), 4, '0')) as b from k),
text as (select *, list_aggregate(b, 'string_agg', '') as s from bits)
select page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: cast(substr(s, cast(i * 5 + j + 1 as int), 1) as int) * cast(power(2, 4 - j) as int)))::int, 1)), 'string_agg', '') as payload_digest,
       case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id < top then top end as refers_to
from text""",
    "op10_chunk_recipes": f"""
with t as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '{WHITE}', '', 'g') as bare from documents),
k as (select *, first_value(doc_id) over (partition by bare order by length(text) desc, doc_id) as keep_id, count(*) over (partition by bare) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(bare) as text_sha256 from k""",
    "op7_substring_dedup": f"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as words from documents),
w as (select doc_id, unnest(range(1, len(words) - 48)) as p, words from t where len(words) >= 50),
h as (select doc_id, p, md5(array_to_string(list_slice(words, p, p + 49), ' ')) as h from w),
f as (select h, min(doc_id) as first_doc from h group by h),
gone as (select distinct doc_id, unnest(range(p, p + 50)) as p from h join f using (h) where first_doc < doc_id),
lost as (select doc_id, list(p) as lost from gone group by doc_id)
select t.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(len(lost), 0) as bigint) as n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda x, i: not coalesce(list_contains(lost, i), false)), ' '), '')) as kept_sha256
from t left join lost using (doc_id)""",
    "op8_ngram_jaccard": f"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws from documents),
s as (select distinct doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') as g
      from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from t where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from s group by doc_id),
met as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all),
links as (select a, b from met join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * k >= 85 * (p.n + q.n - k)),
reached as (select doc_id, doc_id as node from t union select doc_id, b from reached join links on a = node)
select doc_id, coalesce(any_value(n), 0) as n_shingles, min(node) as component_id from reached left join sizes using (doc_id) group by doc_id""",
    "op12_collocations": r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
starts as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
grams as (select lang, cast(k as int) as k, array_to_string(list_slice(ws, i, i + k - 1), ' ') as phrase
          from starts, (select unnest(range(1, 6)) as k) where i + k - 1 <= len(ws)),
totals as (select lang, count(*) as n from grams where k = 1 group by lang),
f as (select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 100),
cuts as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws, unnest(range(1, k)) as c from f where k > 1),
parts as (select cuts.lang, cuts.k, cuts.phrase, a, c, h.f as l, t.f as r, n,
            (1000::hugeint * a * n) // (h.f::hugeint * t.f) as score
          from cuts join f h on h.lang = cuts.lang and h.phrase = array_to_string(ws[1:c], ' ')
          join f t on t.lang = cuts.lang and t.phrase = array_to_string(ws[c + 1:], ' ') join totals on totals.lang = cuts.lang),
best as (select * from parts qualify row_number() over (partition by lang, phrase order by score, c) = 1),
absorbed as (select lang, phrase, max(a) as longer from (
  select lang, array_to_string(ws[:-2], ' ') as phrase, a from (select distinct lang, ws, a, k from cuts) where k > 2 union all
  select lang, array_to_string(ws[2:], ' '), a from (select distinct lang, ws, a, k from cuts) where k > 2) group by all),
kept as (select best.* from best left join absorbed using (lang, phrase) where longer is null or longer < a)
select lang, cast(row_number() over (partition by lang order by score desc, a desc, phrase) as bigint) as rank, phrase,
       cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from kept qualify rank <= 2000""",
    "op13_lexical_search": r"""
with lower_docs as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
d as (select doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from lower_docs),
q as (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
lens as (select doc_id, count(*) as n from d group by doc_id),
sizes as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from lens),
m as (select doc_id, 75 + (25 * n * n_docs) // n_terms as m from lens, sizes),
tf as (select term, doc_id, count(*) as tf from d where term in (select term from q) group by all),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, sizes group by term, n_docs),
asked as (select item_id, term, count(*) as times from q group by all),
scores as (select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
           from asked join tf using (term) join w using (term) join m using (doc_id) group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
from scores where score > 0 qualify rank <= 20""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_fusion,
        op2_weighted_sampling,
        op3_warc_chain,
        op4_ordinal_quality,
        op5_pitman_yor,
        op6_best_fit_packing,
        op7_substring_dedup,
        op8_ngram_jaccard,
        op9_bpe_automaton,
        op10_chunk_recipes,
        op11_token_counts,
        op12_collocations,
        op13_lexical_search,
    )
}
