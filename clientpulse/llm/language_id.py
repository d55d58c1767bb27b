"""Language identification by fusing evidence: text, declared language, address suffix and host.

Text likelihoods come from hashed letter trigrams with add-one smoothing, fitted on at most ``FIT_ROWS`` labelled rows (those whose
hashed id is smallest). Everything else covers every row: soft language counts per host, per suffix and overall, found by grouped
aggregation of the text posteriors, give host priors smoothed towards their suffix and that towards the whole; counts of declared
against read languages give P(declared | language). The posterior is prior x text likelihood x declared likelihood, normalised.

A row is rejected when fewer than half of its characters other than white space are letters, or when no language reaches half of the
posterior. Null or empty text has no letters and is rejected. Null declared, suffix or host is missing evidence: the first gives no
factor, the others fall back to the next wider prior. Without any labelled row, rows are judged by their letters alone and the language
is null. Rows are answered one by one, repeated keys included. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.texts import byte_column, sliced
from clientpulse.session import materialize

FIT_ROWS, BUCKETS = 4_000, 1 << 15
KAPPA = 20.0  # rows that the wider prior counts for
DECLARED_WEIGHT = 5.0  # declarations that smoothing counts for
CERTAIN = 12.0  # a text's log likelihood ratio counts up to this, so that other evidence can speak
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each letter trigram (runs of other bytes count as one gap each), and each row's share of letters."""
    data, offsets = byte_column(column)
    letter = _LETTER[data]
    value = np.where(letter, _LOWER[data], 0).astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (row[1:] == row[:-1])
    value, own = value[keep], row[keep]
    visible = (data > 32) & (data != 127)
    sums = [np.bincount(row[m], minlength=len(offsets) - 1) for m in (letter, visible)]
    code = (value[:-2] << np.uint32(16)) | (value[1:-1] << np.uint32(8)) | value[2:]
    same = own[:-2] == own[2:]
    bucket = (code[same] * np.uint32(0x9E3779B1)) >> np.uint32(17)
    return own[:-2][same], bucket.astype(np.int64), sums[0] / np.maximum(sums[1], 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        row, bucket, _ = trigrams(batch.column("text"))
        names, code = np.unique(np.array(batch.column("label").to_pylist(), object).astype(str), return_inverse=True)
        key, n = np.unique(code[row] * np.int64(BUCKETS) + bucket, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(names[key // BUCKETS].tolist(), pa.string()), pa.array(key % BUCKETS), pa.array(n)], ["label", "bucket", "n"])


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram probabilities, from ``labelled`` (id, text, label); the driver gets languages x buckets counts."""
    usable = labelled.where("label is not null and text is not null").withColumn("_key", F.xxhash64("id", "text"))
    # keys are chosen first, at most ``rows`` of them, and texts are read where they lie
    chosen = usable.select("_key").distinct().orderBy("_key").limit(rows)
    sample = usable.join(F.broadcast(chosen), "_key", "left_semi").select("text", "label")
    got = sample.mapInArrow(_counted, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["label"].unique())
    counts = np.ones((len(languages), BUCKETS))
    counts[[languages.index(x) for x in got["label"]], got["bucket"].astype(int)] += got["n"]
    return languages, np.log(counts / counts.sum(1, keepdims=True)) if languages else counts


def _read(languages: list[str], table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(languages)
        for batch in sliced(batches, "text"):
            row, bucket, letters = trigrams(batch.column("text"))
            if n:
                sums = np.stack([np.bincount(row, weights=table[k][bucket], minlength=batch.num_rows) for k in range(n)], axis=1)
                sums = np.maximum(sums - sums.max(1, keepdims=True), -CERTAIN)
            else:
                sums = np.zeros((batch.num_rows, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * n, pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "declared", "suffix", "host")), lists, pa.array(letters)], ["id", "declared", "suffix", "host", "loglik", "letters"])

    return run


def _shares(counts: list[Column], wider: list[Column], weight: float) -> list[Column]:
    total = sum(counts, F.lit(0.0))
    return [(c + weight * w) / (total + weight) for c, w in zip(counts, wider, strict=True)]


def identify(rows: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """id, language, posterior, text_language, letters, kept for ``rows`` (id, text, declared, suffix, host).

    Host and suffix counts are partial sums per task; their join back lets Spark split a hot host.
    """
    languages, model = fit(labelled, fit_rows)
    n = len(languages)
    texts = rows.select(*(F.col(c).cast("string" if c != "id" else "long").alias(c) for c in ("id", "text", "declared", "suffix", "host")))
    read = texts.mapInArrow(_read(languages, model), "id long, declared string, suffix string, host string, loglik array<double>, letters double")
    if not n:
        return read.select("id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_language"), "letters", (F.col("letters") >= 0.5).alias("kept"))
    read = materialize(read.withColumn("declared", F.lower(F.substring_index(F.trim("declared"), "-", 1))), "read")
    soft = [F.exp(F.col("loglik")[k]) for k in range(n)]
    total = sum(soft, F.lit(0.0))
    marked = read.where("letters >= 0.5").select("declared", "suffix", "host", *((soft[k] / total).alias(f"s{k}") for k in range(n)))
    sums = [F.sum(f"s{k}").alias(f"s{k}") for k in range(n)]
    by_host = materialize(marked.groupBy("host", "suffix").agg(*sums), "hosts")
    overall = by_host.agg(*sums).first()
    everywhere = np.array([overall[k] or 0.0 for k in range(n)]) + 1.0
    everywhere /= everywhere.sum()
    by_suffix = by_host.where("suffix is not null").groupBy("suffix").agg(*sums)
    suffix_shares = _shares([F.col(f"s{k}") for k in range(n)], [F.lit(float(x)) for x in everywhere], KAPPA)
    suffixes = by_suffix.select(F.col("suffix").alias("_suffix"), *(c.alias(f"w{k}") for k, c in enumerate(suffix_shares)))
    hosts = by_host.where("host is not null").join(suffixes, F.col("suffix") == F.col("_suffix"), "left")
    wider = [F.coalesce(F.col(f"w{k}"), F.lit(float(everywhere[k]))) for k in range(n)]
    host_shares = _shares([F.col(f"s{k}") for k in range(n)], wider, KAPPA)
    hosts = hosts.select(F.col("host").alias("_host"), F.col("suffix").alias("_of"), *(c.alias(f"h{k}") for k, c in enumerate(host_shares)))
    known = F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(F.when(F.col("declared").isNotNull(), "other"))
    said = {r["said"]: [r[f"s{k}"] for k in range(n)] for r in marked.groupBy(known.alias("said")).agg(*sums).where("said is not null").collect()}
    values = [*languages, "other"]  # what can be declared; a bounded table
    confusion = np.array([said.get(v, [0.0] * n) for v in values]) + DECLARED_WEIGHT / len(values)
    confusion = np.log(confusion / confusion.sum(0, keepdims=True))
    declared = [F.coalesce(F.element_at(F.create_map(*(x for v, p in zip(values, confusion[:, k], strict=True) for x in (F.lit(v), F.lit(float(p))))), known), F.lit(0.0)) for k in range(n)]
    joined = read.join(hosts, (F.col("host") == F.col("_host")) & F.col("suffix").eqNullSafe(F.col("_of")), "left").join(suffixes, F.col("suffix") == F.col("_suffix"), "left")
    prior = [F.ln(F.coalesce(F.col(f"h{k}"), F.col(f"w{k}"), F.lit(float(everywhere[k])))) for k in range(n)]
    joined = joined.withColumn("fused", F.array(*(F.col("loglik")[k] + declared[k] + prior[k] for k in range(n))))
    top = F.array_max("fused")
    names = F.array(*map(F.lit, languages))
    best = F.element_at(names, F.array_position("fused", top).cast("int"))
    posterior = 1.0 / F.aggregate("fused", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    textual = F.element_at(names, F.array_position("loglik", F.array_max("loglik")).cast("int"))
    out = joined.select("id", best.alias("language"), posterior.alias("posterior"), textual.alias("text_language"), "letters")
    return out.withColumn("kept", (F.col("letters") >= 0.5) & (F.col("posterior") >= 0.5))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as evidence: the declared language is their own, the host their source; they have no address."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as evidence: the html element's language, the last label of the host and the host; text is what tags leave."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>|&[a-z]+;", " ")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return pages.select(F.col("page_id").alias("id"), bare.alias("text"), F.when(declared != "", declared).alias("declared"), F.element_at(F.split(host, r"\."), -1).alias("suffix"), host.alias("host"))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns; a document without id stays."""
    rows = document_rows(docs)
    gone = identify(rows, rows.select("id", "text", F.col("declared").alias("label"))).where("not kept").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
