"""Ordinal quality grades by a cumulative-link model on hashed text.

P(grade > k) = sigmoid(w . x - threshold_k), one weight vector for all thresholds, and thresholds in order. x are hashed words, each at
most once per text, as they stand between white space and as runs of letters, and a few shape measures. The model is fitted on at most ``FIT_ROWS`` rated rows, those
whose hashed id is smallest; scoring reads every row and moves none.

Ratings count the faults that a label names: 2 for none, 1 for poor or toxic, 0 for both. Each fault takes one grade off, so a text of a
lower grade has more of what lowers the score, and one weight per word can order them; toxic, poor and good as three grades could
not, since most toxic texts are well written. Of several labels of a text the lowest grade counts. Rows without a rating don't take part
in fitting. Fitting is unweighted, so tail probabilities are those of the rated population. With fewer than two grades among the ratings
every row gets the one grade (2 where there is none) with probability 1. Null text is empty. Rows are answered one by one, repeated ids included. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.texts import SPACES, Words, byte_column, sliced

FIT_ROWS = 6_000
BUCKETS, SHAPES, GRADES = 1 << 16, 6, 3
STEPS, RATE, DECAY = 400, 0.2, 3e-4
LEAST_TEXTS = 5
_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
# words between white space, scaled to unit length, and runs of letters and digits, of which a single one may decide
KINDS = ((SPACES, 0.5), (_APART, 0.4))
HASHED = len(KINDS) * BUCKETS
KEEP_TAIL = 0.5  # a document is selected when no fault is at least as likely as one


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of every nonzero feature; rows have about unit length whatever the text's length."""
    n = batch.num_rows
    rows, columns, values = [], [], []
    for place, (gap, power) in enumerate(KINDS):
        words = Words(batch.column("text"), lower=True, gap=gap)
        pair = np.unique(words.row * np.int64(BUCKETS) + (words.hashes % np.uint64(BUCKETS)).astype(np.int64))
        row = pair // BUCKETS
        rows.append(row)
        columns.append(pair % BUCKETS + place * BUCKETS)
        values.append(1 / np.bincount(row, minlength=n)[row] ** power)
        if place == 0:
            count, distinct = np.diff(words.first), np.bincount(row, minlength=n)
    data, offsets = byte_column(batch.column("text"))

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)

    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    shapes = np.stack(
        [
            np.ones(n),
            share(letter),
            share((data >= 48) & (data <= 57)),
            share((data == 10)),
            distinct / np.maximum(count, 1),
            np.log1p(count) / 10,
        ],
        axis=1,
    )
    own = np.repeat(np.arange(n), SHAPES)
    return np.concatenate([*rows, own]), np.concatenate([*columns, HASHED + np.tile(np.arange(SHAPES), n)]), np.concatenate([*values, shapes.ravel()])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        row, column, value = features(batch)
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(1, batch.num_rows))
        columns, values = np.split(column[order], cuts), np.split(value[order], cuts)
        yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["grade", "columns", "values"])


def fit(rated: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on ``rated`` (doc_id, text, grade). The driver gets the features of at most ``rows`` texts."""
    sample = rated.where("grade is not null").orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(rows)
    got = sample.select("text", F.col("grade").cast("int").alias("grade")).mapInArrow(_sparse, "grade int, columns array<int>, values array<float>").toArrow()
    grades = got.column("grade").to_numpy()
    present = np.unique(grades)
    if len(present) < 2:
        only = int(present[0]) if len(present) else GRADES - 1
        return Model(np.zeros(HASHED + SHAPES), np.where(np.arange(GRADES - 1) < only, -1e3, 1e3))
    lists = got.column("columns").combine_chunks()
    row = np.repeat(np.arange(len(grades)), np.diff(lists.offsets.to_numpy()))
    column, value = lists.flatten().to_numpy(), got.column("values").combine_chunks().flatten().to_numpy().astype(float)
    seen = np.bincount(column, minlength=HASHED + SHAPES) >= LEAST_TEXTS  # rarer ones would only name single texts
    row, column, value = row[seen[column]], column[seen[column]], value[seen[column]]
    above = (grades[:, None] > np.arange(GRADES - 1)[None, :]).astype(float)
    free = np.concatenate([np.zeros(HASHED + SHAPES), [0.0], np.full(GRADES - 2, np.log(0.5))])
    first, second = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, STEPS + 1):
        model = _model(free)
        score = np.bincount(row, weights=value * free[column], minlength=len(grades))
        slope = (model.tails(score) - above) / len(grades)
        gradient = np.empty_like(free)
        gradient[: HASHED + SHAPES] = np.bincount(column, weights=value * slope.sum(1)[row], minlength=HASHED + SHAPES) + DECAY * free[: HASHED + SHAPES]
        by_threshold = -slope.sum(0)
        later = np.cumsum(by_threshold[::-1])[::-1]
        gradient[HASHED + SHAPES] = later[0]
        gradient[HASHED + SHAPES + 1 :] = later[1:] * np.exp(free[HASHED + SHAPES + 1 :])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        free -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return _model(free)


def _model(free: np.ndarray) -> Model:
    """Thresholds are a first one and positive steps, so they stay in order."""
    rest = free[HASHED + SHAPES :]
    return Model(free[: HASHED + SHAPES], rest[0] + np.concatenate([[0.0], np.cumsum(np.exp(rest[1:]))]))


def _graded(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            row, column, value = features(batch)
            tails = model.tails(np.bincount(row, weights=value * model.weights[column], minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, -1])], ["doc_id", "expected_grade", "p_not_both", "p_clean"])

    return run


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade (0 to 2), p_not_both = P(grade > 0), p_clean = P(grade > 1), kept."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    graded = texts.mapInArrow(_graded(model), "doc_id long, expected_grade double, p_not_both double, p_clean double")
    return graded.withColumn("kept", F.col("p_clean") >= KEEP_TAIL)


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 2 less one for each fault the label names; null where it names neither quality nor toxicity."""
    faults = (F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int") + (F.coalesce(F.col("quality"), F.lit(1)) == 0).cast("int")
    value = F.when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), F.lit(GRADES - 1) - faults)
    return labels.groupBy("doc_id").agg(F.min(value).alias("grade"))


def fit_on_labels(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    rated = ratings(labels).where("grade is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return fit(docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id"), rows)
