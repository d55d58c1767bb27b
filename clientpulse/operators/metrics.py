"""Binary classification metrics and curves (M), grouped by any columns such as model, fold or product.

Rows are first reduced to one per distinct score with its positives and negatives. All ranking metrics are then a single
aggregation over running totals of that histogram: tied scores count as one point, and no score-ordered window ever
runs over a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientpulse.operators.ordered import running_totals

# The reported F-beta weights.
BETAS = {
    "f1_1score": 1.1,
    "f1_2score": 1.2,
    "f1_3score": 1.3,
    "f1_4score": 1.4,
    "f1_5score": 1.5,
    "f1_6score": 1.6,
    "f2_score": 2.0,
    "f3_score": 3.0,
    "f4_score": 4.0,
}
WEIGHTED_BETAS = {"f2_score_weighted": 2.0, "f3_score_weighted": 3.0, "f4_score_weighted": 4.0}


def _or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def decide(df: DataFrame, score: str, threshold: float, pred: str = "pred") -> DataFrame:
    """1 where the score is strictly above the threshold."""
    return df.withColumn(pred, F.when(F.col(score) > threshold, 1).otherwise(0))


def confusion_counts(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """``tn, fp, fn, tp`` per group."""

    def cell(actual: int, guess: int) -> Column:
        return F.count_if((F.col(y) == actual) & (F.col(pred) == guess))

    cells = [cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")]
    return df.groupBy(*by).agg(*cells)


def confusion(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix in rows: ``actual, predicted, n, row_pct``."""
    counts = confusion_counts(df, y, pred, by)
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("actual"),
                F.lit(g).alias("predicted"),
                F.col(name).alias("n"),
                _or_zero(100.0 * F.col(name), F.col(first) + F.col(second)).alias("row_pct"),
            )
            for a, g, name, first, second in (
                (0, 0, "tn", "tn", "fp"),
                (0, 1, "fp", "tn", "fp"),
                (1, 0, "fn", "fn", "tp"),
                (1, 1, "tp", "fn", "tp"),
            )
        ]
    )
    return counts.select(*by, F.inline(cells))


def _class_terms(beta: float = 1.0) -> dict[str, tuple[Column, Column, Column]]:
    """Precision, recall and F-beta of class 0 and class 1 from the confusion counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    b2 = float(beta) ** 2

    def terms(hit: Column, false_hit: Column, miss: Column) -> tuple[Column, Column, Column]:
        f = _or_zero((1 + b2) * hit, (1 + b2) * hit + b2 * miss + false_hit)
        return _or_zero(hit, hit + false_hit), _or_zero(hit, hit + miss), f

    return {"0": terms(tn, fn, fp), "1": terms(tp, fp, fn)}


def threshold_columns() -> dict[str, Column]:
    """All threshold metrics as expressions over ``tn, fp, fn, tp``."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, fn + tp
    n = n0 + n1
    (p0, r0, f0), (p1, r1, f1) = _class_terms()["0"], _class_terms()["1"]
    accuracy = _or_zero(tp + tn, n)

    def weighted(zero: Column, one: Column) -> Column:
        return _or_zero(n0 * zero + n1 * one, n)

    out = {
        "accuracy": accuracy,
        "balanced_accuracy": (r0 + r1) / 2,
        "f1": f1,
        "f1_micro": accuracy,
        "f1_macro": (f0 + f1) / 2,
        "f1_weighted": weighted(f0, f1),
        "precision": p1,
        "precision_micro": accuracy,
        "precision_macro": (p0 + p1) / 2,
        "precision_weighted": weighted(p0, p1),
        "recall": r1,
        "recall_micro": accuracy,
        "recall_macro": (r0 + r1) / 2,
        "recall_weighted": weighted(r0, r1),
        "matthews_corrcoef": _or_zero(
            tp.cast("double") * tn - fp.cast("double") * fn,
            F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn)),
        ),
        "fpr": _or_zero(fp, n0),
        "fnr": _or_zero(fn, n1),
    }
    out |= {name: _class_terms(beta)["1"][2] for name, beta in BETAS.items()}
    out |= {
        name: weighted(_class_terms(beta)["0"][2], _class_terms(beta)["1"][2]) for name, beta in WEIGHTED_BETAS.items()
    }
    return out


def threshold_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    counts = confusion_counts(df, y, pred, by)
    return counts.select(*by, *[c.alias(name) for name, c in threshold_columns().items()])


def report(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Classification report in rows: per class, macro and weighted average."""
    counts = confusion_counts(df, y, pred, by)
    n0, n1 = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    zero, one = _class_terms()["0"], _class_terms()["1"]
    macro = [(a + b) / 2 for a, b in zip(zero, one)]
    mean = [_or_zero(n0 * a + n1 * b, n0 + n1) for a, b in zip(zero, one)]
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                terms[0].alias("precision"),
                terms[1].alias("recall"),
                terms[2].alias("f1"),
                support.alias("support"),
            )
            for label, terms, support in (
                ("0", zero, n0),
                ("1", one, n1),
                ("macro avg", macro, n0 + n1),
                ("weighted avg", mean, n0 + n1),
            )
        ]
    )
    return counts.select(*by, F.inline(rows))


def score_histogram(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per group and distinct score: ``score, pos, neg`` and, with scores ascending, ``*_run`` and ``*_all``."""
    counts = df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    return running_totals(counts, by, ["score"], ["pos", "neg"])


def _at_or_above() -> tuple[Column, Column]:
    """True and false positives when every score at or above the row's is called positive."""
    return (
        F.col("pos_all") - F.col("pos_run") + F.col("pos"),
        F.col("neg_all") - F.col("neg_run") + F.col("neg"),
    )


def ranking_metrics(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Brier, ROC AUC and its multi-class aliases, PR AUC, Gini and KS from a ``score_histogram``."""
    tp, fp = _at_or_above()
    pos, neg = F.max("pos_all"), F.max("neg_all")
    below = F.col("neg_run") - F.col("neg") / 2
    recall, precision = F.try_divide(tp, F.col("pos_all")), F.try_divide(tp, tp + fp)
    tp_above, fp_above = tp - F.col("pos"), fp - F.col("neg")
    recall_above = F.try_divide(tp_above, F.col("pos_all"))
    precision_above = F.coalesce(F.try_divide(tp_above, tp_above + fp_above), F.lit(1.0))
    gap = F.try_divide(F.col("pos_run"), F.col("pos_all")) - F.try_divide(F.col("neg_run"), F.col("neg_all"))
    miss = F.col("pos") * F.pow(1 - F.col("score"), F.lit(2)) + F.col("neg") * F.pow("score", F.lit(2))
    rows = hist.groupBy(*by) if by else hist.groupBy()
    scored = rows.agg(
        F.try_divide(F.sum(miss), F.sum(F.col("pos") + F.col("neg"))).alias("brier_score_loss"),
        F.try_divide(F.sum(F.col("pos") * below), pos.cast("double") * neg).alias("roc_auc"),
        F.sum((recall - recall_above) * (precision + precision_above) / 2).alias("pr_auc"),
        F.max(F.abs(gap)).alias("ks_statistic"),
    )
    aliases = ("roc_auc_ovr", "roc_auc_ovo", "roc_auc_ovr_weighted", "roc_auc_ovo_weighted")
    return scored.withColumns(
        {"gini_coefficient": 2 * F.col("roc_auc") - 1, **{a: F.col("roc_auc") for a in aliases}}
    )


def pr_curve(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``threshold, precision, recall, f1`` per distinct score."""
    tp, fp = _at_or_above()
    return hist.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, F.col("pos_all")).alias("recall"),
        _or_zero(2 * tp, tp + fp + F.col("pos_all")).alias("f1"),
    )


def pr_points(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best-F1 threshold and the threshold where precision and recall meet; the lowest of equals."""
    return curve.groupBy(*by).agg(
        F.min_by(F.struct("threshold", "f1"), F.struct(-F.col("f1"), F.col("threshold"))).alias("best"),
        F.min_by(
            "threshold", F.struct(F.abs(F.col("precision") - F.col("recall")), F.col("threshold"))
        ).alias("crossing_threshold"),
    ).select(*by, F.col("best.threshold").alias("best_threshold"), F.col("best.f1").alias("best_f1"), "crossing_threshold")


def roc_curve(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``cut, sensitivity, specificity, distance`` per distinct score; every point is kept."""
    tp, fp = _at_or_above()
    sens, spec = F.try_divide(tp, F.col("pos_all")), 1 - F.try_divide(fp, F.col("neg_all"))
    return hist.select(
        *by,
        F.col("score").alias("cut"),
        sens.alias("sensitivity"),
        spec.alias("specificity"),
        F.abs(sens - spec).alias("distance"),
    )


def best_cuts(curve: DataFrame, by: Sequence[str] = (), k: int = 5) -> DataFrame:
    """The ``k`` cut-offs with the smallest gap between sensitivity and specificity, rounded to 3."""
    if by:
        place = F.row_number().over(W.partitionBy(*by).orderBy("distance", "cut"))
        top = curve.withColumn("place", place).filter(F.col("place") <= k).drop("place")
    else:
        top = curve.orderBy("distance", "cut").limit(k)
    names = ("cut", "sensitivity", "specificity", "distance")
    return top.select(*by, *[F.round(c, 3).alias(c) for c in names])


def ks_curve(hist: DataFrame, by: Sequence[str] = (), points: int = 100) -> DataFrame:
    """Cumulative shares of both classes on an even grid of thresholds over [0, 1].

    Scores are counted into their grid point first; the windows then see ``points`` rows per group.
    """
    last = points - 1
    guess = F.greatest(F.ceil(F.col("score") * last), F.lit(0))
    # rounding of score * last may land one point high
    point = F.when((guess > 0) & (F.col("score") <= (guess - 1) / last), guess - 1).otherwise(guess)
    counts = (
        hist.withColumn("point", point.cast("int"))
        .groupBy(*by, "point")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    groups = counts.groupBy(*by).agg(F.sum("pos").alias("pos_all"), F.sum("neg").alias("neg_all"))
    grid = groups.select(*by, "pos_all", "neg_all", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("point"))
    dense = grid.join(counts, [*by, "point"], "left").na.fill(0, ["pos", "neg"])
    upto = W.partitionBy(*by).orderBy("point").rowsBetween(W.unboundedPreceding, 0)
    cum_pos = F.try_divide(F.sum("pos").over(upto), F.col("pos_all"))
    cum_neg = F.try_divide(F.sum("neg").over(upto), F.col("neg_all"))
    return dense.select(
        *by,
        (F.col("point") / last).alias("threshold"),
        cum_pos.alias("cum_pos"),
        cum_neg.alias("cum_neg"),
        (cum_neg - cum_pos).alias("diff"),
    )


def ks_point(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest one-sided gap of the curve and its first threshold."""
    at = F.min_by(F.struct("diff", "threshold"), F.struct(-F.col("diff"), F.col("threshold")))
    return curve.groupBy(*by).agg(at.alias("p")).select(
        *by, F.col("p.diff").alias("ks"), F.col("p.threshold").alias("ks_threshold")
    )


def lorenz(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative population and positives by falling score, one point per distinct score."""
    tp, fp = _at_or_above()
    return hist.select(
        *by,
        "score",
        F.try_divide(tp + fp, F.col("pos_all") + F.col("neg_all")).alias("cum_population"),
        F.try_divide(tp, F.col("pos_all")).alias("cum_positives"),
    )


def calibration(hist: DataFrame, by: Sequence[str] = (), bins: int = 15) -> DataFrame:
    """Mean score and positive rate per uniform right-closed score bin; empty bins are left out."""
    place = F.least(F.greatest(F.ceil(F.col("score") * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    rows = F.col("pos") + F.col("neg")
    return (
        hist.withColumn("bin", place)
        .groupBy(*by, "bin")
        .agg(
            F.sum(rows).alias("n"),
            F.try_divide(F.sum(F.col("score") * rows), F.sum(rows)).alias("mean_score"),
            F.try_divide(F.sum("pos"), F.sum(rows)).alias("positive_rate"),
        )
    )


def metrics_table(df: DataFrame, y: str, pred: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Every metric in long form: group columns, ``metric``, ``value``."""
    cut = threshold_metrics(df, y, pred, by)
    rank = ranking_metrics(score_histogram(df, y, score, by), by)
    names = [c for c in [*cut.columns, *rank.columns] if c not in by]
    long = [t.unpivot(list(by), [c for c in names if c in t.columns], "metric", "value") for t in (cut, rank)]
    return long[0].unionByName(long[1])
