"""Feature statistics and selection (I).

All features are scored together: one wide aggregation, or one aggregation over the long view
``(feature, value, target)``. Only per-feature results and a features-by-features matrix reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

from clientpulse.operators.gram import gram_of_columns, gram_of_entries
from clientpulse.operators.ordered import cumulate, distribution, quantile_columns, value_table
from clientpulse.session import materialize

AGGREGATES_PER_PASS = 300


def long_view(df: DataFrame, cols: Sequence[str], target: str, kind: str = "double") -> DataFrame:
    """One row per (row, feature): ``feature, value, target``."""
    typed = df.select(F.col(target).alias("target"), *[F.col(c).cast(kind).alias(c) for c in cols])
    return typed.unpivot(["target"], list(cols), "feature", "value")


def _wide(df: DataFrame, aggs: dict[str, Column], name: str) -> DataFrame:
    """One aggregate per column, computed in as few passes as the plan size allows, as ``feature, <name>`` rows."""
    names, out = list(aggs), None
    for at in range(0, len(names), AGGREGATES_PER_PASS):
        part = names[at : at + AGGREGATES_PER_PASS]
        rows = df.agg(*[aggs[c].alias(c) for c in part]).unpivot([], part, "feature", name)
        out = rows if out is None else out.unionByName(rows)
    return out


def column_types(
    df: DataFrame, exclude: Sequence[str], threshold: int = 3, numeric: Sequence[str] = (), exact: bool = True
) -> DataFrame:
    """``feature, n_distinct, kind``: numeric if a number with more than ``threshold`` distinct values, or forced.

    Without ``exact``, counting stops at ``threshold + 1``, which is all the kind needs.
    """
    cols = [c for c in df.columns if c not in exclude]
    numbers = [c for c in cols if isinstance(df.schema[c].dataType, NumericType)]
    distinct = _wide(df, {c: F.count_distinct(c) for c in cols}, "n_distinct") if exact else capped_distinct(df, cols, threshold + 1)
    is_numeric = (F.col("feature").isin(numbers) & (F.col("n_distinct") > threshold)) | F.col("feature").isin(
        list(numeric)
    )
    return distinct.withColumn("kind", F.when(is_numeric, "numeric").otherwise("categorical"))


def capped_distinct(df: DataFrame, cols: Sequence[str], cap: int) -> DataFrame:
    """``feature, n_distinct``: distinct non-null values per column, counted up to ``cap`` only.

    A task keeps at most ``cap`` values of a column, so one scan moves at most ``cap`` rows per column and task, whatever the
    columns hold. Values are told apart by their text form.
    """
    cols = list(cols)
    texts = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set] = [set() for _ in cols]
        for batch in batches:
            for held, column in zip(seen, batch.columns):
                if len(held) < cap:
                    held.update(v for v in column.unique().to_pylist() if v is not None)
        rows = [(c, v) for c, held in zip(cols, seen) for v in sorted(held)[:cap]]
        feature, value = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(feature, pa.string()), pa.array(value, pa.string())], names=["feature", "value"])

    found = texts.mapInArrow(some, "feature string, value string").distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    counted = names.join(found, "feature", "left")
    return counted.select("feature", F.least(F.coalesce("n", F.lit(0)), F.lit(cap)).cast("long").alias("n_distinct"))


def zero_share(df: DataFrame, cols: Sequence[str], threshold: float = 0.80) -> DataFrame:
    """Share of zeros per column, nulls counted as zero; flagged when strictly above the threshold."""
    shares = {c: F.avg(F.when(F.coalesce(F.col(c), F.lit(0)) == 0, 1.0).otherwise(0.0)) for c in cols}
    return _wide(df, shares, "zero_share").withColumn(
        "mostly_zero", F.when(F.col("zero_share") > threshold, 1).otherwise(0)
    )


def zero_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample variance per column; flagged when zero or undefined."""
    found = _wide(df, {c: F.var_samp(F.col(c).cast("double")) for c in cols}, "variance")
    return found.withColumn("constant", F.when(F.coalesce(F.col("variance"), F.lit(0.0)) <= 0, 1).otherwise(0))


def correlation(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """``a, b, corr`` for every pair of columns, over the rows where both are present (neither null nor NaN).

    All pairs come from one scan, for Spearman's of the ranks. The correlation is null where a column does not vary.
    """
    cols = list(cols)
    gram = gram_of_entries(mid_ranks(df, cols), "ranks", len(cols)) if method == "spearman" else gram_of_columns(df, cols)
    r = gram.correlations()
    pairs = [(cols[i], cols[j], None if np.isnan(r[i, j]) else float(r[i, j])) for i, j in combinations(range(len(cols)), 2)]
    return df.sparkSession.createDataFrame(pairs, "a string, b string, corr double")


def mid_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``ranks``: per row an array of (place of the column, its value's rank), ties sharing the mean rank, missing values left out.

    The values of all columns are ranked by one sort of their distinct values and meet their ranks in one join, in which Spark
    splits a value that holds many rows. Rows without a value are left out.
    """
    names = [f"c{i}" for i in range(len(cols))]
    numbered = df.select(F.monotonically_increasing_id().alias("row"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(n) for c, n in zip(cols, names)])
    values = materialize(numbered, "numbered").unpivot(["row"], names, "feature", "value").filter(F.col("value").isNotNull())
    ranks = distribution(values, ["feature"], "value").select(
        "feature", "value", (F.col("n_run") - F.col("n") + (F.col("n") + 1) / 2).alias("rank")
    )
    ranked = values.join(materialize(ranks, "ranks"), ["feature", "value"])
    place = F.expr("cast(substring(feature, 2) as int)")
    return ranked.groupBy("row").agg(F.collect_list(F.struct(place.alias("place"), "rank")).alias("ranks"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson matrix with nulls as zero, one pass over the rows."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    vectors = VectorAssembler(inputCols=list(cols), outputCol="v").transform(filled).select("v")
    return Correlation.corr(vectors, "v").head()[0].toArray()


def _inflation(matrix: np.ndarray) -> np.ndarray:
    """1 / (1 - R²) of each column on the others: infinity for columns that others determine, whatever the rest does.

    A column is determined where it has a part in the null space of the matrix; for the others the pseudo-inverse has the factor.
    """
    roots, vectors = np.linalg.eigh(matrix)
    null = roots < 1e-10 * len(matrix)
    factors = np.sum(vectors[:, ~null] ** 2 / roots[~null], axis=1)
    return np.where(np.sum(vectors[:, null] ** 2, axis=1) > 1e-8, np.inf, factors)


def _varying(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns that are not constant, nulls counting as zero."""
    ends = column_ends(df, cols)
    return [c for c in cols if ends[c][0] != ends[c][1]]


def column_ends(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple]:
    """Smallest and largest value per column, nulls counting as zero."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    row = df.agg(*[F.struct(F.min(v), F.max(v)).alias(c) for c, v in filled.items()]).first()
    return {c: tuple(row[c]) for c in cols}


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation factor per feature, largest first; constant columns have none and come last with null."""
    varying = _varying(df, cols)
    factors = _inflation(correlation_matrix(df, varying)) if varying else []
    rows = sorted(zip(varying, map(float, factors)), key=lambda r: (-r[1], r[0]))
    rows += [(c, None) for c in sorted(set(cols) - set(varying))]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def vif_eliminate(df: DataFrame, cols: Sequence[str], limit: float = 5.0) -> DataFrame:
    """Drop the feature with the largest factor while any exceeds the limit.

    Constant columns go first, with a null factor. The matrix is computed once; every later round works on a sub-matrix.
    Output: ``feature, vif, dropped_at``.
    """
    varying = _varying(df, cols)
    rows = [(c, None, at) for at, c in enumerate((c for c in cols if c not in varying), 1)]
    cols, left = varying, list(range(len(varying)))
    matrix = correlation_matrix(df, cols) if cols else None
    while left:
        factors = _inflation(matrix[np.ix_(left, left)])
        worst = int(np.argmax(factors))
        if not factors[worst] > limit:
            rows += [(cols[i], float(v), None) for i, v in zip(left, factors)]
            break
        rows.append((cols[left.pop(worst)], float(factors[worst]), len(rows) + 1))
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, dropped_at int")


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), 1e-300)
    total = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + step * d or tiny)
            c = 1.0 + step / c or tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, dfn: pd.Series, dfd: pd.Series) -> pd.Series:
    """P(F > f) for one result row per feature."""
    rows = [None if pd.isna(v) else beta_tail(n2 / (n2 + n1 * v), n2 / 2.0, n1 / 2.0) for v, n1, n2 in zip(f, dfn, dfd)]
    return pd.Series(rows, dtype="float64")


def anova(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """One-way F test of each feature between target 0 and 1: ``feature, n, f, p_value``.

    Group sizes, means and variances of all features come from one aggregation with a row per feature and class. Classes that
    are each constant at different values are told apart perfectly: F is infinite and p zero.
    """
    rows = long_view(df, cols, target).filter(F.col("value").isNotNull() & F.col("target").isin(0, 1))
    groups = rows.groupBy("feature", "target").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
    )
    n0, n1 = (F.sum(F.when(F.col("target") == k, F.col("n")).otherwise(0)) for k in (0, 1))
    m0, m1 = (F.max(F.when(F.col("target") == k, F.col("mean"))) for k in (0, 1))
    joined = groups.groupBy("feature").agg(
        n0.alias("n0"), n1.alias("n1"), m0.alias("m0"), m1.alias("m1"), F.sum(F.col("n") * F.col("var")).alias("within"),
        (F.bool_and(F.col("lo") == F.col("hi")) & (F.count(F.lit(1)) == 2) & (F.min("lo") < F.max("lo"))).alias("apart"),
    )
    n = F.col("n0") + F.col("n1")
    between = F.col("n0") * F.col("n1") / n * F.pow(F.col("m0") - F.col("m1"), F.lit(2))
    ratio = F.try_divide(between, F.try_divide(F.col("within"), n - 2))
    scored = joined.select("feature", n.alias("n"), F.when(F.col("apart"), F.lit(math.inf)).otherwise(ratio).alias("f"))
    return scored.withColumn("p_value", f_tail("f", F.lit(1.0), (F.col("n") - 2).cast("double")))


def cramers_v(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Cramér's V of each categorical feature with a binary target, Yates-corrected on 2x2 tables."""
    levels = (
        long_view(df, cols, target, "string")
        .filter(F.col("value").isNotNull() & F.col("target").isNotNull())
        .groupBy("feature", "value")
        .agg(
            F.count_if(F.col("target") == 0).cast("double").alias("n0"),
            F.count_if(F.col("target") == 1).cast("double").alias("n1"),
        )
    )
    totals = levels.groupBy("feature").agg(
        F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count(F.lit(1)).alias("levels")
    )
    n = F.col("t0") + F.col("t1")
    classes = (F.col("t0") > 0).cast("int") + (F.col("t1") > 0).cast("int")
    row_total = F.col("n0") + F.col("n1")

    def cell(observed: str, column_total: str) -> Column:
        expected = row_total * F.col(column_total) / n
        gap = F.abs(F.col(observed) - expected)
        kept = F.when((F.col("levels") == 2) & (classes == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return F.coalesce(F.try_divide(kept * kept, expected), F.lit(0.0))

    # one row per feature: bounded by the number of columns
    scored = levels.join(F.broadcast(totals), "feature").withColumn("chi", cell("n0", "t0") + cell("n1", "t1"))
    smaller = F.least(F.max("levels"), F.max(classes)) - 1
    return scored.groupBy("feature").agg(
        F.sqrt(F.try_divide(F.sum("chi"), F.max(n) * smaller)).alias("v"), F.max(n).cast("long").alias("n")
    )


def quantile_edges(counts: DataFrame, bins: int) -> DataFrame:
    """Sorted, deduplicated quantile edges per feature from ``value_counts``."""
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    dist = cumulate(counts, ["feature"], ["value"], ["n"])
    row = dist.groupBy("feature").agg(*quantile_columns("value", names))
    return row.select("feature", F.array_sort(F.array_distinct(F.array(*names))).alias("edges"))


def bin_index(value: str | Column, edges: str | Column) -> Column:
    """0-based right-closed bin, the lowest edge included; null outside the edges."""
    value = F.col(value) if isinstance(value, str) else value
    edges = F.col(edges) if isinstance(edges, str) else edges
    below = F.size(F.filter(edges, lambda e: e < value))
    inside = (value >= F.get(edges, F.lit(0))) & (value <= F.element_at(edges, -1)) & (F.size(edges) > 1)
    return F.when(inside, F.greatest(below - 1, F.lit(0)))


def equal_width_bin(value: str | Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based right-closed equal-width bin, the lowest value included."""
    value = F.col(value) if isinstance(value, str) else value
    place = F.ceil(F.try_divide((value - lo) * bins, hi - lo)) - 1
    return F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1))


def value_counts(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Distinct values per numeric feature with counts and positives, written once for several readers."""
    rows = long_view(df, cols, target).filter(F.col("target").isNotNull())
    return value_table(rows, ["feature"], "value", {"bad": F.sum("target")})


def binned_counts(counts: DataFrame, bins: int) -> DataFrame:
    """``feature, bin, n, bad`` of quantile bins; edges are at most bins+1 numbers per feature, so they broadcast."""
    edges = quantile_edges(counts, bins)
    placed = counts.join(F.broadcast(edges), "feature").withColumn("bin", bin_index("value", "edges"))
    return placed.groupBy("feature", "bin").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def level_counts(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    rows = long_view(df, cols, target, "string").filter(F.col("value").isNotNull() & F.col("target").isNotNull())
    return rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("bad"))


def iv_from_counts(counts: DataFrame) -> DataFrame:
    """Information value from counts per bin or level; those without positives or negatives are left out first.

    With G and B the kept totals, sum((g/G - b/B) ln((g/G)/(b/B))) = sum(g ln(g/b))/G - sum(b ln(g/b))/B,
    so one aggregation is enough.
    """
    good = F.col("n") - F.col("bad")
    kept = counts.filter((F.col("bad") > 0) & (good > 0)).select(
        "feature", good.alias("g"), F.col("bad").alias("b"), F.ln(good / F.col("bad")).alias("w")
    )
    return kept.groupBy("feature").agg(
        (F.sum(F.col("g") * F.col("w")) / F.sum("g") - F.sum(F.col("b") * F.col("w")) / F.sum("b")).alias("iv")
    )


def information_value(
    df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """``feature, iv`` for all features, largest first; null where no bin has both classes."""
    parts = []
    if numeric:
        parts.append(binned_counts(value_counts(df, target, numeric), bins).select("feature", "n", "bad"))
    if categorical:
        parts.append(level_counts(df, target, categorical).select("feature", "n", "bad"))
    counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    names = df.sparkSession.createDataFrame([(c,) for c in [*numeric, *categorical]], "feature string")
    return names.join(iv_from_counts(counts), "feature", "left").orderBy(F.desc("iv"), "feature")


def select_features(
    df: DataFrame,
    target: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    p_limit: float = 0.05,
    v_limit: float = 0.01,
    iv_limit: float = 0.02,
    bins: int = 25,
) -> DataFrame:
    """Features that pass any of the three rules, with the names of the rules passed."""
    by_f = anova(df, target, numeric).filter(F.col("p_value") < p_limit)
    by_v = cramers_v(df, target, categorical).filter(F.col("v") > v_limit)
    by_iv = information_value(df, target, numeric, categorical, bins).filter(F.col("iv") > iv_limit)
    parts = [d.select("feature", F.lit(rule).alias("rule")) for d, rule in ((by_f, "anova"), (by_v, "cramer"), (by_iv, "iv"))]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # at most three rows per feature
    return union.groupBy("feature").agg(F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("rules"))
