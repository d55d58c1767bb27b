"""Grouped rollups, category profiles, shares, frequency tables (D)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientpulse.functions.dates import period_start
from clientpulse.functions.scalars import keep_listed
from clientpulse.operators.ordered import exact_quantiles


def period_rollup(
    df: DataFrame, key: str, time_col: str, aggs: dict[str, Column], period: str = "month", name: str = "mon"
) -> DataFrame:
    """One row per key and calendar period."""
    keyed = df.withColumn(name, period_start(time_col, period))
    return keyed.groupBy(key, name).agg(*[c.alias(n) for n, c in aggs.items()])


def distinct_counts(cols: dict[str, str | Column], rsd: float | None = None) -> dict[str, Column]:
    """Exact distinct counts, or sketches with the given relative error where an estimate is enough."""
    if rsd is not None:
        return {name: F.approx_count_distinct(c, rsd) for name, c in cols.items()}
    return {name: F.count_distinct(c) for name, c in cols.items()}


def by_code(code: str | Column, codes: Sequence, value: str | Column, fn, otherwise=None) -> dict:
    """``fn`` of ``value`` on the rows of each code; ``otherwise`` is what the other rows add."""
    code = F.col(code) if isinstance(code, str) else code
    value = F.col(value) if isinstance(value, str) else value
    picked = {}
    for c in codes:
        chosen = F.when(code == c, value)
        picked[c] = fn(chosen.otherwise(otherwise) if otherwise is not None else chosen)
    return picked


def top_code(col: str, codes: Sequence) -> Column:
    """The code if it is one of the frequent ones, else 0."""
    return keep_listed(col, codes, 0)


def category_counts(df: DataFrame, key: Sequence[str], cats: dict[str, str]) -> DataFrame:
    """``key, cat, val, n``: rows per value of several categories, the columns unpivoted so that the input is read once."""
    texts = [F.col(c).cast("string").alias(p) for p, c in cats.items()]
    long = df.select(*key, *texts).unpivot([*key], list(cats), "cat", "val")
    return long.groupBy(*key, "cat", "val").agg(F.count(F.lit(1)).alias("n"))


def placed_counts(
    df: DataFrame, key: Sequence[str], owner: str, cats: dict[str, str], measured: str, amount: str
) -> DataFrame:
    """``category_counts`` with ``amt_sum``, ``amt_avg`` and ``amt_std`` of the values of the category ``measured``, dealt by ``owner``.

    For categories of few values. Rows are counted map-side by the combination of their values, and only the combinations, one row
    each for all categories, move to their owner; whatever is grouped by the owner afterwards moves nothing. Deviations are taken from a
    value amid the amounts of the same value and key, so that their squares do not cancel.
    """
    value = F.col(amount).cast("double")
    moments = {"n": F.count(F.lit(1)), "__c": F.count(value), "__sum": F.sum(value), "__var": F.var_pop(value)}
    texts = {p: f"__of_{p}" for p in cats}
    named = df.select(*key, amount, *[F.col(c).alias(texts[p]) for p, c in cats.items()])
    combined = named.groupBy(*key, *texts.values()).agg(*[m.alias(c) for c, m in moments.items()]).repartition(owner)
    mean = F.try_divide("__sum", "__c")
    off = mean - F.avg(mean).over(W.partitionBy(*key, texts[measured]))
    own = {
        "__c": F.col("__c"),
        "__sum": F.col("__sum"),
        "__off": F.col("__c") * F.col("__off"),
        "__sqr": F.col("__c") * (F.col("__var") + F.col("__off") * F.col("__off")),
    }
    # an exploded array stays where its row is, which an unpivot does not
    rows = [
        F.struct(
            F.lit(p).alias("cat"),
            F.col(texts[p]).cast("string").alias("val"),
            F.col("n"),
            *[(c if p == measured else F.lit(None).cast("bigint" if m == "__c" else "double")).alias(m) for m, c in own.items()],
        )
        for p in cats
    ]
    long = combined.withColumn("__off", off).select(*key, F.inline(F.array(*rows)))
    sums = long.groupBy(*key, "cat", "val").agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in ("__c", "__sum", "__off", "__sqr")])
    spread = F.greatest(F.col("__sqr") - F.col("__off") * F.col("__off") / F.nullif("__c", F.lit(0)), F.lit(0.0))
    return sums.select(
        *key,
        "cat",
        "val",
        "n",
        F.col("__sum").alias("amt_sum"),
        F.try_divide("__sum", "__c").alias("amt_avg"),
        F.when(F.col("__c") > 1, F.sqrt(spread / (F.col("__c") - 1))).alias("amt_std"),
    )


def profile_columns(cats: dict[str, str], types: dict) -> list[Column]:
    """Distinct count, Shannon entropy (natural log) and mode of each category, from ``category_counts``.

    Entropy uses H = ln N - sum(n ln n) / N. Null is a category of its own for entropy and mode, but is not counted as a distinct
    value. Mode ties go to the smallest value, null first.
    """
    aggs = []
    for prefix in cats:
        here = F.col("cat") == prefix
        size = F.sum(F.when(here, F.col("n")))
        spread = F.sum(F.when(here, F.col("n") * F.ln("n")))
        value = F.col("val").cast(types[prefix])
        aggs += [
            F.count(F.when(here, F.col("val"))).alias(f"{prefix}_distinct"),
            (F.ln(size) - spread / size).alias(f"{prefix}_entropy"),
            F.min_by(value, F.when(here, F.struct(-F.col("n"), value))).alias(f"{prefix}_mode"),
        ]
    return aggs


def category_profile(df: DataFrame, key: Sequence[str], cats: dict[str, str]) -> DataFrame:
    """Distinct count, entropy and mode of several categories, in one aggregation.

    ``cats`` maps an output prefix to a column. Every category shares the same two shuffles; both aggregate map-side, so one busy
    group is never gathered whole.
    """
    types = {p: df.schema[c].dataType for p, c in cats.items()}
    return category_counts(df, key, cats).groupBy(*key).agg(*profile_columns(cats, types))


def share_of_total(df: DataFrame, by: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Group counts or sums and their share of the grand total (``pct_<measure>``).

    The total adds up the groups and is read as a scalar subquery over the same aggregate: no window over all rows.
    """
    groups = df.groupBy(*by).agg(*[c.alias(n) for n, c in measures.items()])
    totals = groups.agg(F.struct(*[F.sum(n).alias(n) for n in measures]).alias("t")).scalar()
    shares = {f"pct_{n}": F.try_divide(F.col(n), F.col("__t")[n]) for n in measures}
    return groups.withColumn("__t", totals).withColumns(shares).drop("__t")


def frequency(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """Row counts per value combination, in key order."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name)).orderBy(*by)


def having(df: DataFrame, key: Sequence[str], sums: Sequence[str], over: int = 1) -> DataFrame:
    """Groups in which at least one of the summed columns exceeds ``over``."""
    totals = df.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums])
    return totals.filter(F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in sums]) > over)


def describe_by(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column per group.

    The quartiles are exact and come from the counts of all columns' distinct values, so no group has to fit in a task.
    """
    by, cols = list(by), list(cols)
    moments = {"count": F.count, "mean": F.avg, "std": F.stddev, "min": F.min, "max": F.max}
    base = df.groupBy(*by).agg(*[fn(c).alias(f"{c}_{name}") for c in cols for name, fn in moments.items()])
    typed = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    long = typed.unpivot(by, cols, "__column", "__value")
    quartiles = exact_quantiles(long, [*by, "__column"], "__value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    found = quartiles.groupBy(*[F.col(g).alias(f"__by{i}") for i, g in enumerate(by)]).agg(
        *[F.max(F.when(F.col("__column") == c, F.col(q))).alias(f"{c}_{q}") for c in cols for q in ("q1", "q2", "q3")]
    )
    same = [F.col(g).eqNullSafe(F.col(f"__by{i}")) for i, g in enumerate(by)]
    names = ("count", "mean", "std", "min", "q1", "q2", "q3", "max")
    joined = base.join(found, same, "left") if by else base.crossJoin(found)  # without groups both have one row
    return joined.select(*by, *[f"{c}_{n}" for c in cols for n in names])


def column_counts(df: DataFrame, cols: Sequence[str], kind: str = "distinct") -> DataFrame:
    """One row per column with its distinct-value or null count, from one pass."""
    if kind == "distinct":
        aggs = [F.count_distinct(c).alias(c) for c in cols]
    else:
        aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    return df.agg(*aggs).unpivot([], list(cols), "feature", "n")
