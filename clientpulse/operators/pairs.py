"""Co-purchase, transitions and gap distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientpulse.operators.history import lookahead_max, timeline


def products_ahead(df: DataFrame, key: str, order: str, flags: dict[str, str], rows: int = 4) -> DataFrame:
    """Add ``next_<product>`` flags for the look-ahead frame, and the array of products bought in it."""
    span = timeline(key, order)
    ahead = df.withColumns({f"next_{p}": lookahead_max(span, c, rows) for p, c in flags.items()})
    bought = F.array_compact(F.array(*[F.when(F.col(f"next_{p}") == 1, F.lit(p)) for p in flags]))
    return ahead.withColumn("prods", bought).withColumn("number_prods", F.size("prods"))


def product_pairs(df: DataFrame, keep: Sequence[str], prods: str = "prods") -> DataFrame:
    """Pairs at positions i < j of each row's product array.

    The pairs come from inside the row (a handful of products), so no row id and no self-join is needed.
    """
    rows = df.filter(F.size(prods) >= 2).select(*keep, prods)
    firsts = rows.select(*keep, prods, F.posexplode(prods).alias("i", "p1"))
    later = F.slice(F.col(prods), F.col("i") + 2, F.size(prods))
    return firsts.select(*keep, "p1", F.explode(later).alias("p2"))


def cooccurrence(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n"))


def conditional_probs(counts: DataFrame) -> DataFrame:
    """P(p2|p1) and P(p1|p2); windows run over the pair counts, at most one row per product pair."""
    first, second = F.sum("n").over(W.partitionBy("p1")), F.sum("n").over(W.partitionBy("p2"))
    return counts.withColumns(
        {
            "tot_p1": first,
            "tot_p2": second,
            "p2_given_p1": F.try_divide(F.col("n"), first),
            "p1_given_p2": F.try_divide(F.col("n"), second),
        }
    )


def pivot_symmetric(counts: DataFrame, products: Sequence[str]) -> DataFrame:
    """Square matrix of pair counts in both directions, 0 where a pair never occurs."""
    both = counts.unionByName(counts.select(F.col("p2").alias("p1"), F.col("p1").alias("p2"), "n"))
    return both.groupBy("p1").pivot("p2", list(products)).agg(F.sum("n")).na.fill(0)


def transitions(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Edge list: product bought now, other product bought within the frame (needs ``next_<product>``)."""
    edges = F.array(
        *[
            F.when(
                (F.col(a_flag) == 1) & (F.col(f"next_{b}") == 1),
                F.struct(F.lit(a).alias("p_i"), F.lit(b).alias("p_j")),
            )
            for a, a_flag in flags.items()
            for b in flags
            if a != b
        ]
    )
    return df.select(F.inline(F.array_compact(edges))).groupBy("p_i", "p_j").agg(F.count(F.lit(1)).alias("n"))


def gap_distribution(gaps: DataFrame) -> DataFrame:
    """Counts, percent and clipped cumulative percent per product on the full grid of month gaps.

    After the first aggregation there is one row per product and gap, bounded by the calendar.
    """
    counts = gaps.groupBy("product", "diff_months").agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.struct(F.min("diff_months").alias("lo"), F.max("diff_months").alias("hi")).alias("s")).scalar()
    grid = (
        counts.select("product")
        .distinct()
        .withColumn("__s", span)
        .select(
            "product",
            F.explode(F.sequence(F.col("__s.lo").cast("int"), F.col("__s.hi").cast("int"))).alias("gap"),
        )
        .select("product", F.col("gap").cast("double").alias("diff_months"))
    )
    dense = grid.join(counts, ["product", "diff_months"], "left").na.fill(0, ["n"])
    percent = F.try_divide(100.0 * F.col("n"), F.sum("n").over(W.partitionBy("product")))
    upto = W.partitionBy("product").orderBy("diff_months").rowsBetween(W.unboundedPreceding, 0)
    return dense.withColumn("percent", percent).withColumn(
        "cum_percent", F.least(F.sum("percent").over(upto), F.lit(100.0))
    )
