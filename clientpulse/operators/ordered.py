"""Running sums, previous rows, ranks and exact quantiles over groups of any size.

A plain window sends a whole group to one task. Where a group may hold a third of all rows (one client, one cluster,
one feature, the whole table) these operators cut the sort order ``(group keys, order keys)`` into ranges instead:

1. the rows are range-partitioned and written once to the shared folder together with their range number, so every
   later step sees the same ranges and the input is computed once;
2. windows run inside ``(range, group)``, which no group can overload;
3. only the first and last group of a range can continue elsewhere. Their sums per range form a table of at most three
   rows per range, which is why broadcasting it is safe at any data size.

Where the ranges are cut only balances the work: any cut gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientpulse.session import materialize, shuffle_width

_RANGE, _CARRY = "__range", "__carry"


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with their range number in ``(by, order)`` order, written once and read back."""
    placed = df.repartitionByRange(shuffle_width(df.sparkSession), *by, *order)
    return materialize(placed.withColumn(_RANGE, F.spark_partition_id()), "ranges")


def _pieces(ranged: DataFrame, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregates per range and group, for the groups at the edge of a range."""
    if not by:
        return ranged.groupBy(_RANGE).agg(*aggs)
    group = F.struct(*by)
    edges = ranged.groupBy(_RANGE).agg(F.min(group).alias("lo"), F.max(group).alias("hi"))
    keys = edges.select(F.explode(F.array("lo", "hi")).alias("edge")).distinct()
    on = [F.col(c).eqNullSafe(F.col("edge")[c]) for c in by]
    return ranged.join(F.broadcast(keys), on, "left_semi").groupBy(*by, _RANGE).agg(*aggs)


def _attach(ranged: DataFrame, by: Sequence[str], pieces: DataFrame) -> DataFrame:
    """Left join of the per-range carry table; group keys may be null."""
    renamed = pieces.select(
        F.col(_RANGE).alias("__r"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], F.col(_CARRY)
    )
    on = F.col(_RANGE) == F.col("__r")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return ranged.join(F.broadcast(renamed), on, "left").drop("__r", *[f"__g{i}" for i in range(len(by))])


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[str], measures: Sequence[str], group_totals: bool = True
) -> DataFrame:
    """Add ``<m>_run`` (sum up to and including the row) and ``<m>_all`` (group total) for each measure.

    ``(by, order)`` should identify a row; measures should be whole numbers where exactness matters.
    Sums from the other end are ``all - run + own``.
    """
    return cumulate(in_ranges(df, by, order), by, order, measures, group_totals)


def cumulate(
    ranged: DataFrame, by: Sequence[str], order: Sequence[str], measures: Sequence[str], group_totals: bool = True
) -> DataFrame:
    """``running_totals`` over a table that ``in_ranges`` has already written."""
    parts = _pieces(ranged, by, [F.sum(m).alias(m) for m in measures])
    earlier = W.partitionBy(*by).orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    carry = parts.select(
        *by,
        _RANGE,
        F.struct(
            *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"{m}_before") for m in measures],
            *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
        ).alias(_CARRY),
    )
    inside = W.partitionBy(_RANGE, *by)
    upto = inside.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    added = {
        f"{m}_run": F.coalesce(F.col(_CARRY)[f"{m}_before"], F.lit(0)) + F.sum(m).over(upto) for m in measures
    }
    if group_totals:
        added |= {f"{m}_all": F.coalesce(F.col(_CARRY)[f"{m}_total"], F.sum(m).over(inside)) for m in measures}
    return _attach(ranged, by, carry).withColumns(added).drop(_CARRY, _RANGE)


def previous_row(
    df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], name: str = "previous"
) -> DataFrame:
    """Add a struct with ``cols`` of the row before this one in its group; null on the first row."""
    ranged = in_ranges(df, by, order)
    packed = F.struct(*cols)
    last = _pieces(ranged, by, [F.max_by(packed, F.struct(*order)).alias("__last")])
    carry = last.select(*by, _RANGE, F.lag("__last").over(W.partitionBy(*by).orderBy(_RANGE)).alias(_CARRY))
    inside = W.partitionBy(_RANGE, *by).orderBy(*order)
    joined = _attach(ranged, by, carry).withColumn("__inside", F.lag(packed).over(inside))
    return joined.withColumn(name, F.coalesce("__inside", _CARRY)).drop(_CARRY, _RANGE, "__inside")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in its group's ascending order."""
    counted = running_totals(df.withColumn(name, F.lit(1).cast("long")), by, order, [name], group_totals=False)
    return counted.withColumn(name, F.col(f"{name}_run")).drop(f"{name}_run")


def value_table(df: DataFrame, by: Sequence[str], value: str, measures: dict[str, Column] | None = None) -> DataFrame:
    """Distinct non-null values per group with their counts ``n`` (and further sums), written in ranges."""
    sums = {"n": F.count(F.lit(1)), **(measures or {})}
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*[c.alias(k) for k, c in sums.items()])
    return in_ranges(counts, by, [value])


def distribution(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values per group with their counts ``n``, cumulated in value order."""
    return cumulate(value_table(df, by, value), by, [value], ["n"])


def quantile_columns(value: str, probs: dict[str, float], n: str = "n") -> list[Column]:
    """Aggregates over a ``distribution`` that give linearly interpolated quantiles."""
    before, size = F.col(f"{n}_run") - F.col(n), F.col(f"{n}_all") - F.lit(1)
    out = []
    for name, p in probs.items():
        at = size * F.lit(float(p))
        low = F.max(F.when(before <= F.floor(at), F.col(value)))
        high = F.max(F.when(before <= F.ceil(at), F.col(value)))
        share = F.max(at - F.floor(at))
        out.append((low + (high - low) * share).alias(name))
    return out


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles per group, exact and without holding any group in one task."""
    dist = distribution(df, by, value)
    aggs = quantile_columns(value, probs)
    return dist.groupBy(*by).agg(*aggs) if by else dist.agg(*aggs)


def next_point(
    rows: DataFrame, points: DataFrame, at: str, cols: Sequence[str], name: str = "point", by: Sequence[str] = ()
) -> DataFrame:
    """Add to each row a struct with ``cols`` of the first point of its group whose ``at`` is not below the row's.

    Rows and points are sorted together, so neither side has to fit anywhere as a whole.
    """
    by, packed = list(by), F.struct(*cols)
    left = rows.select("*", F.lit(0).alias("__kind"), F.lit(None).cast(points.select(packed).schema[0].dataType).alias("__p"))
    right = points.select(*by, at, F.lit(1).alias("__kind"), packed.alias("__p"))
    ranged = in_ranges(left.unionByName(right, allowMissingColumns=True), by, [at, "__kind"])
    firsts = _pieces(ranged, by, [F.min_by("__p", F.when(F.col("__kind") == 1, F.col(at))).alias("__first")])
    later = W.partitionBy(*by).orderBy(F.desc(_RANGE)).rowsBetween(W.unboundedPreceding, -1)
    carry = firsts.select(*by, _RANGE, F.last("__first", ignorenulls=True).over(later).alias(_CARRY))
    inside = W.partitionBy(_RANGE, *by).orderBy(F.desc(at), F.desc("__kind")).rowsBetween(W.unboundedPreceding, 0)
    found = F.coalesce(F.last("__p", ignorenulls=True).over(inside), F.col(_CARRY))
    joined = _attach(ranged, by, carry).withColumn(name, found)
    return joined.filter(F.col("__kind") == 0).drop("__kind", "__p", _CARRY, _RANGE)
