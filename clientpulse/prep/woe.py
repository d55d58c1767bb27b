"""Weight-of-evidence encoding."""

from __future__ import annotations

import math

from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientpulse.operators.ordered import running_totals
from clientpulse.operators.statistics import (
    bin_index,
    binned_counts,
    equal_width_bin,
    long_view,
    quantile_edges,
    value_counts,
)
from clientpulse.prep.base import Fit, Fitted, Stage
from clientpulse.session import materialize

# Fixed value: smoothing term.
EPS = 1e-4
MISSING = "nan"


def woe(good: float, bad: float, total_good: float, total_bad: float) -> float:
    return math.log((good / (total_good + EPS) + EPS) / (bad / (total_bad + EPS) + EPS))


def woe_column(good: Column, bad: Column, total_good: Column, total_bad: Column) -> Column:
    return F.ln((good / (total_good + EPS) + EPS) / (bad / (total_bad + EPS) + EPS))


def rare_levels(levels: DataFrame, min_share: float) -> DataFrame:
    """``feature, value, n, bad, slot``: levels below ``min_share`` are pooled in falling frequency.

    A pool closes when its share reaches ``min_share``; what is left at the end is a pool of its own. Frequent levels
    have slot null. A feature has at most 1 / min_share closed pools, so the ends of the pools are found by as many
    small aggregations over the running counts, whatever the number of levels.
    """
    totals = levels.groupBy("feature").agg(F.sum("n").alias("total"))
    # one row per feature: bounded by the schema
    shared = levels.join(F.broadcast(totals), "feature").withColumn("rare", F.col("n") / F.col("total") < min_share)
    none = F.lit(None).cast("int")
    frequent = shared.filter(~F.col("rare")).select("feature", "value", "n", "bad", none.alias("slot"))
    rare = shared.filter("rare").withColumn("order", -F.col("n"))
    if rare.isEmpty():
        return frequent
    pooled = materialize(running_totals(rare, ["feature"], ["order", "value"], ["n"], group_totals=False), "rare")
    run, ends = pooled, {}
    while True:
        start = _per_feature({f: e[-1] for f, e in ends.items()}, 0)
        reached = (F.col("n_run") - start) / F.col("total") >= min_share
        found = run.filter(reached).groupBy("feature").agg(F.min("n_run").alias("end")).collect()
        if not found:
            break
        for r in found:
            ends.setdefault(r["feature"], []).append(r["end"])
        done = [f for f in ends if f not in {r["feature"] for r in found}]
        run = run.filter(~F.col("feature").isin(done)) if done else run
    slot = F.lit(0)
    for f, e in ends.items():
        closed = sum((F.when(F.col("n_run") > at, 1).otherwise(0) for at in e), F.lit(0))
        slot = F.when(F.col("feature") == f, closed).otherwise(slot)
    return frequent.unionByName(pooled.select("feature", "value", "n", "bad", slot.cast("int").alias("slot")))


def _per_feature(values: dict, default) -> Column:
    out = F.lit(default)
    for f, v in values.items():
        out = F.when(F.col("feature") == f, v).otherwise(out)
    return out


def merge_similar(groups: dict, threshold: float) -> list[list]:
    """Neighbours in WoE order join the running group while they stay within the threshold of its first member."""
    ordered = sorted(groups.items(), key=lambda g: (g[1], str(g[0])))
    merged = [[ordered[0][0]]]
    anchor = ordered[0][1]
    for name, value in ordered[1:]:
        if abs(value - anchor) <= threshold:
            merged[-1].append(name)
        else:
            merged.append([name])
            anchor = value
    return merged


class _Woe(Stage):
    numericCols = Param(Params._dummy(), "numericCols", "numbers to bin", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "categories to encode", TypeConverters.toListString)
    targetCol = Param(Params._dummy(), "targetCol", "binary target", TypeConverters.toString)
    bins = Param(Params._dummy(), "bins", "number of bins", TypeConverters.toInt)
    minShare = Param(Params._dummy(), "minShare", "smaller levels are pooled", TypeConverters.toFloat)
    similarity = Param(Params._dummy(), "similarity", "WoE distance that merges levels", TypeConverters.toFloat)
    method = Param(Params._dummy(), "method", "quantile or uniform", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(
            numericCols=[], categoricalCols=[], targetCol="target", bins=5, minShare=0.05, similarity=0.1, method="quantile"
        )

    def listed(self, name: str) -> list[str]:
        excluded = set(self.getOrDefault("excludeCols"))
        return [c for c in self.getOrDefault(name) if c not in excluded]


class WoeEncoderModel(Fitted, _Woe):
    @property
    def mapping(self) -> DataFrame:
        """``feature, value, woe`` of the categorical levels."""
        return self.tables["levels"]

    def information_values(self) -> dict[str, float]:
        return self.values["iv"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        coded = {}
        for c, v in self.values["bins"].items():
            edges, weights = F.array(*map(F.lit, v["edges"])), F.array(*map(F.lit, v["woe"]))
            if v["uniform"]:
                lo, hi = v["edges"][0], v["edges"][-1]
                at = equal_width_bin(c, F.lit(lo), F.lit(hi), len(v["woe"]))
                at = F.when(F.col(c).between(lo, hi), at)
            else:
                at = bin_index(c, edges)
            coded[c] = F.coalesce(F.get(weights, at.cast("int")), F.lit(0.0))
        out = dataset.withColumns(coded) if coded else dataset
        names = self.listed("categoricalCols")
        for c in names:
            # Spark broadcasts the level table when its size allows and shuffles otherwise
            own = self.mapping.filter(F.col("feature") == c).select(F.col("value").alias("__level"), F.col("woe").alias("__woe"))
            level = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
            out = out.join(own, level == F.col("__level"), "left").withColumn(c, F.coalesce("__woe", F.lit(0.0)))
            out = out.drop("__level", "__woe")
        return out


class WoeEncoder(Fit, _Woe):
    """ln(good share / bad share) per level or bin; unseen levels and values outside the fitted bins become 0.

    Bin edges and pools are those of the fit. After pooling a feature has at most 2 / minShare + 1 groups, so the
    similarity merge is a short loop on the driver.
    """

    model_class = WoeEncoderModel

    def fitted_values(self, df: DataFrame) -> dict:
        bins, iv_bins = self._numeric(df)
        levels, iv_levels = self._categorical(df)
        return {"bins": bins, "iv": iv_bins | iv_levels} | ({"levels": levels} if levels is not None else {})

    def _numeric(self, df: DataFrame) -> tuple[dict, dict]:
        cols, target, k = self.listed("numericCols"), self.getOrDefault("targetCol"), self.getOrDefault("bins")
        if not cols:
            return {}, {}
        dist = value_counts(df, target, cols)
        if self.getOrDefault("method") == "quantile":
            counts = binned_counts(dist, k).collect()
            edges = {r["feature"]: list(r["edges"]) for r in quantile_edges(dist, k).collect()}
        else:
            ends = dist.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
            # one row per feature: bounded by the schema
            placed = dist.join(F.broadcast(ends), "feature").withColumn(
                "bin", equal_width_bin("value", F.col("lo"), F.col("hi"), k)
            )
            counts = placed.groupBy("feature", "bin").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).collect()
            edges = {r["feature"]: [r["lo"] + (r["hi"] - r["lo"]) * i / k for i in range(k + 1)] for r in ends.collect()}
        by_feature: dict[str, dict] = {}
        for r in counts:
            if r["bin"] is not None:
                by_feature.setdefault(r["feature"], {})[int(r["bin"])] = (r["n"] - r["bad"], r["bad"])
        fitted, ivs = {}, {}
        for c, groups in by_feature.items():
            weights, ivs[c] = _weights(groups)
            fitted[c] = {
                "edges": edges[c],
                "woe": [weights.get(i, 0.0) for i in range(max(len(edges[c]) - 1, 1))],
                "uniform": self.getOrDefault("method") != "quantile",
            }
        return fitted, ivs

    def _categorical(self, df: DataFrame) -> tuple[DataFrame | None, dict]:
        cols, target = self.listed("categoricalCols"), self.getOrDefault("targetCol")
        if not cols:
            return None, {}
        rows = long_view(df, cols, target, "string").withColumn("value", F.coalesce("value", F.lit(MISSING)))
        counts = rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("bad"))
        pooled = materialize(rare_levels(materialize(counts, "levels"), self.getOrDefault("minShare")), "pooled")
        group = F.when(F.col("slot").isNull(), F.col("value"))
        sums = (
            pooled.groupBy("feature", group.alias("level"), "slot")
            .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
            .collect()
        )
        weights, ivs = {}, {}
        for c in cols:
            own = {(r["level"], r["slot"]): (r["n"] - r["bad"], r["bad"]) for r in sums if r["feature"] == c}
            if not own:
                continue
            first, _ = _weights(own)
            joined = {
                tuple(members): tuple(map(sum, zip(*(own[m] for m in members))))
                for members in merge_similar(first, self.getOrDefault("similarity"))
            }
            final, ivs[c] = _weights(joined)
            weights |= {(c, *m): w for members, w in final.items() for m in members}
        spark = df.sparkSession
        table = spark.createDataFrame(
            [(f, v, s, w) for (f, v, s), w in weights.items()], "in_feature string, level string, in_slot int, woe double"
        )
        # at most 2 / minShare + 1 rows per feature
        same = (
            (F.col("feature") == F.col("in_feature"))
            & group.eqNullSafe(F.col("level"))
            & F.col("slot").eqNullSafe(F.col("in_slot"))
        )
        return pooled.join(F.broadcast(table), same).select("feature", "value", "woe"), ivs


def _weights(groups: dict) -> tuple[dict, float]:
    """WoE per group and the information value of ``{group: (good, bad)}``."""
    good, bad = (sum(v[i] for v in groups.values()) for i in (0, 1))
    weights = {k: woe(g, b, good, bad) for k, (g, b) in groups.items()}
    iv = sum((g / (good + EPS) - b / (bad + EPS)) * weights[k] for k, (g, b) in groups.items())
    return weights, iv
