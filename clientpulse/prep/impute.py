"""Imputation of missing values."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.functions.scalars import hash_uniform
from clientpulse.operators.ordered import next_point, previous_row
from clientpulse.prep.base import Fit, Fitted, Stage, column_aggregates, column_quantiles, value_distribution
from clientpulse.session import materialize

# Distributions of at most so many points are sent with the plan; larger ones are joined.
POINTS_IN_PLAN = 4096


class _Fixed(Stage):
    fixed = Param(Params._dummy(), "fixed", "column -> value to use instead of a fitted one", TypeConverters.identity)

    def _defaults(self) -> None:
        self._setDefault(fixed={})


def _draws(points: dict[str, tuple[np.ndarray, np.ndarray]], seed: int) -> Callable[..., pd.DataFrame]:
    """Interpolated draws of the missing cells, from the rows' key texts; the numbers are those of ``hash_uniform``."""

    def draw(known: pd.Series, *missing: pd.Series) -> pd.DataFrame:
        texts, out = known.to_numpy(), {}
        for i, (feature, (shares, values)) in enumerate(points.items()):
            at, tail = np.flatnonzero(missing[i].to_numpy()), f"{feature}|{seed}"
            digits = [int(hashlib.md5((k + tail).encode()).hexdigest()[:12], 16) for k in texts[at]]
            share = shares[0] + np.array(digits, dtype=float) / float(16**12) * (1 - shares[0])
            place = np.searchsorted(shares, share)
            before = np.maximum(place - 1, 0)
            with np.errstate(invalid="ignore"):
                step = (share - shares[before]) / (shares[place] - shares[before])
            found = values[before] + (values[place] - values[before]) * step
            cells = np.full(len(texts), np.nan)
            cells[at] = np.where(place == 0, values[0], found)
            out[f"d{i}"] = cells
        return pd.DataFrame(out)

    return draw


def _null_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    if not cols:
        return {}
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


class CategoryImputerModel(Fitted, _Fixed):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        values, fixed = self.values, self.getOrDefault("fixed")
        flags = {f"{c}_null": F.col(c).isNull().cast("int") for c, v in values.items() if v["flag"]}
        filled = {c: F.coalesce(F.col(c), F.lit(v["mode"])) for c, v in values.items() if v["mode"] is not None}
        filled |= {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fixed.items()}
        return dataset.withColumns(flags | filled) if flags or filled else dataset


class CategoryImputer(Fit, _Fixed):
    """Most frequent value (the smallest of equals), with a ``<col>_null`` flag where nulls were seen at fit time."""

    model_class = CategoryImputerModel

    def fitted_values(self, df: DataFrame) -> dict:
        cols = [c for c in self.columns() if c not in self.getOrDefault("fixed")]
        if not cols:
            return {}
        texts = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
        counts = (
            texts.unpivot([], cols, "feature", "value")
            .filter(F.col("value").isNotNull())
            .groupBy("feature", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        best = counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
        modes, nulls = {r["feature"]: r["mode"] for r in best.collect()}, _null_counts(df, cols)
        return {c: {"mode": _typed(df, c, modes.get(c)), "flag": nulls[c] > 0} for c in cols}


def _typed(df: DataFrame, col: str, text: str | None):
    kind = df.schema[col].dataType.typeName()
    if text is None or kind == "string":
        return text
    return float(text) if kind in ("double", "float") else int(text)


class _Numeric(_Fixed):
    strategy = Param(Params._dummy(), "strategy", "mean, median or random", TypeConverters.toString)
    addFlags = Param(Params._dummy(), "addFlags", "add <col>_null where nulls were seen", TypeConverters.toBoolean)
    keyCols = Param(Params._dummy(), "keyCols", "row keys that fix the random draw", TypeConverters.toListString)
    seed = Param(Params._dummy(), "seed", "seed of the random draw", TypeConverters.toInt)

    def _defaults(self) -> None:
        super()._defaults()
        self._setDefault(strategy="mean", addFlags=True, keyCols=[], seed=42)


class NumericImputerModel(Fitted, _Numeric):
    def __init__(self, **settings):
        super().__init__(**settings)
        self.points: dict | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values, fixed = self.values, self.getOrDefault("fixed")
        flags = {f"{c}_null": F.col(c).isNull().cast("int") for c, v in values.items() if v["flag"]}
        filled = {c: F.coalesce(F.col(c), F.lit(v["value"])) for c, v in values.items() if v.get("value") is not None}
        filled |= {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fixed.items()}
        out = dataset.withColumns(flags | filled) if flags or filled else dataset
        drawn = [c for c, v in values.items() if v.get("drawn")]
        return self._drawn(out, drawn) if drawn else out

    def _drawn(self, df: DataFrame, cols: list[str]) -> DataFrame:
        """Missing values drawn from the fitted distributions by interpolation at hash-based uniform numbers.

        A draw depends on the row's keys and the column only. Distributions of few points are searched inside the row; the others
        meet the missing cells in a sort.
        """
        points = self._points()
        few = [c for c in cols if c in points]
        many = [c for c in cols if c not in points]
        out = self._searched(df, {c: points[c] for c in few}) if few else df
        return self._sorted(out, many) if many else out

    def _points(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Ascending shares and values of every distribution with at most ``POINTS_IN_PLAN`` points."""
        if self.points is None:
            cdf = self.tables["cdf"]
            sizes = {r["feature"]: r["count"] for r in cdf.groupBy("feature").count().collect()}  # one row per feature
            few = [c for c, n in sizes.items() if n <= POINTS_IN_PLAN]
            found: dict[str, list] = {c: [] for c in few}
            for r in cdf.filter(F.col("feature").isin(few)).collect() if few else []:
                found[r["feature"]].append((r["share"], r["value"]))
            self.points = {c: tuple(np.array(sorted(p)).T) for c, p in found.items()}
        return self.points

    def _searched(self, df: DataFrame, points: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """Every missing cell looks up the first point not below its drawn share; no row moves."""
        seed, keys, cols = self.getOrDefault("seed"), self.getOrDefault("keyCols"), list(points)
        known = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(""))
        draws = F.pandas_udf(_draws(points, seed), ", ".join(f"d{i} double" for i in range(len(cols))))
        drawn = df.withColumn("__drawn", draws(known, *[F.col(c).isNull() for c in cols]))
        filled = {c: F.coalesce(F.col(c).cast("double"), F.col("__drawn")[f"d{i}"]) for i, c in enumerate(cols)}
        return drawn.withColumns(filled).select(*df.columns)

    def _sorted(self, df: DataFrame, cols: list[str]) -> DataFrame:
        """The missing cells of all columns are placed among the points of all distributions by one sort, and joined back by key.

        The draws are written once, so that later passes over the rows do not sort again.
        """
        cdf, keys = self.tables["cdf"].filter(F.col("feature").isin(cols)), self.getOrDefault("keyCols")
        # one row per feature
        first = cdf.groupBy("feature").agg(F.min("share").alias("first"))
        missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]), lambda c: c.isNotNull())
        wanted = df.select(*keys, F.explode(missing).alias("feature")).distinct().join(F.broadcast(first), "feature")
        uniform = hash_uniform(self.getOrDefault("seed"), *keys, F.col("feature"))
        placed = wanted.select(*keys, "feature", (F.col("first") + uniform * (1 - F.col("first"))).alias("share"))
        found = next_point(placed, cdf, "share", ["share", "value", "share_before", "value_before"], "cdf", ["feature"])
        step = F.try_divide(F.col("share") - F.col("cdf.share_before"), F.col("cdf.share") - F.col("cdf.share_before"))
        between = F.col("cdf.value_before") + (F.col("cdf.value") - F.col("cdf.value_before")) * step
        value = F.coalesce(between, F.col("cdf.value"))
        wide = found.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(
            *[F.max(F.when(F.col("feature") == c, value)).alias(f"__draw{i}") for i, c in enumerate(cols)]
        )
        same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
        joined = df.join(materialize(wide, "draws"), same, "left")
        filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"__draw{i}")) for i, c in enumerate(cols)}
        return joined.withColumns(filled).select(*df.columns)


class NumericImputer(Fit, _Numeric):
    """Mean, exact median, or a random draw from the column's own distribution; 0 where a column had no value at fit time.

    The distributions are a table of the model, one row per feature and distinct value, and stay exact at any size.
    """

    model_class = NumericImputerModel

    def fitted_values(self, df: DataFrame) -> dict:
        cols = [c for c in self.columns() if c not in self.getOrDefault("fixed")]
        strategy = self.getOrDefault("strategy")
        if strategy not in ("mean", "median", "random"):
            raise ValueError("strategy must be mean, median or random")
        if strategy == "random" and not self.getOrDefault("keyCols"):
            raise ValueError("a random draw needs keyCols; without them all missing values of a column would get the same one")
        if not cols:
            return {}
        nulls, flags, size = _null_counts(df, cols), self.getOrDefault("addFlags"), df.count()
        out = {c: {"flag": bool(flags and nulls[c] > 0)} for c in cols}
        # a column without a value has nothing to fill from
        empty = {c: out.pop(c) | {"value": 0.0} for c in cols if nulls[c] == size}
        return empty | self._found(df, [c for c in cols if c not in empty], strategy, out)

    def _found(self, df: DataFrame, cols: list[str], strategy: str, out: dict) -> dict:
        if not cols:
            return {}
        if strategy == "mean":
            means = column_aggregates(df, cols, {"mean": F.avg})
            return {c: v | {"value": means[c]["mean"]} for c, v in out.items()}
        dist = value_distribution(df, cols)
        if strategy == "median":
            middle = column_quantiles(dist, {"mid": 0.5})
            return {c: v | {"value": middle.get(c, {}).get("mid")} for c, v in out.items()}
        return {c: v | {"drawn": True} for c, v in out.items()} | {"cdf": _with_previous(dist)}


def _with_previous(dist: DataFrame) -> DataFrame:
    """``feature, value, share`` with the value and share of the point before."""
    shares = dist.select("feature", "value", (F.col("n_run") / F.col("n_all")).alias("share"))
    linked = previous_row(shares, ["feature"], ["value"], ["value", "share"], "before")
    return linked.select(
        "feature",
        "value",
        "share",
        F.col("before.value").alias("value_before"),
        F.col("before.share").alias("share_before"),
    )
