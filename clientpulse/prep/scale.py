"""Signed log, scaling and column selection."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from clientpulse.functions.scalars import signed_log
from clientpulse.prep.base import Fit, Fitted, Stage, column_aggregates, column_quantiles, corrected_skew, value_distribution


class ColumnPicker(Stage, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Keep the listed columns; a missing one is an error. Optional ones (a target) are kept where they exist."""

    optionalCols = Param(Params._dummy(), "optionalCols", "kept if present", TypeConverters.toListString)

    def _defaults(self) -> None:
        self._setDefault(optionalCols=[])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        extra = [c for c in self.getOrDefault("optionalCols") if c in dataset.columns]
        return dataset.select(*self.columns(), *extra)


class _Threshold(Stage):
    threshold = Param(Params._dummy(), "threshold", "absolute skew above which to transform", TypeConverters.toFloat)

    def _defaults(self) -> None:
        self._setDefault(threshold=1.5)


class SignedLogModel(Fitted, _Threshold):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        chosen = [c for c, v in self.values.items() if v["apply"]]
        return dataset.withColumns({c: signed_log(c) for c in chosen}) if chosen else dataset


class SignedLog(Fit, _Threshold):
    """sign(x) ln(1 + |x|) on the columns whose skewness exceeds the threshold."""

    model_class = SignedLogModel

    def fitted_values(self, df: DataFrame) -> dict:
        limit = self.getOrDefault("threshold")
        skews = column_aggregates(df, self.columns(), {"skew": corrected_skew})
        return {c: {"skew": v["skew"], "apply": abs(v["skew"] or 0.0) > limit} for c, v in skews.items()}


class _Kind(Stage):
    kind = Param(Params._dummy(), "kind", "standard or robust", TypeConverters.toString)
    maxCategories = Param(Params._dummy(), "maxCategories", "fewer distinct values are a category", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(kind="robust", maxCategories=5)


class ScalerModel(Fitted, _Kind):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        scaled = {c: (F.col(c) - v["centre"]) / v["spread"] for c, v in self.values.items()}
        return dataset.withColumns(scaled) if scaled else dataset


class Scaler(Fit, _Kind):
    """(x - mean) / population std, or (x - median) / IQR; a zero spread divides by 1.

    Without ``inputCols`` every number with at least ``maxCategories`` distinct values is scaled.
    """

    model_class = ScalerModel

    def fitted_values(self, df: DataFrame) -> dict:
        cols = self.columns() or self._continuous(df)
        if not cols:
            return {}
        if self.getOrDefault("kind") == "standard":
            found = column_aggregates(df, cols, {"centre": F.avg, "spread": F.stddev_pop})
        else:
            quants = column_quantiles(value_distribution(df, cols), {"q1": 0.25, "q2": 0.5, "q3": 0.75})
            found = {c: {"centre": q["q2"], "spread": q["q3"] - q["q1"]} for c, q in quants.items()}
        return {c: {"centre": v["centre"] or 0.0, "spread": v["spread"] or 1.0} for c, v in found.items()}

    def _continuous(self, df: DataFrame) -> list[str]:
        excluded = set(self.getOrDefault("excludeCols"))
        numbers = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in excluded]
        if not numbers:
            return []
        row = df.agg(*[F.count_distinct(c).alias(c) for c in numbers]).first()
        return [c for c in numbers if row[c] >= self.getOrDefault("maxCategories")]
