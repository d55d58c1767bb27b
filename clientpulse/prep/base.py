"""Shared pieces of the preprocessing stages."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientpulse.operators.ordered import distribution, quantile_columns
from clientpulse.session import materialize


class Stage(Params):
    """A stage whose settings are params, so Spark ML's own save and load apply."""

    inputCols = Param(Params._dummy(), "inputCols", "columns to treat", TypeConverters.toListString)
    excludeCols = Param(Params._dummy(), "excludeCols", "columns to leave alone", TypeConverters.toListString)

    def __init__(self, **settings):
        super().__init__()
        self._setDefault(inputCols=[], excludeCols=[])
        self._defaults()
        self._set(**{k: v for k, v in settings.items() if v is not None})

    def _defaults(self) -> None:
        pass

    def columns(self) -> list[str]:
        excluded = set(self.getOrDefault("excludeCols"))
        return [c for c in self.getOrDefault("inputCols") if c not in excluded]


class Fit(Stage, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator that turns a DataFrame into a dict of fitted values.

    Values that are DataFrames (one row per level or per point of a distribution, so as large as the data makes them) become
    tables of the model: written once under the shared folder while it lives, and into its own folder when it is saved.
    """

    model_class: type

    def fitted_values(self, df: DataFrame) -> dict:
        raise NotImplementedError

    def _fit(self, dataset: DataFrame):
        model = self.model_class()
        shared = {p.name: v for p, v in self.extractParamMap().items() if model.hasParam(p.name)}
        found = self.fitted_values(dataset)
        model.tables = {k: materialize(v, k) for k, v in found.items() if isinstance(v, DataFrame)}
        plain = {k: v for k, v in found.items() if k not in model.tables}
        model._set(**shared, fitted=plain, tableNames=sorted(model.tables))
        return model


class _TableWriter(DefaultParamsWriter):
    """Params as Spark ML saves them, and the model's tables beside them."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        for name, table in self.instance.tables.items():
            table.write.parquet(f"{path}/tables/{name}")


class _TableReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        session = SparkSession.active()
        model.tables = {n: session.read.parquet(f"{path}/tables/{n}") for n in model.getOrDefault("tableNames")}
        return model


class Fitted(Stage, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Model holding fitted values as one JSON-ready param, and fitted tables that are saved inside its folder."""

    fitted = Param(Params._dummy(), "fitted", "fitted values", TypeConverters.identity)
    tableNames = Param(Params._dummy(), "tableNames", "tables saved with the model", TypeConverters.toListString)

    def __init__(self, **settings):
        super().__init__(**settings)
        self._setDefault(tableNames=[])
        self.tables: dict[str, DataFrame] = {}

    def write(self) -> DefaultParamsWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> DefaultParamsReader:
        return _TableReader(cls)

    @property
    def values(self) -> dict:
        return self.getOrDefault("fitted")

    def table(self, spark) -> DataFrame:
        """Fitted values as ``feature, fitted`` rows, the values as JSON."""
        rows = [(k, json.dumps(v, ensure_ascii=False)) for k, v in self.values.items()]
        return spark.createDataFrame(rows, "feature string, fitted string")


def corrected_skew(col: str) -> Column:
    """Bias-corrected sample skewness."""
    n = F.count(col).cast("double")
    return F.skewness(col) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)


def column_aggregates(df: DataFrame, cols: Sequence[str], measures: dict) -> dict[str, dict]:
    """``{column: {measure: value}}`` from one pass; ``measures`` maps a name to a column-name -> aggregate function."""
    if not cols:
        return {}
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    row = typed.agg(*[fn(c).alias(f"{c}|{m}") for c in cols for m, fn in measures.items()]).first()
    return {c: {m: row[f"{c}|{m}"] for m in measures} for c in cols}


def value_distribution(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cumulated counts per distinct value of every column."""
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return distribution(typed.unpivot([], list(cols), "feature", "value"), ["feature"], "value")


def column_quantiles(dist: DataFrame, probs: dict[str, float]) -> dict[str, dict]:
    rows = dist.groupBy("feature").agg(*quantile_columns("value", probs)).collect()
    return {r["feature"]: {p: r[p] for p in probs} for r in rows}
