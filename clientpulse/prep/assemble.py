"""The vector a model sees: the listed columns and the null indicators that fitting added for them."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from clientpulse.prep.base import Fit, Fitted


class FeatureAssemblerModel(Fitted):
    @property
    def names(self) -> list[str]:
        """Columns of the vector, in its order."""
        return self.values["names"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.names, outputCol="features").transform(dataset)


class FeatureAssembler(Fit):
    """Assembles ``inputCols`` and every ``<col>_null`` that the imputers before it made of their nulls at fit time."""

    model_class = FeatureAssemblerModel

    def fitted_values(self, df: DataFrame) -> dict:
        cols = self.columns()
        return {"names": [*cols, *[f"{c}_null" for c in cols if f"{c}_null" in df.columns]]}
