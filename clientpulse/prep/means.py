"""Training means of the assembled features, kept in the pipeline as the baseline of linear contributions."""

from __future__ import annotations

from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.prep.base import Fit, Fitted


class FeatureMeansModel(Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset


class FeatureMeans(Fit):
    """Leaves the rows as they are and remembers the mean of the ``features`` vector."""

    model_class = FeatureMeansModel

    def fitted_values(self, df: DataFrame) -> dict:
        means = df.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"]
        return {"means": [float(v) for v in means]}
