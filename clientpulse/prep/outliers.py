"""Outlier capping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.operators.ordered import quantile_columns, running_totals
from clientpulse.prep.base import Fit, Fitted, column_aggregates, column_quantiles, corrected_skew, value_distribution

# Limits of the outlier tests.
SYMMETRIC_SKEW = 1.0
TIGHT_SKEW = 0.7
TIGHT_Z, WIDE_Z, MODIFIED_Z = 2.0, 3.0, 8.0
MAD_SCALE = 0.6744897501960817
IQR_FENCE = 3.0


class OutlierCapperModel(Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = {}
        for c, v in self.values.items():
            x, lower, upper = F.col(c), F.lit(v["lower"]), F.lit(v["upper"])
            if v["symmetric"]:
                far = F.abs(x - v["centre"]) > v["limit"] * v["spread"] if v["spread"] else F.lit(False)
            else:
                usable = v["centre"] and v["spread"]
                far = F.abs(x - v["centre"]) > v["limit"] * v["spread"] if usable else F.lit(False)
            out[c] = F.when(far & (x < lower), lower).when(far & (x > upper), upper).otherwise(x)
        return dataset.withColumns(out) if out else dataset


class OutlierCapper(Fit):
    """Cap values that are extreme by both tests: distance from the centre, and percentile or quartile fence.

    Near-symmetric columns use mean and standard deviation, skewed ones median and median absolute deviation (skipped
    when the median is 0; a deviation of 0 marks nothing).
    """

    model_class = OutlierCapperModel

    def fitted_values(self, df: DataFrame) -> dict:
        cols = self.columns()
        if not cols:
            return {}
        basics = column_aggregates(
            df, cols, {"skew": corrected_skew, "mean": F.avg, "std": F.stddev, "min": F.min, "max": F.max}
        )
        dist = value_distribution(df, cols)
        quants = column_quantiles(dist, {"q01": 0.01, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q99": 0.99})
        medians = df.sparkSession.createDataFrame([(c, q["q2"]) for c, q in quants.items()], "feature string, mid double")
        # one row per column: bounded by the schema
        away = dist.join(F.broadcast(medians), "feature").select(
            "feature", F.abs(F.col("value") - F.col("mid")).alias("value"), "n"
        )
        spread = running_totals(away.groupBy("feature", "value").agg(F.sum("n").alias("n")), ["feature"], ["value"], ["n"])
        mads = {r["feature"]: r["mad"] for r in spread.groupBy("feature").agg(*quantile_columns("value", {"mad": 0.5})).collect()}
        out = {}
        for c, q in quants.items():
            b, fence = basics[c], IQR_FENCE * (q["q3"] - q["q1"])
            symmetric = b["skew"] is not None and abs(b["skew"]) < SYMMETRIC_SKEW
            low, high = q["q1"] - fence, q["q3"] + fence
            out[c] = {
                "symmetric": symmetric,
                "skew": b["skew"],
                "centre": b["mean"] if symmetric else q["q2"],
                "spread": b["std"] if symmetric else mads[c] / MAD_SCALE,
                "limit": (TIGHT_Z if abs(b["skew"]) > TIGHT_SKEW else WIDE_Z) if symmetric else MODIFIED_Z,
                "lower": q["q01"] if low < b["min"] else low,
                "upper": q["q99"] if high > b["max"] else high,
            }
        return out
