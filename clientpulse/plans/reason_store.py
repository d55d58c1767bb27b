"""Reasons that are computed when they are first asked for and kept per model version."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientpulse.plans.reasons import build_reasons

KEYS = ["client_id", "product_id"]


class ReasonStore:
    """A table of reasons by model version, client and product, to which runs add what was missing.

    A run writes a folder of its own, so two runs never touch each other's files; if both computed a pair, the later one counts. Another
    model version has rows of its own, so a new model never answers with an old one's reasons.
    """

    def __init__(self, spark: SparkSession, root: str, version: int):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version
        self.path = f"{self.root}/version={version}"

    def read(self) -> DataFrame | None:
        """``client_id, product_id, reasons, run``: the latest row of each pair; None before anything was kept."""
        try:
            rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        except AnalysisException:
            return None
        newest = F.max_by(F.struct("reasons", "run"), F.struct("run", "folder")).alias("kept")
        return rows.groupBy(*KEYS).agg(newest).select(*KEYS, "kept.reasons", "kept.run")

    def complete(self, wanted: DataFrame, contribs: DataFrame, k: int = 2) -> DataFrame:
        """Reasons of all wanted pairs; those not kept yet are computed from ``contribs`` and kept first."""
        pairs, known = wanted.select(*KEYS).distinct(), self.read()
        missing = pairs if known is None else pairs.join(known.select(*KEYS), KEYS, "left_anti")
        run = 1 if known is None else 1 + (known.agg(F.max("run")).first()[0] or 0)
        fresh = build_reasons(missing, contribs, k).withColumn("run", F.lit(run))
        fresh.write.mode("overwrite").parquet(f"{self.path}/folder={run:08d}-{uuid.uuid4().hex}")
        return self.read().join(pairs, KEYS, "left_semi")

    def compact(self) -> None:
        """Put the kept rows of all runs into one folder; earlier folders are left for readers and can be removed afterwards."""
        known = self.read()
        if known is not None:
            last = known.agg(F.max("run")).first()[0]
            known.write.mode("overwrite").parquet(f"{self.path}/folder={last:08d}-{uuid.uuid4().hex}")
