"""Boosted trees that stop early: the best prefix of the trees by loss on validation rows.

Spark ends boosting at the first round that does not improve. Here boosting may get worse for ``patience`` rounds before it
is given up, and the rounds after the best one are cut off. Trees of a shorter run are the first trees of a longer one with the same
seed, so rounds are fitted in growing runs, which costs at most a constant factor of what the stopped run needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """Rounds up to the smallest loss seen before ``patience`` rounds passed without a smaller one, and whether they did."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def truncated(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model of the first ``rounds`` trees, with the params of the whole."""
    java, context = model._java_obj, SparkContext._active_spark_context
    gateway, jvm = context._gateway, context._jvm
    if not 1 <= rounds <= model.getNumTrees:
        raise ValueError(f"rounds must be from 1 to {model.getNumTrees}")
    trees, weights = java.trees(), java.treeWeights()
    kept = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    factors = gateway.new_array(jvm.double, rounds)
    for i in range(rounds):
        kept[i], factors[i] = trees[i], float(weights[i])
    short = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        java.uid(), kept, factors, java.numFeatures(), java.numClasses()
    )
    java.copyValues(short, jvm.org.apache.spark.ml.param.ParamMap())
    return GBTClassificationModel(short)


def validation_losses(model: GBTClassificationModel, valid: DataFrame) -> list[float]:
    """Mean loss on unweighted validation rows after every round."""
    return list(model.evaluateEachIteration(valid.withColumn("weight", F.lit(1.0))))


def fit_with_patience(
    booster: GBTClassifier, train: DataFrame, valid: DataFrame, patience: int = 50
) -> tuple[GBTClassificationModel, list[float]]:
    """The best prefix of at most ``maxIter`` rounds by loss on ``valid``, and the losses of all rounds that were fitted.

    ``valid`` needs the feature and label columns; without rows in it there is nothing to stop by and all rounds stay.
    """
    if patience < 1:
        raise ValueError("patience must be at least 1")
    limit = booster.getMaxIter()
    if valid.isEmpty():
        return booster.fit(train), []
    rounds = min(limit, 2 * patience)
    while True:
        model = booster.copy({booster.maxIter: rounds}).fit(train)
        losses = validation_losses(model, valid)
        best, stopped = best_round(losses, patience)
        if stopped or rounds >= limit:
            return truncated(model, best), losses
        rounds = min(limit, 2 * rounds)
