"""Additive contributions and the reasons derived from them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientpulse.operators.sampling import fraction_sample
from clientpulse.plans.models import feature_names
from clientpulse.prep import FeatureMeansModel
from clientpulse.session import scratch_path

# The direction marks of a reason.
UP, DOWN = "↑", "↓"
NODES_PER_PASS = 500_000


def _packed(features: Sequence[str], values: Sequence[Column], parts: Sequence[Column]) -> Column:
    """Array of (feature, value, contribution): as long as the feature list, and kept inside the row."""
    return F.array(
        *[
            F.struct(F.lit(f).alias("feature"), v.cast("double").alias("value"), p.cast("double").alias("contribution"))
            for f, v, p in zip(features, values, parts)
        ]
    )


def linear_contributions(
    df: DataFrame, keys: Sequence[str], weights: dict[str, float], means: dict[str, float] | None = None
) -> DataFrame:
    """``keys, contribs`` with weight * (x - mean) per feature; they add up to the score minus the mean score.

    Without given ``means``, those of ``df`` are used.
    """
    features = list(weights)
    if means is None:
        means = df.agg(F.struct(*[F.avg(f).alias(f) for f in features]).alias("m")).scalar()
    else:
        means = F.struct(*[F.lit(float(means[f])).alias(f) for f in features])
    with_means = df.withColumn("__m", means)
    parts = [F.lit(float(weights[f])) * (F.col(f) - F.col("__m")[f]) for f in features]
    return with_means.select(*keys, _packed(features, [F.col(f) for f in features], parts).alias("contribs"))


def tree_nodes(model, spark) -> pd.DataFrame:
    """Node table of a forest or boosted model, in the layout Spark saves: one row per node, model-sized.

    ``cover`` is the weight of the training rows that reached the node.
    """
    path = scratch_path(spark, "trees")
    model.write().save(path)
    node = F.col("nodeData")
    if isinstance(model, RandomForestClassificationModel):
        cover = F.aggregate(node["impurityStats"], F.lit(0.0), lambda a, x: a + x)
        value = F.get(node["impurityStats"], F.lit(1)) / cover
    else:
        value, cover = node["prediction"], F.get(node["impurityStats"], F.lit(0))
    rows = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        value.alias("value"),
        cover.alias("cover"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["split"]["numCategories"].alias("categories"),
    )
    nodes = rows.toPandas().sort_values(["tree", "node"], ignore_index=True)
    if (nodes["categories"] > 0).any():
        raise ValueError("only splits on numbers can be attributed")
    return nodes


def _node_chunks(nodes: pd.DataFrame, weights: np.ndarray) -> Iterator[list[tuple]]:
    """Trees as arrays, in chunks of bounded size, so what is sent to a task never grows with the forest."""
    chunk, size = [], 0
    for tree, part in nodes.groupby("tree", sort=True):
        arrays = tuple(part[c].to_numpy() for c in ("left", "right", "feature", "threshold", "value", "cover"))
        if chunk and size + len(part) > NODES_PER_PASS:
            yield chunk
            chunk, size = [], 0
        chunk.append((float(weights[int(tree)]), *arrays))
        size += len(part)
    yield chunk


def leaf_rules(tree: tuple) -> Iterator[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per leaf its weighted value and, per feature on its path: the feature, bounds (low, high] and the share of cover kept.

    A feature met more than once on a path has the intersection of its intervals and the product of its shares.
    """
    weight, left, right, feature, threshold, value, cover = tree
    pending = [(0, {})]
    while pending:
        node, path = pending.pop()
        if left[node] < 0:
            rules = [(f, low, high, share) for f, (low, high, share) in path.items()]
            f, low, high, share = (np.array(c) for c in zip(*rules)) if rules else (np.zeros(0),) * 4
            yield weight * value[node], f.astype(np.int64), low, high, share
            continue
        f, cut = int(feature[node]), float(threshold[node])
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        for child, bounds in ((left[node], (low, min(high, cut))), (right[node], (max(low, cut), high))):
            kept = share * cover[child] / cover[node] if cover[node] > 0 else 0.0
            pending.append((int(child), path | {f: (*bounds, kept)}))


def expected_value(trees: list[tuple]) -> float:
    """Mean of the leaves, each weighted by its share of the cover."""
    return math.fsum(value * float(np.prod(share)) for tree in trees for value, _, _, _, share in leaf_rules(tree))


def _distinct_rows(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of flags and where each row is among them; as many flags as a whole number has bits are compared at once."""
    width = flags.shape[1]
    if width > 62:
        return np.unique(flags, axis=0, return_inverse=True)
    bits = np.arange(width)
    codes, which = np.unique(flags @ (1 << bits), return_inverse=True)
    return (codes[:, None] >> bits & 1).astype(bool), which


def attribute(x: np.ndarray, trees: list[tuple], out: np.ndarray) -> np.ndarray:
    """Add the exact Shapley values of all rows, with features that are left out following the cover.

    On the path to a leaf let o be 1 for a feature whose interval holds the row's value, else 0, and z its share of the cover. The
    leaf is worth v times the product of o over known and z over unknown features, so the value of feature i is

        v (o_i - z_i) * integral over t from 0 to 1 of the product over j <> i of (t o_j + (1 - t) z_j),

    a polynomial in t that Gauss-Legendre nodes integrate exactly. Rows that agree in all o of a leaf share one evaluation.
    """
    for tree in trees:
        for value, feature, low, high, share in leaf_rules(tree):
            d = len(feature)
            if not d:
                continue
            mine = x[:, feature]
            inside = ~(mine <= low) & ((mine <= high) | np.isinf(high))  # a missing value goes right, as in the model
            patterns, which = _distinct_rows(inside)
            at, weight = np.polynomial.legendre.leggauss(d // 2 + 1)
            t = (at + 1)[:, None, None] / 2
            terms = t * patterns + (1 - t) * share
            before, after = np.ones_like(terms), np.ones_like(terms)
            before[..., 1:] = np.cumprod(terms[..., :-1], axis=2)
            after[..., :-1] = np.cumprod(terms[..., :0:-1], axis=2)[..., ::-1]
            others = np.tensordot(weight / 2, before * after, axes=1)
            out[:, feature] += (value * (patterns - share) * others)[which.reshape(-1)]
    return out


def tree_contributions(df: DataFrame, keys: Sequence[str], model, features: Sequence[str]) -> DataFrame:
    """``keys, base, contribs`` of a forest (probability of class 1) or boosted model (margin).

    Contributions are exact Shapley values of the trees with their training cover; ``base`` is the model's expected score, and base
    plus contributions is the row's score. ``df`` holds the assembled ``features`` vector. The reported values come from an array
    column ``shown`` where there is one, else from the vector.
    """
    spark, features = df.sparkSession, list(features)
    nodes = tree_nodes(model, spark)
    if isinstance(model, RandomForestClassificationModel):
        weights = np.full(nodes["tree"].nunique(), 1.0 / nodes["tree"].nunique())
    elif isinstance(model, GBTClassificationModel):
        weights = np.asarray(model.treeWeights)
    else:
        raise TypeError("a forest or boosted-tree classifier is needed")
    base = sum(expected_value(chunk) for chunk in _node_chunks(nodes, weights))
    shown = ["shown"] if "shown" in df.columns else []
    rows = df.select(*keys, vector_to_array("features").alias("x"), *shown)
    rows = rows.withColumn("parts", F.transform("x", lambda _: F.lit(0.0)))
    schema = T.StructType(rows.schema.fields)
    for chunk in _node_chunks(nodes, weights):
        sent = spark.sparkContext.broadcast(chunk)

        def added(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x, parts = np.stack(batch["x"].to_numpy()), np.stack(batch["parts"].to_numpy()).copy()
                    yield batch.assign(parts=list(attribute(x, sent.value, parts)))

        rows = rows.mapInPandas(added, schema)
    at = [F.lit(i) for i in range(len(features))]
    values = [F.get("shown" if shown else "x", i) for i in at]
    packed = _packed(features, values, [F.get("parts", i) for i in at])
    return rows.select(*keys, F.lit(base).alias("base"), packed.alias("contribs"))


def contributions(
    df: DataFrame, keys: Sequence[str], model, features: Sequence[str], means: Sequence[float] | None = None
) -> DataFrame:
    """Contributions of any of the three model families over an assembled ``features`` vector; ``means`` are a linear model's baseline."""
    if not isinstance(model, LogisticRegressionModel):
        return tree_contributions(df, keys, model, features).drop("base")
    shown = ["shown"] if "shown" in df.columns else []
    names = [f"__x{i}" for i in range(len(features))]
    wide = df.withColumns({n: F.get(vector_to_array("features"), F.lit(i)) for i, n in enumerate(names)})
    baseline = None if means is None else dict(zip(names, means, strict=True))
    scored = linear_contributions(wide, [*keys, *shown], dict(zip(names, map(float, model.coefficients))), baseline)
    parts = [F.get("contribs", F.lit(i)) for i in range(len(features))]
    values = [F.get("shown", F.lit(i)) if shown else p["value"] for i, p in enumerate(parts)]
    return scored.select(*keys, _packed(features, values, [p["contribution"] for p in parts]).alias("contribs"))


def explain(
    wanted: DataFrame,
    master: DataFrame,
    models: dict[int, PipelineModel],
    keys: Sequence[str],
    time_col: str = "mon",
) -> DataFrame:
    """``keys, product_id, contribs`` of the wanted (client, product) pairs, each by its product's own pipeline.

    Each client is explained at its latest month, by the features its product's model sees. The values reported are the raw ones
    of the master table, not the encoded and scaled ones; of a null indicator, whether the value is missing. A linear model's baseline is
    the training mean kept in its pipeline, so it does not depend on who asks.
    """
    newest = F.row_number().over(W.partitionBy("client_id").orderBy(F.desc(time_col)))  # one row per client and month
    out = None
    for product, model in models.items():
        features = feature_names(model)
        raw = F.array(*[_raw(master, f) for f in features]).alias("shown")
        clients = wanted.filter(F.col("product_id") == product).select("client_id").distinct()
        rows = master.join(clients, "client_id", "left_semi").withColumn("__place", newest).filter("__place = 1").drop("__place").select("*", raw)
        prepared = PipelineModel(model.stages[:-1]).transform(rows)
        means = next((s.values["means"] for s in model.stages if isinstance(s, FeatureMeansModel)), None)
        if means is None and isinstance(model.stages[-1], LogisticRegressionModel):
            raise ValueError("the pipeline keeps no training means; fit it with models.train")
        part = contributions(prepared, keys, model.stages[-1], features, means).withColumn("product_id", F.lit(product))
        out = part if out is None else out.unionByName(part)
    return out


def _raw(master: DataFrame, feature: str) -> Column:
    if feature not in master.columns and feature.endswith("_null"):
        return F.col(feature.removesuffix("_null")).isNull().cast("double")
    return F.col(feature).try_cast("double")


def top_reasons(contribs: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` features with the largest absolute contribution as text, inside the row and without a shuffle; null ones come last."""
    ordered = F.sort_array(
        F.transform(
            "contribs", lambda c: F.struct(F.coalesce(-F.abs(c["contribution"]), F.lit(math.inf)).alias("size"), c["feature"].alias("feature"), c.alias("c"))
        )
    )
    mark = lambda c: F.when(c["contribution"] > 0, UP).otherwise(DOWN)
    text = F.transform(
        F.slice(ordered, 1, k),
        lambda t: F.concat(
            mark(t["c"]),
            F.lit(" "),
            t["c"]["feature"],
            F.lit(" = "),
            F.coalesce(F.round(t["c"]["value"], 4).cast("string"), F.lit("nan")),
        ),
    )
    return contribs.withColumn("reasons", text).drop("contribs")


def build_reasons(
    positives: DataFrame,
    contribs: DataFrame,
    k: int = 2,
    fraction: float = 1.0,
    seed: int = 42,
    clients: DataFrame | None = None,
) -> DataFrame:
    """``client_id, product_id, reasons`` for recommended pairs, optionally for some clients or a share of them.

    ``contribs`` is keyed by client and product. The sample is drawn per client and product by key hash.
    """
    keys = ["client_id", "product_id"]
    wanted = positives.select(*keys).distinct()
    if clients is not None:
        wanted = wanted.join(clients.select("client_id").distinct(), "client_id", "left_semi")
    sampled = fraction_sample(wanted, keys, fraction, seed)
    return top_reasons(contribs, k).join(sampled, keys, "left_semi")  # two texts move instead of all contributions


def complete_reasons(positives: DataFrame, reasons: DataFrame, contribs: DataFrame, k: int = 2) -> DataFrame:
    """The stored reasons plus those of every recommended pair that has none yet."""
    keys = ["client_id", "product_id"]
    missing = positives.select(*keys).distinct().join(reasons.select(*keys), keys, "left_anti")
    return reasons.unionByName(build_reasons(missing, contribs, k))


def global_reasons(reasons: DataFrame) -> DataFrame:
    """``product_id, direction, feature, n``: how often a feature is a reason, up or down."""
    one = reasons.select("product_id", F.explode("reasons").alias("r"))
    return (
        one.select(
            "product_id",
            F.when(F.substring("r", 1, 1) == UP, "up").otherwise("down").alias("direction"),
            F.trim(F.substring_index(F.expr("substring(r, 3)"), " = ", 1)).alias("feature"),
        )
        .groupBy("product_id", "direction", "feature")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_global(counts: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most common features per product and direction."""
    order = W.partitionBy("product_id", "direction").orderBy(F.desc("n"), "feature")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def global_importance(contribs: DataFrame, top: int = 40) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    long = contribs.select(F.inline("contribs"))
    means = long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
    return means.orderBy(F.desc("importance"), "feature").limit(top)
