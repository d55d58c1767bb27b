"""Preparation per product, training, comparison over folds, persistence, scoring."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date
from functools import partial, reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientpulse.operators.folds import MONTHS, calendar
from clientpulse.operators.metrics import decide, ranking_metrics, score_histogram
from clientpulse.operators.sampling import balanced_weight
from clientpulse.plans.boosting import fit_with_patience
from clientpulse.prep import (
    CategoryImputer,
    ColumnPicker,
    FeatureAssembler,
    FeatureAssemblerModel,
    FeatureMeans,
    NumericImputer,
    OutlierCapper,
    Scaler,
    SignedLog,
    WoeEncoder,
)
from clientpulse.session import materialize

FAMILIES = {"forest": RandomForestClassifier, "boosted": GBTClassifier, "logistic": LogisticRegression}
# Decision thresholds and the model family chosen per product.
THRESHOLDS = {1: 0.45454545454545453, 3: 0.43434343434343436, 4: 0.5}
CHOSEN = {1: "forest", 3: "boosted", 4: "boosted"}
PARALLEL_FITS = 4
ROWS_AT_ONCE = 4_000_000
ROWS_PER_TASK = 250_000
OWN_SETTINGS = ("weight_root", "balanced", "inverse_strength")


@dataclass(frozen=True)
class Preparation:
    """How the columns of one product's model are treated."""

    uncapped: Sequence[str] = ()
    category_fills: Mapping[str, Any] = field(default_factory=dict)
    number_fills: Mapping[str, float] = field(default_factory=dict)
    unencoded: Sequence[str] = ()
    imputation: str = "median"
    null_flags: bool = False
    min_share: float = 0.05
    similarity: float = 0.1
    max_skew: float = 1.5
    scaler: str = "robust"


def _of_product(category_fills: Mapping[str, Any]) -> Preparation:
    """Columns with a fixed fill are indicators already: they keep their numbers."""
    return Preparation(
        uncapped=("trans_type_currency_cnt_m",),
        category_fills=category_fills,
        number_fills={"trans_type_currency_cnt_m": 1.0},
        unencoded=tuple(category_fills),
        imputation="random",
        null_flags=True,
        min_share=0.1,
        max_skew=1.0,
        scaler="standard",
    )


# The categories that are filled with 0, per product.
PREPARATIONS = {
    1: _of_product({"pur_any_purchase": 0}),
    3: _of_product({"pur_any_purchase": 0, "trx_growth_streak_3m": 0}),
    4: _of_product({"trx_growth_streak_3m": 0}),
}


def preparation_stages(
    ids: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], target: str, how: Preparation
) -> list:
    """Stages in order: select, cap outliers, fill categories, fill numbers, encode, signed log, scale, assemble.

    Settings for columns that are not among the given ones are left out. Random draws are fixed by the ids.
    """
    numeric, categorical = list(numeric), list(categorical)
    own = lambda names: {c: v for c, v in names.items() if c in numeric or c in categorical}
    encoded = [c for c in categorical if c not in how.unencoded]
    return [
        ColumnPicker(inputCols=[*ids, *numeric, *categorical], optionalCols=[target, "weight", "shown"]),
        OutlierCapper(inputCols=numeric, excludeCols=[c for c in how.uncapped if c in numeric]),
        CategoryImputer(inputCols=categorical, fixed=own(how.category_fills)),
        NumericImputer(
            inputCols=numeric, strategy=how.imputation, addFlags=how.null_flags, fixed=own(how.number_fills), keyCols=list(ids)
        ),
        WoeEncoder(categoricalCols=encoded, targetCol=target, minShare=how.min_share, similarity=how.similarity),
        SignedLog(inputCols=numeric, threshold=how.max_skew),
        Scaler(inputCols=numeric, kind=how.scaler),
        FeatureAssembler(inputCols=[*numeric, *categorical])
        if how.null_flags
        else VectorAssembler(inputCols=[*numeric, *categorical], outputCol="features"),
    ]


def preprocessing(
    ids: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str],
    target: str,
    uncapped: Sequence[str] = (),
    scaler: str = "robust",
) -> list:
    """The stages with settings of no product in particular: medians, no null indicators."""
    return preparation_stages(ids, numeric, categorical, target, Preparation(uncapped=uncapped, scaler=scaler))


def product_preprocessing(product: int, ids: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], target: str) -> list:
    """The stages as the product's own model has them."""
    return preparation_stages(ids, numeric, categorical, target, PREPARATIONS[product])


def feature_names(model: PipelineModel) -> list[str]:
    """Columns of the vector that the pipeline's classifier sees, in its order."""
    for stage in model.stages:
        if isinstance(stage, FeatureAssemblerModel):
            return stage.names
        if isinstance(stage, VectorAssembler):
            return list(stage.getInputCols())
    raise ValueError("the pipeline assembles no features")


def classifier(family: str, target: str, seed: int = 42, **params):
    """Spark's classifier of a family; settings that are not Spark's are applied by ``fitted``."""
    params = {k: v for k, v in params.items() if k not in OWN_SETTINGS}
    seeded = {} if family == "logistic" else {"seed": seed}
    return FAMILIES[family](featuresCol="features", labelCol=target, weightCol="weight", **seeded, **params)


def class_counts(df: DataFrame, target: str) -> tuple[int, int, int]:
    """Rows of class 0, of class 1 and in all."""
    return tuple(df.agg(F.count_if(F.col(target) == 0), F.count_if(F.col(target) == 1), F.count(F.lit(1))).first())


def weighted(
    df: DataFrame, target: str, weight_root: int | None = 1, balanced: bool = False, counts: tuple[int, int, int] | None = None
) -> DataFrame:
    """``weight``: (n0/n1)^(1/weight_root) for positives (1 without a root), times n / 2n_class if classes are balanced.

    With the rows' known ``class_counts`` no pass over them is needed.
    """
    if counts is not None:
        return df.withColumn("weight", _weight(F.col(target), weight_root, balanced, counts))
    rows = balanced_weight(df, target, weight_root) if weight_root else df.withColumn("weight", F.lit(1.0))
    if not balanced:
        return rows
    shares = df.agg(F.count_if(F.col(target) == 0).alias("n0"), F.count_if(F.col(target) == 1).alias("n1"))
    share = shares.select(F.struct("n0", "n1").alias("s")).scalar()
    own = F.when(F.col(target) == 1, share["n1"]).otherwise(share["n0"])
    return rows.withColumn("weight", F.col("weight") * (share["n0"] + share["n1"]) / (2 * own))


def _classes(n0: int, n1: int, n: int) -> int:
    return (n0 > 0) + (n1 > 0) + (n > n0 + n1)


def _weight(label: Column, weight_root: int | None, balanced: bool, counts: tuple[int, int, int]) -> Column:
    n0, n1, _ = counts
    ratio = F.lit(n0 / n1 if n1 else None).cast("double")
    weight = F.when(label == 1, F.pow(ratio, F.lit(1.0 / weight_root))).otherwise(1.0) if weight_root else F.lit(1.0)
    if not balanced:
        return weight
    own = F.when(label == 1, F.lit(n1).cast("long")).otherwise(F.lit(n0).cast("long"))
    return weight * F.lit(n0 + n1).cast("long") / (2 * own)


def _total_weight(rows: DataFrame, weight_root: int | None, balanced: bool, counts: tuple[int, int, int] | None) -> float:
    """Sum of the weights; with known counts from one row of each class."""
    if counts is None:
        return rows.agg(F.sum("weight")).first()[0]
    n0, n1, n = counts
    one = (n0 / n1) ** (1.0 / weight_root) if weight_root and n1 else 1.0
    factors = [(n0 + n1) / (2 * size) if size else 0.0 for size in (n0, n1)] if balanced else [1.0, 1.0]
    return (n - n1) * factors[0] + n1 * one * factors[1]


def fitted(
    family: str,
    rows: DataFrame,
    target: str,
    seed: int = 42,
    valid: DataFrame | None = None,
    patience: int | None = None,
    counts: tuple[int, int, int] | None = None,
    **params,
):
    """A classifier fitted on prepared rows.

    ``weight_root`` and ``balanced`` set the row weights. ``inverse_strength`` c penalises by 1 / (c * total weight), so that the
    penalty counts as c times less than one row's loss. Trials on the same rows share their ``class_counts``. A boosted model with ``patience`` keeps the best rounds on ``valid``.
    """
    how = params.get("weight_root", 1), params.get("balanced", False)
    rows = weighted(rows, target, *how, counts)
    if "inverse_strength" in params:
        total = _total_weight(rows, *how, counts)
        params = params | {"regParam": 1.0 / (params["inverse_strength"] * total)}
    model = classifier(family, target, seed, **params)
    if family == "boosted" and patience and valid is not None:
        return fit_with_patience(model, rows, valid.select("features", target), patience)[0]
    return model.fit(rows)


def train(
    df: DataFrame, stages: Sequence, family: str, target: str, weight_root: int | None = 1, seed: int = 42, **params
) -> PipelineModel:
    """Preprocessing and classifier as one pipeline; positives weighted by (n0/n1)^(1/weight_root).

    The classifier passes over its rows many times, so the prepared ones are written once.
    """
    rows = weighted(df, target, weight_root, params.get("balanced", False))
    baseline = [FeatureMeans()] if family == "logistic" else []
    prepared = Pipeline(stages=[*stages, *baseline]).fit(rows)
    seen = materialize(prepared.transform(rows).select("features", target, "weight"), "prepared")
    return PipelineModel([*prepared.stages, classifier(family, target, seed, **params).fit(seen)])


def fits_at_once(spark: SparkSession, rows: int) -> int:
    """How many fits over at most so many rows run together: few large ones, as each keeps its rows; small ones wait more than they
    work, so there is one for each core."""
    return max(PARALLEL_FITS, min(spark.sparkContext.defaultParallelism, ROWS_AT_ONCE // max(rows, 1)))


def run_all(jobs: Mapping[Any, Callable[[], Any]], at_once: int = PARALLEL_FITS) -> dict[Any, Any]:
    """Run independent fits from a few threads, so that small ones share the cluster; results by key."""
    with ThreadPoolExecutor(at_once) as pool:
        pending = {key: pool.submit(inheritable_thread_target(job)) for key, job in jobs.items()}
        return {key: result.result() for key, result in pending.items()}


def prefix(model: PipelineModel) -> PipelineModel:
    """The fitted preprocessing without the classifier."""
    return PipelineModel(model.stages[:-1])


def score(df: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """Add ``prob`` of class 1 and ``pred`` = 1 where it is strictly above the threshold."""
    scored = model.transform(df).withColumn("prob", F.get(vector_to_array("probability"), F.lit(1)))
    return decide(scored, "prob", threshold).drop("rawPrediction", "probability", "prediction")


def fold_cuts(df: DataFrame, time_col: str, freq: str = "monthly", last: int | None = None) -> list[date]:
    """Back-test dates inside the data (one per period, so a short list), optionally only the last few."""
    bounds = df.agg(F.add_months(F.min(time_col), 1).alias("start"), F.max(time_col).alias("end"))
    cuts = sorted(r["cut"] for r in calendar(bounds, freq).collect())
    return cuts[-last:] if last else cuts


def fold_parts(
    df: DataFrame, time_col: str, cut: date, freq: str = "monthly", span: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one fold as plain range filters; expanding unless a span in months is given."""
    at, t = F.lit(cut), F.col(time_col)
    end = F.date_add(at, 7) if freq == "weekly" else F.add_months(at, MONTHS[freq])
    train_rows = df.filter(t < at) if span is None else df.filter((t >= F.add_months(at, -span)) & (t < at))
    return train_rows, df.filter((t >= at) & (t < end))


def prepared_fold(
    df: DataFrame, time_col: str, cut: date, stages: Sequence, freq: str = "monthly", span: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both parts with the preprocessing fitted on this fold's training rows only, written once for all trials."""
    train_rows, test_rows = fold_parts(df, time_col, cut, freq, span)
    ends = train_rows.agg(F.max(time_col).alias("last")).crossJoin(test_rows.agg(F.min(time_col).alias("first"))).first()  # one row each
    if ends["last"] is not None and ends["first"] is not None and ends["last"] >= ends["first"]:
        raise ValueError(f"training rows up to {ends['last']} reach into the test period from {ends['first']}")
    prepared, seen = fitted_stages(stages, train_rows)
    return tuple(few_tasks(materialize(part, "fold")) for part in (seen, prepared.transform(test_rows)))


def fitted_stages(stages: Sequence, rows: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """The stages fitted one after the other, and the rows as they leave the last.

    Rows with random draws are written once: each later stage passes over them to be fitted and would draw again.
    """
    models = []
    for stage in stages:
        models.append(stage.fit(rows) if isinstance(stage, Estimator) else stage)
        rows = models[-1].transform(rows)
        if isinstance(stage, NumericImputer) and any(v.get("drawn") for v in models[-1].values.values()):
            rows = materialize(rows, "filled")
    return PipelineModel(models), rows


def few_tasks(df: DataFrame) -> DataFrame:
    """The rows in no more tasks than ``ROWS_PER_TASK`` rows each make: fits pass over a fold hundreds of times, and a small one costs
    mostly its tasks. Large ones keep theirs."""
    return df.coalesce(max(1, -(-df.count() // ROWS_PER_TASK)))


def compare(
    df: DataFrame,
    stages: Sequence,
    target: str,
    time_col: str,
    families: dict[str, dict],
    span: int = 1,
    last_folds: int | None = None,
    seed: int = 42,
    patience: int | None = None,
    freq: str = "monthly",
) -> DataFrame:
    """Brier, ROC AUC and PR AUC per rolling fold and family, all from one grouped metrics job.

    With ``patience`` boosting stops by its loss on the fold's own test rows. Folds with a single class in training are left out.
    """
    cuts = fold_cuts(df, time_col, freq, last_folds)
    parts = {cut: fold_parts(df, time_col, cut, freq, span) for cut in cuts}
    counts = run_all({cut: partial(class_counts, p[0], target) for cut, p in parts.items()})
    usable = [cut for cut in cuts if span is None or _classes(*counts[cut]) == 2]
    at_once = fits_at_once(df.sparkSession, max((counts[cut][2] for cut in usable), default=0))
    folds = run_all({cut: partial(prepared_fold, df, time_col, cut, stages, freq, span) for cut in usable}, at_once)

    def one(cut: date, family: str, params: dict) -> DataFrame:
        train_rows, test_rows = folds[cut]
        model = fitted(family, train_rows, target, seed, test_rows, patience, counts[cut], **params)
        return score(test_rows, model).select(
            F.lit(cut).alias("fold"), F.lit(family).alias("model"), F.col(target).alias("y"), "prob"
        )

    found = run_all({(cut, f): partial(one, cut, f, p) for cut in usable for f, p in families.items()}, at_once)
    scored = materialize(reduce(DataFrame.unionByName, found.values()), "scored")
    by = ["fold", "model"]
    return ranking_metrics(score_histogram(scored, "y", "prob", by), by).select(
        *by, "pr_auc", "roc_auc", "brier_score_loss"
    )


def save(model: PipelineModel, spark: SparkSession, root: str, product: int) -> int:
    """Save as the product's next version and note it in the registry table; returns the version."""
    version = latest_version(spark, root, product, default=0) + 1
    path = f"{root}/models/product={product}/version={version}"
    model.write().save(path)
    row = spark.createDataFrame([(product, version, path)], "product int, version int, path string")
    row.write.mode("append").parquet(f"{root}/registry")
    return version


def latest_version(spark: SparkSession, root: str, product: int, default: int = 1) -> int:
    """Highest registered version, or ``default`` when there is none."""
    try:
        registry = spark.read.schema("product int, version int, path string").parquet(f"{root}/registry")
    except AnalysisException:
        return default
    found = registry.filter(F.col("product") == product).agg(F.max("version").alias("v")).first()["v"]
    return default if found is None else found


def load_latest(spark: SparkSession, root: str, product: int) -> PipelineModel:
    version = latest_version(spark, root, product)
    return PipelineModel.load(f"{root}/models/product={product}/version={version}")


def batch_inference(
    clients: DataFrame, models: dict[int, tuple], names: dict[int, str] | None = None
) -> DataFrame:
    """Long prediction table of the given client rows; ``models`` maps product to (model, threshold)."""
    out = None
    for product, (model, threshold) in models.items():
        name = (names or {}).get(product, f"product_{product}")
        part = score(clients, model, threshold).select(
            "mon",
            "client_id",
            F.lit(product).alias("product_id"),
            F.lit(name).alias("name_product"),
            "prob",
            "pred",
        )
        out = part if out is None else out.unionByName(part)
    return out.orderBy("client_id", "product_id")
