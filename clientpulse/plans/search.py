"""Parameter search over temporal folds as a race of trials.

Every trial is a seeded draw of parameters and is scored on the folds in order of time. From the ``warmup``-th fold on, a trial
whose mean F1 so far lies below the median of the trials drawn before it and still in the race at that fold leaves the race; the first
``startup`` trials always stay. Several fits run at a time and may be ahead of a trial that decides about another one, so a trial
can turn out to have left at an earlier fold than it has reached: its running jobs are cancelled and what it did beyond
is not counted. What is kept thus depends on the draws and the data only, never on which fit ended first.

Finished scores are added to a ledger under the shared folder fold by fold. A search that is given the ledger of an earlier one takes its
scores from there and fits only what is missing.
"""

from __future__ import annotations

import json
import random
import statistics
import threading
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientpulse.operators.metrics import ranking_metrics
from clientpulse.operators.ordered import running_totals
from clientpulse.plans.models import class_counts, fits_at_once, fitted, fold_cuts, fold_parts, prepared_fold, run_all, score
from clientpulse.session import scratch_path

# The ranges of the search, (low, high) or a tuple of more choices. None as a weight root means no weights.
ROOTS = (None, 1, 2, 3, 4, 5, 6, 7, 8, 9)
SPACES: dict[str, dict] = {
    "forest": {
        "numTrees": (500, 2000),
        "maxDepth": (5, 12),
        "minInstancesPerNode": (10, 100),
        "featureSubsetStrategy": ("sqrt", "log2", "all"),
        "impurity": ["gini", "entropy"],
        "weight_root": ROOTS,
    },
    "boosted": {
        "stepSize": (0.001, 0.1),
        "maxDepth": (8, 12),
        "maxIter": (1000, 3000),
        "subsamplingRate": (0.5, 0.95),
        "featureSubsetStrategy": (0.5, 0.95),
        "weight_root": ROOTS,
    },
    "logistic": {
        "inverse_strength": (0.001, 0.1),
        "elasticNetParam": (1.0, 0.0, 0.0, 1.0, 0.0),
        "balanced": [True, False],
        "maxIter": (2450, 3500),
        "fitIntercept": [True, False],
        "weight_root": ROOTS,
    },
}
METRICS = ("f1", "precision", "recall")
LEDGER = "trial int, params string, fold date, f1 double, precision double, recall double"
HISTOGRAM = "score double, pos long, neg long"
Scores = dict[tuple[int, int], dict[str, float]]


def draw(family: str, n_trials: int, seed: int = 42, spaces: Mapping[str, dict] = SPACES) -> list[dict]:
    """Seeded draws: whole numbers or uniform between two numbers, else one of the choices (a list is always choices)."""
    rng, out = random.Random(seed), []
    for _ in range(n_trials):
        trial = {}
        for name, space in spaces[family].items():
            if isinstance(space, tuple) and len(space) == 2:
                low, high = space
                trial[name] = rng.randint(low, high) if isinstance(low, int) else round(rng.uniform(low, high), 6)
            else:
                trial[name] = rng.choice(list(space))
        if isinstance(trial.get("featureSubsetStrategy"), float):
            trial["featureSubsetStrategy"] = str(trial["featureSubsetStrategy"])
        out.append(trial)
    return out


def leavers(scores: Scores, n_trials: int, n_folds: int, startup: int, warmup: int) -> dict[int, int]:
    """Trials that are certain to leave the race, and the fold after which each does, from the scores known so far."""
    left: dict[int, int] = {}
    unsure: set[int] = set()
    for fold in range(n_folds):
        earlier: list[float] = []
        certain = True
        for trial in range(n_trials):
            if trial in left:
                continue
            if trial in unsure or any((trial, f) not in scores for f in range(fold + 1)):
                unsure.add(trial)
                certain = False
                continue
            mean = statistics.fmean(scores[trial, f]["f1"] for f in range(fold + 1))
            if certain and trial >= startup and fold >= warmup and earlier and mean < statistics.median(earlier):
                left[trial] = fold
            elif certain:
                earlier.append(mean)
            elif trial >= startup and fold >= warmup:
                unsure.add(trial)  # whether it stays depends on a trial that has not come this far
    return left


def fold_metrics(scored: DataFrame, target: str, path: str) -> dict[str, float]:
    """F1, precision and recall of scored rows, whose counts per distinct score are left at ``path``.

    Precision is 0 where predictions or truth have one class.
    """
    counts = scored.groupBy(F.col("prob").alias("score")).agg(
        F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg"), F.max("pred").alias("pred")
    )
    counts.write.mode("overwrite").parquet(path)
    sides = scored.sparkSession.read.schema(f"{HISTOGRAM}, pred int").parquet(path).groupBy("pred").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cells = {r["pred"]: (r["pos"], r["neg"]) for r in sides.collect()}
    (tp, fp), (fn, tn) = cells.get(1, (0, 0)), cells.get(0, (0, 0))
    both = tp + fp > 0 and fn + tn > 0 and tp + fn > 0 and fp + tn > 0
    return {
        "f1": 2 * tp / (2 * tp + fp + fn) if tp else 0.0,
        "precision": tp / (tp + fp) if both else 0.0,
        "recall": tp / (tp + fn) if tp + fn else 0.0,
    }


class _Race:
    """Trials times folds, worked off by a few threads in order of fold, then trial."""

    def __init__(self, spark: SparkSession, one, n_trials: int, n_folds: int, startup: int, warmup: int, prune: bool, known: Scores):
        self.spark, self.one, self.shape = spark, one, (n_trials, n_folds)
        self.rule, self.prune = (startup, warmup), prune
        self.scores: Scores = dict(known)
        self.left: dict[int, int] = {}
        self.running: dict[tuple[int, int], str] = {}
        self.lock = threading.Lock()
        self._settle()

    def _settle(self) -> None:
        if self.prune:
            self.left = leavers(self.scores, *self.shape, *self.rule)

    def gone(self, trial: int, fold: int) -> bool:
        return trial in self.left and fold > self.left[trial]

    def work(self, trial: int, fold: int) -> None:
        tag = f"trial-{uuid.uuid4().hex}"
        with self.lock:
            if (trial, fold) in self.scores or self.gone(trial, fold):
                return
            self.running[trial, fold] = tag
        self.spark.sparkContext.addJobTag(tag)
        try:
            found = self.one(trial, fold)
        except Exception:
            with self.lock:
                if self.gone(trial, fold):  # its jobs were cancelled
                    return
            raise
        finally:
            self.spark.sparkContext.removeJobTag(tag)
            with self.lock:
                self.running.pop((trial, fold), None)
        with self.lock:
            self.scores[trial, fold] = found
            self._settle()
            losing = [t for (trial, fold), t in self.running.items() if self.gone(trial, fold)]
        for t in losing:
            self.spark.sparkContext.cancelJobsWithTag(t)

    def kept(self) -> Scores:
        return {k: v for k, v in self.scores.items() if not self.gone(*k)}


def search(
    df: DataFrame,
    stages: Sequence,
    target: str,
    time_col: str,
    family: str,
    n_trials: int = 15,
    seed: int = 42,
    threshold: float = 0.5,
    freq: str = "monthly",
    last_folds: int | None = None,
    spaces: Mapping[str, dict] = SPACES,
    prune: bool = True,
    startup: int = 3,
    warmup: int = 5,
    ledger: str | None = None,
) -> DataFrame:
    """Scores of every trial on every fold it ran: ``trial, params, fold, f1, precision, recall, ks, left``.

    Folds expand: each trains on everything before its date. ``left`` says that the trial left the race before the last fold.
    Folds whose training rows have one class are skipped.
    """
    spark = df.sparkSession
    trials = draw(family, n_trials, seed, spaces)
    names = [json.dumps(t, sort_keys=True) for t in trials]
    cuts = fold_cuts(df, time_col, freq, last_folds)
    both = df.groupBy(target).agg(F.min(time_col).alias("first")).collect()
    since = max(r["first"] for r in both) if len(both) == 2 else None
    cuts = [c for c in cuts if since is not None and c > since]
    counts = run_all({cut: partial(class_counts, fold_parts(df, time_col, cut, freq)[0], target) for cut in cuts})
    at_once = fits_at_once(spark, max((n for _, _, n in counts.values()), default=0))
    ledger = ledger or scratch_path(spark, "ledger")
    known = {
        (r["trial"], cuts.index(r["fold"])): {m: r[m] for m in METRICS}
        for r in _read(spark, ledger)
        if r["trial"] < n_trials and names[r["trial"]] == r["params"] and r["fold"] in cuts
    }

    def one(trial: int, fold: int) -> dict[str, float]:
        train_rows, test_rows = folds[fold].result()
        model = fitted(family, train_rows, target, seed, counts=counts[cuts[fold]], **trials[trial])
        return fold_metrics(score(test_rows, model, threshold), target, f"{ledger}/counts/trial={trial}/fold={cuts[fold]}")

    race = _Race(spark, one, n_trials, len(cuts), startup, warmup, prune, known)
    noted = set(known)
    with ThreadPoolExecutor(at_once) as preparing, ThreadPoolExecutor(at_once) as pool:
        # trials run on the folds that are ready while later, larger ones are prepared
        folds = [preparing.submit(inheritable_thread_target(partial(prepared_fold, df, time_col, cut, stages, freq))) for cut in cuts]
        pending = [
            [pool.submit(inheritable_thread_target(partial(race.work, t, fold))) for t in range(n_trials)] for fold in range(len(cuts))
        ]
        for jobs in pending:  # later folds go on while an ended one is noted
            for job in jobs:
                job.result()
            fresh = [k for k in list(race.scores) if k not in noted]
            _note(spark, ledger, fresh, race.scores, names, cuts)
            noted.update(fresh)
        for fold in folds:  # also of folds that nothing was fitted on
            fold.result()
    rows = [
        (t, names[t], cuts[f], *[float(v[m]) for m in METRICS], t in race.left and race.left[t] < len(cuts) - 1)
        for (t, f), v in sorted(race.kept().items())
    ]
    kept = spark.createDataFrame(rows, f"{LEDGER}, left boolean")
    if not rows:
        return kept.withColumn("ks", F.lit(None).cast("double"))
    by = ["trial", "fold"]
    counts = spark.read.schema(f"{HISTOGRAM}, trial int, fold date").parquet(f"{ledger}/counts")
    # one row per fit
    counts = counts.join(F.broadcast(kept.select(*by)), by, "left_semi")
    ks = ranking_metrics(running_totals(counts, by, ["score"], ["pos", "neg"]), by).select(*by, F.col("ks_statistic").alias("ks"))
    return kept.join(ks, by, "left").select(*kept.columns, "ks")


def _note(spark: SparkSession, ledger: str, fresh: list, scores: Scores, names: list[str], cuts: list[date]) -> None:
    if fresh:
        rows = [(t, names[t], cuts[f], *[float(scores[t, f][m]) for m in METRICS]) for t, f in fresh]
        spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(f"{ledger}/scores")


def _read(spark: SparkSession, ledger: str) -> list:
    """Scores noted earlier; as many rows as fits were made."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{ledger}/scores").collect()
    except AnalysisException:
        return []


def summary(scores: DataFrame) -> DataFrame:
    """``trial, params, folds, left`` and mean metrics per trial; the best of those that ran all folds first."""
    means = [F.avg(m).alias(f"mean_{m}") for m in (*METRICS, "ks")]
    table = scores.groupBy("trial", "params").agg(F.count(F.lit(1)).alias("folds"), F.max("left").alias("left"), *means)
    return table.orderBy("left", F.desc("mean_f1"), "trial")
