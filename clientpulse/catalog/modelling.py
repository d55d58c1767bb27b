"""Sampling, labels, folds, training and scoring (K, L)."""

from __future__ import annotations

from functools import partial, reduce
from operator import add, and_

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from clientpulse.catalog.base import Query, once
from clientpulse.catalog.features import PURCHASE_BODY, PURCHASE_COLUMNS
from clientpulse.operators import folds as FO
from clientpulse.operators.metrics import ranking_metrics, score_histogram
from clientpulse.operators.sampling import balanced_weight, cluster_quotas, fraction_sample, stratified_sample
from clientpulse.plans import boosting as BO
from clientpulse.plans import features as FT
from clientpulse.plans import maintain as MT
from clientpulse.plans import master as M
from clientpulse.plans import models as ML
from clientpulse.plans import search as SE
from clientpulse.plans import target as T
from clientpulse.session import materialize, scratch_path
from clientpulse.sources import bindings as B

KEY = ["client_id", "mon"]
FEATURES = [
    "pur_trans_count_m",
    "pur_diff_trans_date_m",
    "pur_product_1_rsum_m",
    "pur_product_3_rsum_m",
    "pur_product_4_rsum_m",
    "pur_trans_count_avg_6m",
    "pur_recency_purchase",
    "trans_type_currency_cnt_m",
    "trans_trx_per_day_m",
]
CATEGORIES = ["pur_any_purchase", "trx_growth_streak_3m", "trans_event_type_mode_m"]
PARAMS = {
    "forest": {"numTrees": 20, "maxDepth": 5, "weight_root": 2},
    "boosted": {"maxIter": 8, "maxDepth": 3, "stepSize": 0.1, "weight_root": 1},
    "logistic": {"regParam": 0.01, "elasticNetParam": 1.0, "weight_root": 8},
}
OVER = "over (partition by client_id order by mon"
STRATA = f"""select client_id, mon, i as ind_any_purchase, trans_count as total_trans, diff_trans_date,
    avg(trans_count) {OVER} rows 2 preceding) as avg_trans_3m, avg(trans_count) {OVER} rows 5 preceding) as avg_trans_6m,
    stddev_samp(trans_count) {OVER} rows 5 preceding) as std_trans_6m, min(diff_trans_date) {OVER} rows 5 preceding) as min_trans_date_6m,
    max(diff_trans_date) {OVER} rows 5 preceding) as max_trans_date_6m, avg(diff_trans_date) {OVER} rows 2 preceding) as avg_trans_date_3m,
    avg(diff_trans_date) {OVER} rows 5 preceding) as avg_trans_date_6m
  from (select *, max(target_1) {OVER} rows between current row and 4 following) as i from purchase)"""
QUOTAS = f"""select c.cluster, c.n, c.n / t.n0 as pct, round(round(0.625 / 0.375 * t.n1) * c.n / t.n0) as quota
  from (select client_id % 3 as cluster, count(*) as n from ({STRATA}) where ind_any_purchase = 0 group by 1) c,
    (select count(*) filter (ind_any_purchase = 0) as n0, count(*) filter (ind_any_purchase = 1) as n1 from ({STRATA})) t"""
LABEL = f"""select client_id, mon, t as target_1 from (select *, max(target_1) {OVER} rows between current row and 4 following) as t
  from purchase) where mon <= (select max(mon) - interval 4 month from purchase)"""
BOUNDS = "(select cast(min(o_orderdate) as date) as lo, cast(max(o_orderdate) as date) as hi from orders)"
WEEKDAY = "case dayofweek(m) when 6 then m + 2 when 0 then m + 1 else m end"
CALENDARS = {
    "monthly": f"select 'monthly' as freq, d as cut from (select unnest(generate_series(date_trunc('month', lo), hi, interval 1 month)) as d, lo from {BOUNDS}) where d >= lo",
    "quarterly": f"select 'quarterly', d from (select unnest(generate_series(date_trunc('quarter', lo), hi, interval 3 month)) as d, lo from {BOUNDS}) where d >= lo",
    "yearly": f"select 'yearly', d from (select unnest(generate_series(date_trunc('year', lo), hi, interval 1 year)) as d, lo from {BOUNDS}) where d >= lo",
    "weekly": f"select 'weekly', d from (select unnest(generate_series(date_trunc('week', lo), hi, interval 7 day)) as d, lo from {BOUNDS}) where d >= lo",
    "semi_annually": f"""select 'semi_annually', d from (select unnest(generate_series(case when date_trunc('month', lo) = lo then lo
        else date_trunc('month', lo) + interval 1 month end, hi, interval 6 month)) as d from {BOUNDS})""",
    "bi_monthly": f"""select 'bi_monthly', d from (select d, row_number() over (order by d) as r from (
        select {WEEKDAY} as d, lo, hi from (select cast(unnest(generate_series(date_trunc('month', lo), hi, interval 1 month)) as date) as m, lo, hi
        from {BOUNDS})) where d >= lo and d <= hi) where r % 2 = 1""",
}
CUTS = """(select unnest(generate_series(min(mon) + interval 1 month, max(mon), interval 1 month)) as cut from purchase)"""


def _bounds(s, d):
    return B.raw(s, d, "orders").agg(
        F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end")
    )


def _calendars(s, d):
    out = None
    for freq in FO.FREQUENCIES:
        part = FO.calendar(_bounds(s, d), freq).withColumn("freq", F.lit(freq))
        out = part if out is None else out.unionByName(part)
    return out


def _stepped(s, d):
    p = B.purchase(s, d).select("mon").distinct()
    return p.select("mon", *[FO.add_period("mon", f).alias(f) for f in FO.FREQUENCIES])


def _cuts(p):
    return FO.fold_dates(p, "mon", "monthly", F.add_months(F.min("mon"), 1), F.max("mon"))


def _strata(s, d):
    zero, one = T.by_class(materialize(T.strata_features(B.purchase(s, d), "target_1"), "strata"))
    return zero.withColumn("cluster", F.col("client_id") % 3), one


def _quotas(s, d):
    zero, one = _strata(s, d)
    return cluster_quotas(zero, one, "cluster", 0.625)


def _sampled(s, d):
    zero, one = _strata(s, d)
    return stratified_sample(zero, one, "cluster", KEY)


def _class0(s, d):
    return T.by_class(materialize(T.strata_features(B.purchase(s, d), "target_1"), "strata"))[0]


def _components(s, d):
    rows = T.reduced(_class0(s, d))
    return rows.select(*KEY, *[F.get(vector_to_array("components"), F.lit(i)).alias(f"x{i + 1}") for i in range(3)])


def _clusters(s, d):
    return T.clusters(materialize(T.reduced(_class0(s, d)), "reduced"))


def features(s, d):
    """Purchase and transaction features of every client-month, written once for all products."""

    def build():
        trx = FT.feats_trx(B.trx(s, d), B.CURRENCIES, accounts=False).select(*KEY, *[c for c in (*FEATURES, *CATEGORIES) if c.startswith("tr")])
        return materialize(M.join_features(FT.feats_purchase(B.purchase(s, d)), trx), "features")

    return once(s, d, "features", build)


def labelled(s, d):
    """Labels of all products and features of every observable client-month, joined and written once."""

    def build():
        labels = T.lookahead_labels(B.purchase(s, d), {f"label_{k}": f"target_{k}" for k in B.PRODUCTS})
        return materialize(M.join_features(labels, features(s, d)), "labelled")

    return once(s, d, "labelled", build)


def dataset(s, d, product: int = 1):
    """Label and features of one product."""
    others = [f"label_{k}" for k in B.PRODUCTS if k != product]
    return labelled(s, d).withColumnRenamed(f"label_{product}", "target").drop(*others)


def stages(product: int = 1):
    return ML.product_preprocessing(product, KEY, FEATURES, CATEGORIES, "target")


def trained(s, d, family: str, product: int = 1):
    """Model fitted on the training months, with the test rows."""
    train_rows, test_rows = M.temporal_split(dataset(s, d, product))
    fit = partial(ML.train, train_rows, stages(product), family, "target", **PARAMS[family])
    return once(s, d, f"{family}-{product}", fit), test_rows


def chosen(s, d):
    """Each product's model of the family chosen for it, with its test rows; keys are the products."""
    return ML.run_all({k: partial(trained, s, d, ML.CHOSEN[k], k) for k in B.PRODUCTS})


def _scored(family):
    def build(s, d):
        model, test_rows = trained(s, d, family)
        return ML.score(test_rows, model)

    return build


def _search(s, d):
    """Fifteen draws of the logistic family, over half-years of all training months."""

    def build():
        train_rows, _ = M.temporal_split(dataset(s, d))
        rows = materialize(train_rows, "train")
        return materialize(SE.search(rows, stages(), "target", "mon", "logistic", freq="semi_annually"), "scores")

    return once(s, d, "search", build)


def _search_summary(s, d):
    return SE.summary(_search(s, d))


def _searched(s, d):
    """What holds of any search: one row a trial; scores are shares; the best trial ran all folds; trials that left ran fewer."""
    scores = _search(s, d)
    folds = scores.agg(F.count_distinct("fold")).first()[0]
    table = SE.summary(scores)
    shares = [F.col(f"mean_{m}").between(0, 1) for m in ("f1", "precision", "recall", "ks")]
    ran = F.when(F.col("left"), F.col("folds") < folds).otherwise(F.col("folds") == folds)
    startup = (F.col("trial") >= 3) | ~F.col("left")
    return table.agg(
        F.count(F.lit(1)).alias("trials"),
        F.lit(folds).alias("folds"),
        F.count_if(~reduce(and_, shares)).alias("not_shares"),
        F.count_if(~ran).alias("wrong_folds"),
        F.count_if(~startup).alias("left_early"),
    )


def _compare(s, d):
    """The three families on every quarter of the training months, each trained on the quarter before; boosting stops by its loss."""

    def build():
        train_rows, _ = M.temporal_split(dataset(s, d))
        small = {"forest": {"numTrees": 10, "maxDepth": 4}, "boosted": {"maxIter": 20, "maxDepth": 3}, "logistic": {"regParam": 0.01}}
        rows = materialize(train_rows, "train")
        return materialize(ML.compare(rows, stages(), "target", "mon", small, span=3, patience=5, freq="quarterly"), "comparison")

    return once(s, d, "comparison", build)


def _compared(s, d):
    """What holds of any comparison: three families a fold, scores are shares, and no fold is missing."""
    table = _compare(s, d)
    shares = [F.col(c).between(0, 1) for c in ("pr_auc", "roc_auc", "brier_score_loss")]
    per_fold = table.groupBy("fold").agg(F.count_distinct("model").alias("models"), F.count_if(~reduce(and_, shares)).alias("not_shares"))
    return per_fold.select("fold", "models", "not_shares")


def _persisted(s, d):
    """Test scores of a saved and reloaded model; both versions must agree."""
    root = scratch_path(s, "registry")
    model, test_rows = trained(s, d, "logistic")
    ML.save(model, s, root, 1)
    version = ML.save(model, s, root, 1)
    again = ML.load_latest(s, root, 1)
    both = [ML.score(test_rows, m).select(*KEY, "prob") for m in (model, again)]
    joined = both[0].join(both[1].withColumnRenamed("prob", "prob_again"), KEY)
    return joined.groupBy(F.lit(version).alias("version")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("prob") - F.col("prob_again"))).alias("gap")
    )


def current(s, d):
    """The clients of the newest month with the features known of them."""
    purchase = B.purchase(s, d)
    last = purchase.agg(F.max("mon").alias("m")).scalar()
    return materialize(M.join_features(purchase.filter(F.col("mon") == last).select(*KEY), features(s, d)), "current")


def _inference(s, d):
    """Every product scored by the model of the family chosen for it, at its own threshold."""
    rows = current(s, d)
    return ML.batch_inference(rows, {k: (model, ML.THRESHOLDS[k]) for k, (model, _) in chosen(s, d).items()})


def _inferred(s, d):
    """Each prediction with whether its probability is a share and its decision that of its product's threshold."""
    limits = F.create_map(*[F.lit(x) for pair in ML.THRESHOLDS.items() for x in pair])
    decided = F.col("pred") == (F.col("prob") > limits[F.col("product_id")]).cast("int")
    return _inference(s, d).select(
        *KEY, "product_id", "name_product", F.col("prob").between(0, 1).cast("int").alias("share"), decided.cast("int").alias("decided")
    )


def _checked(family):
    """Each scored row with whether its probability is a share and decided at one half, and whether scoring again gives the same."""

    def build(s, d):
        rows, again = (materialize(_scored(family)(s, d), "scored").select(*KEY, "prob", "pred") for _ in range(2))
        return rows.join(again.withColumnsRenamed({"prob": "other", "pred": "_"}), KEY).select(
            *KEY,
            F.col("prob").between(0, 1).cast("int").alias("share"),
            (F.col("pred") == (F.col("prob") > 0.5).cast("int")).cast("int").alias("decided"),
            (F.col("prob") == F.col("other")).cast("int").alias("same"),
        )

    return build


def _early(s, d):
    """Boosting stopped by patience on the first test month: the loss of the kept rounds against all that were fitted."""
    train_rows, test_rows = M.temporal_split(dataset(s, d))
    prepared = Pipeline(stages=stages()).fit(train_rows)
    rows, valid = (materialize(prepared.transform(p), "part") for p in (ML.weighted(train_rows, "target", 1), test_rows))
    booster = ML.classifier("boosted", "target", maxIter=60, maxDepth=4, stepSize=0.3)
    model, losses = BO.fit_with_patience(booster, rows, valid.drop("weight"), patience=8)
    own = BO.validation_losses(model, valid.drop("weight"))
    kept = model.getNumTrees
    facts = [
        ("ends_at_its_best_round", own[-1] == min(losses[: kept + 8])),
        ("loses_nothing_before", all(abs(a - b) < 1e-9 for a, b in zip(own, losses))),
        ("stopped_before_the_limit", len(losses) < 60 or kept == len(losses) or len(losses) - kept >= 8),
    ]
    return s.createDataFrame([(k, int(v)) for k, v in facts], "fact string, holds int")


def _target_facts(s, d):
    """What holds of the label table whatever the clusters: all positives once, no label wrong, negatives within their share."""
    purchase = B.purchase(s, d)
    built = materialize(T.build_target(purchase, 3), "target")
    right = T.lookahead_label(purchase, "target_3", "target_3").withColumnRenamed("target_3", "label")
    joined = built.join(right, KEY, "left")
    return joined.agg(
        F.sum("target_3").alias("positives"),
        (F.count(F.lit(1)) - F.count_distinct(*KEY)).alias("repeated"),
        F.count_if(~F.col("target_3").eqNullSafe(F.col("label"))).alias("mislabelled"),
        (F.avg("target_3") > 0.36).cast("int").alias("within_share"),
    )


def _component_facts(s, d):
    """Components of all class-0 rows: uncorrelated, and each varies at most as much as the one before."""
    rows = materialize(_components(s, d), "components")
    r = [F.abs(F.corr(a, b)) < 1e-6 for a, b in (("x1", "x2"), ("x1", "x3"), ("x2", "x3"))]
    spread = [F.var_pop(f"x{i}") for i in (1, 2, 3)]
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        reduce(and_, r).cast("int").alias("uncorrelated"),
        ((spread[0] >= spread[1]) & (spread[1] >= spread[2])).cast("int").alias("falling"),
    )


def _cluster_facts(s, d):
    """K-means over the components: every row has one of three clusters and lies nearest to its own cluster's mean."""
    rows = materialize(_components(s, d), "components")
    labels = T.clusters(rows.withColumn("components", array_to_vector(F.array("x1", "x2", "x3"))))
    placed = materialize(rows.join(labels, KEY), "placed")
    centres = {r["cluster"]: [r[f"m{i}"] for i in (1, 2, 3)] for r in placed.groupBy("cluster").agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in (1, 2, 3)]).collect()}
    far = {k: reduce(add, [F.pow(F.col(f"x{i}") - c[i - 1], F.lit(2)) for i in (1, 2, 3)]) for k, c in centres.items()}
    own = reduce(lambda a, k: F.when(F.col("cluster") == k, far[k]).otherwise(a), far, F.lit(None))
    near = own <= F.least(*far.values()) * 1.05 + 1e-9 if len(far) > 1 else F.lit(True)
    return placed.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("clusters"), (F.avg(near.cast("int")) > 0.98).cast("int").alias("nearest")
    )


def _quality(s, d):
    """Ranking quality of the three families on the test months."""
    out = None
    for family, (model, test_rows) in ML.run_all({f: partial(trained, s, d, f) for f in PARAMS}).items():
        part = ML.score(test_rows, model).select(F.lit(family).alias("model"), "target", "prob")
        out = part if out is None else out.unionByName(part)
    return ranking_metrics(score_histogram(out, "target", "prob", ["model"]), ["model"])


def _quality_facts(s, d):
    """Whether the qualities of each family are shares."""
    shares = reduce(and_, [F.col(c).between(0, 1) for c in ("pr_auc", "roc_auc", "brier_score_loss")])
    return _quality(s, d).select("model", shares.cast("int").alias("shares"))


def _maintained(s, d):
    """Purchase features kept up in steps of ten months, as a table of their own."""
    purchase = materialize(B.purchase(s, d), "purchase")
    root = scratch_path(s, "maintained")
    months = sorted(r["mon"] for r in purchase.select("mon").distinct().collect())  # one row per month
    for at in range(0, len(months), 10):
        step = months[at : at + 10]
        MT.advance(s, purchase, root, step[0], step[-1])
    return s.read.parquet(f"{root}/features").withColumn("mon", F.col("mon").cast("date"))


TEST_ROWS = f"""(select client_id, mon from ({LABEL}), (select max(mon) as last, cast(floor(count(distinct mon) * 0.3) as int) as n from ({LABEL}))
  where mon > last - to_months(n))"""
TRAIN_MONTHS = f"""(select distinct mon, target_1 from ({LABEL}), (select max(mon) as last, cast(floor(count(distinct mon) * 0.3) as int) as n from ({LABEL}))
  where mon <= last - to_months(n))"""
CLASS_0 = f"(select count(*) from ({STRATA}) where ind_any_purchase = 0)"
STRATA_COLUMNS = """client_id:i mon:d ind_any_purchase:i total_trans:i diff_trans_date:i avg_trans_3m:f avg_trans_6m:f std_trans_6m:f
min_trans_date_6m:i max_trans_date_6m:i avg_trans_date_3m:f avg_trans_date_6m:f"""

QUERIES = [
    Query(
        "k1_fraction_sample",
        "client_id:i mon:d",
        lambda s, d: fraction_sample(B.purchase(s, d), KEY, 0.05, 42),
        """select client_id, mon from purchase where cast('0x' || substr(md5(client_id || '|' || strftime(mon, '%Y-%m-%d') || '|42'), 1, 12)
           as bigint) / 281474976710656.0 < 0.05""",
    ),
    Query("k2_components", "client_id:i mon:d x1:f x2:f x3:f", _components),
    Query(
        "k2_component_facts",
        "n:i uncorrelated:i falling:i",
        _component_facts,
        f"select {CLASS_0} as n, 1 as uncorrelated, 1 as falling",
    ),
    Query("k3_clusters", "client_id:i mon:d cluster:i", _clusters),
    Query(
        "k3_cluster_facts", "n:i clusters:i nearest:i", _cluster_facts, f"select {CLASS_0} as n, 3 as clusters, 1 as nearest"
    ),
    Query("k4_quotas", "cluster:i n:i pct:f quota:i", _quotas, QUOTAS),
    Query(
        "k4_stratified_sample",
        "client_id:i mon:d class:i",
        _sampled,
        f"""select client_id, mon, 1 as class from ({STRATA}) where ind_any_purchase = 1
            union all select client_id, mon, 0 from (select client_id, mon, client_id % 3 as cluster,
              row_number() over (partition by client_id % 3 order by md5(client_id || '|' || strftime(mon, '%Y-%m-%d') || '|42')) as r
              from ({STRATA}) where ind_any_purchase = 0) z join ({QUOTAS}) q on z.cluster = q.cluster where r <= quota""",
    ),
    Query(
        "k5_strata_features",
        STRATA_COLUMNS,
        lambda s, d: T.strata_features(B.purchase(s, d), "target_1"),
        STRATA,
    ),
    Query(
        "k6_lookahead_label",
        "client_id:i mon:d target_1:i",
        lambda s, d: T.lookahead_label(B.purchase(s, d), "target_1", "target_1"),
        LABEL,
    ),
    Query("k6_target", "client_id:i mon:d target_3:i", lambda s, d: T.build_target(B.purchase(s, d), 3)),
    Query(
        "k6_target_facts",
        "positives:i repeated:i mislabelled:i within_share:i",
        _target_facts,
        f"select sum(target_1) as positives, 0 as repeated, 0 as mislabelled, 1 as within_share from ({LABEL.replace('target_1', 'target_3').replace('target_3 from (select', 'target_1 from (select')})",
    ),
    Query(
        "k7_balanced_weight",
        "id:i y_true:i weight:f",
        lambda s, d: balanced_weight(B.scores(s, d), "y_true", 3),
        """select id, y_true, case when y_true = 1 then power((select count(*) filter (y_true = 0) / count(*) filter (y_true = 1)
           from scores), 1.0 / 3) else 1.0 end as weight from scores""",
    ),
    Query("l1_calendar", "freq:s cut:d", _calendars, " union all ".join(CALENDARS.values())),
    Query(
        "l2_add_period",
        "mon:d monthly:d bi_monthly:d quarterly:d semi_annually:d yearly:d weekly:d",
        _stepped,
        """select distinct mon, mon + interval 1 month as monthly, mon + interval 2 month as bi_monthly, mon + interval 3 month as quarterly,
           mon + interval 6 month as semi_annually, mon + interval 1 year as yearly, mon + interval 7 day as weekly from purchase""",
    ),
    Query(
        "l3_expanding_folds",
        "fold:d part:s n:i",
        lambda s, d: (lambda p: FO.expanding_folds(p, "mon", _cuts(p)))(B.purchase(s, d))
        .groupBy("fold", "part")
        .agg(F.count(F.lit(1)).alias("n")),
        f"""select cut as fold, case when mon < cut then 'train' else 'test' end as part, count(*) as n
            from purchase join {CUTS} on mon < cut + interval 1 month group by 1, 2""",
    ),
    Query(
        "l3_leaks",
        "leaks:i",
        lambda s, d: (lambda p: FO.leaks(FO.expanding_folds(p, "mon", _cuts(p)), "mon"))(B.purchase(s, d)).agg(
            F.count(F.lit(1)).alias("leaks")
        ),
        "select 0 * count(*) as leaks from purchase",
    ),
    Query(
        "l4_rolling_folds",
        "fold:d part:s n:i",
        lambda s, d: (lambda p: FO.rolling_folds(p, "mon", _cuts(p)))(B.purchase(s, d))
        .groupBy("fold", "part")
        .agg(F.count(F.lit(1)).alias("n")),
        f"""select cut as fold, case when mon < cut then 'train' else 'test' end as part, count(*) as n
            from purchase join {CUTS} on mon < cut + interval 1 month and mon >= cut - interval 1 month group by 1, 2""",
    ),
    Query("l5_forest", "client_id:i mon:d prob:f pred:i", _scored("forest")),
    Query("l6_boosted", "client_id:i mon:d prob:f pred:i", _scored("boosted")),
    Query("l7_logistic", "client_id:i mon:d prob:f pred:i", _scored("logistic")),
    *[
        Query(
            f"{key}_facts",
            "client_id:i mon:d share:i decided:i same:i",
            _checked(family),
            f"select client_id, mon, 1 as share, 1 as decided, 1 as same from {TEST_ROWS}",
        )
        for key, family in (("l5_forest", "forest"), ("l6_boosted", "boosted"), ("l7_logistic", "logistic"))
    ],
    Query(
        "l6_early_stopping",
        "fact:s holds:i",
        _early,
        """select fact, cast((select min(1) from purchase) as int) as holds
           from (values ('ends_at_its_best_round'), ('loses_nothing_before'), ('stopped_before_the_limit')) t(fact)""",
    ),
    Query("l8_search", "trial:i params:s folds:i left:s mean_f1:f mean_precision:f mean_recall:f mean_ks:f", _search_summary),
    Query(
        "l8_search_facts",
        "trials:i folds:i not_shares:i wrong_folds:i left_early:i",
        _searched,
        f"""select 15 as trials, count(*) as folds, 0 as not_shares, 0 as wrong_folds, 0 as left_early
            from (select unnest(generate_series(min(mon) + interval 1 month, max(mon), interval 6 month)) as cut from {TRAIN_MONTHS})
            where cut > (select max(f) from (select min(mon) as f from {TRAIN_MONTHS} group by target_1))""",
    ),
    Query("l9_comparison", "fold:d model:s pr_auc:f roc_auc:f brier_score_loss:f", _compare),
    Query(
        "l9_comparison_facts",
        "fold:d models:i not_shares:i",
        _compared,
        f"""select cut as fold, 3 as models, 0 as not_shares
            from (select unnest(generate_series(date_trunc('quarter', min(mon) + interval 3 month), max(mon), interval 3 month)) as cut from {TRAIN_MONTHS})
            where (select count(distinct target_1) from {TRAIN_MONTHS} where mon >= cut - interval 3 month and mon < cut) = 2""",
    ),
    Query("l9_quality", "model:s pr_auc:f roc_auc:f brier_score_loss:f", _quality),
    Query(
        "l9_quality_facts",
        "model:s shares:i",
        _quality_facts,
        "select model, cast((select min(1) from purchase) as int) as shares from (values ('forest'), ('boosted'), ('logistic')) t(model)",
    ),
    Query(
        "l11_persistence",
        "version:i n:i gap:f",
        _persisted,
        f"select 2 as version, count(*) as n, 0.0 as gap from {TEST_ROWS}",
    ),
    Query("l12_batch_inference", "mon:d client_id:i product_id:i name_product:s prob:f pred:i", _inference),
    Query(
        "l12_inference_facts",
        "mon:d client_id:i product_id:i name_product:s share:i decided:i",
        _inferred,
        """select mon, client_id, product_id, 'product_' || product_id as name_product, 1 as share, 1 as decided
           from purchase, (values (1), (3), (4)) t(product_id) where mon = (select max(mon) from purchase)""",
    ),
    Query("l12_kept_features", PURCHASE_COLUMNS, _maintained, PURCHASE_BODY),
]
