"""Metrics and curves (M, F3, L10)."""

from __future__ import annotations

from clientpulse.catalog.base import Query
from clientpulse.operators import metrics as M
from clientpulse.sources import bindings as B

BY = ["model"]
THRESHOLD = 0.45454545454545453


def _decided(s, d):
    return M.decide(B.scores(s, d), "y_score", THRESHOLD)


def _hist(s, d, by=BY):
    return M.score_histogram(B.scores(s, d), "y_true", "y_score", by)


COUNTS = f"""select model, count(*) filter (y_true = 0 and not p) as tn, count(*) filter (y_true = 0 and p) as fp,
    count(*) filter (y_true = 1 and not p) as fn, count(*) filter (y_true = 1 and p) as tp
  from (select *, y_score > {THRESHOLD} as p from scores) group by 1"""
TERMS = f"""select *, tn + fp as n0, fn + tp as n1, tn + fp + fn + tp as n, coalesce(tp / nullif(tp + fp, 0), 0) as p1,
    coalesce(tp / nullif(tp + fn, 0), 0) as r1, coalesce(tn / nullif(tn + fn, 0), 0) as p0, coalesce(tn / nullif(tn + fp, 0), 0) as r0,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) as f0 from ({COUNTS})"""


def _f_beta(b: float, one: bool) -> str:
    hit, false_hit, miss = ("tp", "fp", "fn") if one else ("tn", "fn", "fp")
    k = b * b
    return f"coalesce({1 + k} * {hit} / nullif({1 + k} * {hit} + {k} * {miss} + {false_hit}, 0), 0)"


THRESHOLD_SQL = {
    "accuracy": "(tp + tn) / n",
    "balanced_accuracy": "(r0 + r1) / 2",
    "f1": "f1",
    "f1_micro": "(tp + tn) / n",
    "f1_macro": "(f0 + f1) / 2",
    "f1_weighted": "(n0 * f0 + n1 * f1) / n",
    "precision": "p1",
    "precision_micro": "(tp + tn) / n",
    "precision_macro": "(p0 + p1) / 2",
    "precision_weighted": "(n0 * p0 + n1 * p1) / n",
    "recall": "r1",
    "recall_micro": "(tp + tn) / n",
    "recall_macro": "(r0 + r1) / 2",
    "recall_weighted": "(n0 * r0 + n1 * r1) / n",
    "matthews_corrcoef": "(cast(tp as double) * tn - cast(fp as double) * fn) / sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn))",
    "fpr": "fp / n0",
    "fnr": "fn / n1",
    **{name: _f_beta(b, True) for name, b in M.BETAS.items()},
    **{name: f"(n0 * {_f_beta(b, False)} + n1 * {_f_beta(b, True)}) / n" for name, b in M.WEIGHTED_BETAS.items()},
}
CURVE = """select model, y_score as score, count(*) filter (y_true = 1) as pos, count(*) filter (y_true = 0) as neg,
    sum(count(*) filter (y_true = 1)) over (partition by model order by y_score desc) as tp,
    sum(count(*) filter (y_true = 0)) over (partition by model order by y_score desc) as fp,
    sum(count(*) filter (y_true = 1)) over (partition by model) as p,
    sum(count(*) filter (y_true = 0)) over (partition by model) as n
  from scores group by model, y_score"""
AUC = f"""select model, sum(pos * (n - fp + neg / 2)) / max(cast(p as double) * n) as roc_auc from ({CURVE}) group by 1"""
PR = f"""select model, sum((recall - coalesce(prev_recall, 0)) * (prec + coalesce(prev_prec, 1)) / 2) as pr_auc from (
    select model, recall, prec, lag(recall) over w as prev_recall, lag(prec) over w as prev_prec from (
      select model, score, tp / p as recall, tp / (tp + fp) as prec from ({CURVE}))
    window w as (partition by model order by score desc)) group by 1"""
KS = f"select model, max(abs(tp / p - fp / n)) as ks_statistic from ({CURVE}) group by 1"
BRIER = "select model, avg(power(y_true - y_score, 2)) as brier_score_loss from scores group by 1"
GRID = """select m.model, g.i / 99.0 as threshold, count(*) filter (y_true = 1 and y_score <= g.i / 99.0) / count(*) filter (y_true = 1) as cum_pos,
    count(*) filter (y_true = 0 and y_score <= g.i / 99.0) / count(*) filter (y_true = 0) as cum_neg
  from scores m, (select unnest(range(100)) as i) g group by m.model, g.i"""
LONG_VALUES = " union all ".join(
    f"select model, '{name}' as metric, cast({expr} as double) as value from ({TERMS})" for name, expr in THRESHOLD_SQL.items()
)

QUERIES = [
    Query(
        "l10_thresholded",
        "id:i y_score:f pred:i",
        _decided,
        f"select id, y_score, cast(y_score > {THRESHOLD} as int) as pred from scores",
    ),
    Query(
        "m1_confusion",
        "model:s actual:i predicted:i n:i row_pct:f",
        lambda s, d: M.confusion(_decided(s, d), "y_true", "pred", BY),
        f"""select model, unnest([0, 0, 1, 1]) as actual, unnest([0, 1, 0, 1]) as predicted, unnest([tn, fp, fn, tp]) as n,
            unnest([100.0 * tn / n0, 100.0 * fp / n0, 100.0 * fn / n1, 100.0 * tp / n1]) as row_pct from ({TERMS})""",
    ),
    Query(
        "m2_threshold_metrics",
        "model:s " + " ".join(f"{n}:f" for n in THRESHOLD_SQL),
        lambda s, d: M.threshold_metrics(_decided(s, d), "y_true", "pred", BY),
        f"select model, {', '.join(f'{e} as {n}' for n, e in THRESHOLD_SQL.items())} from ({TERMS})",
    ),
    Query("m3_brier", "model:s brier_score_loss:f", lambda s, d: M.ranking_metrics(_hist(s, d), BY), BRIER),
    Query(
        "m4_roc_auc",
        "model:s roc_auc:f roc_auc_ovr:f roc_auc_ovo:f roc_auc_ovr_weighted:f roc_auc_ovo_weighted:f",
        lambda s, d: M.ranking_metrics(_hist(s, d), BY),
        f"""select model, roc_auc, roc_auc as roc_auc_ovr, roc_auc as roc_auc_ovo, roc_auc as roc_auc_ovr_weighted,
            roc_auc as roc_auc_ovo_weighted from ({AUC})""",
    ),
    Query(
        "m4_roc_auc_overall",
        "roc_auc:f ks_statistic:f",
        lambda s, d: M.ranking_metrics(_hist(s, d, [])),
        """select sum(r) / max(1.0 * p * n) - (max(p) + 1) / (2.0 * max(n)) as roc_auc, max(k) as ks_statistic from (
             select case when y_true = 1 then avg(r) over (partition by y_score) else 0 end as r, p, n, k from (
               select y_true, y_score, row_number() over (order by y_score) as r, sum(y_true) over () as p, sum(1 - y_true) over () as n,
                 abs(sum(y_true) over w / sum(y_true) over () - sum(1 - y_true) over w / sum(1 - y_true) over ()) as k
               from scores window w as (order by y_score)))""",
    ),
    Query(
        "m5_gini",
        "model:s gini_coefficient:f",
        lambda s, d: M.ranking_metrics(_hist(s, d), BY),
        f"select model, 2 * roc_auc - 1 as gini_coefficient from ({AUC})",
    ),
    Query("m6_ks", "model:s ks_statistic:f", lambda s, d: M.ranking_metrics(_hist(s, d), BY), KS),
    Query("m7_pr_auc", "model:s pr_auc:f", lambda s, d: M.ranking_metrics(_hist(s, d), BY), PR),
    Query(
        "m8_pr_curve",
        "model:s threshold:f precision:f recall:f f1:f",
        lambda s, d: M.pr_curve(_hist(s, d), BY),
        f"""select model, score as threshold, tp / (tp + fp) as precision, tp / p as recall, 2 * tp / (tp + fp + p) as f1
            from ({CURVE})""",
    ),
    Query(
        "m8_pr_points",
        "model:s best_threshold:f best_f1:f crossing_threshold:f",
        lambda s, d: M.pr_points(M.pr_curve(_hist(s, d), BY), BY),
        f"""select model, max(score) filter (a = 1) as best_threshold, max(f1) filter (a = 1) as best_f1,
              max(score) filter (b = 1) as crossing_threshold
            from (select *, row_number() over (partition by model order by f1 desc, score) as a,
                    row_number() over (partition by model order by abs(prec - recall), score) as b
                  from (select model, score, tp / (tp + fp) as prec, tp / p as recall, 2 * tp / (tp + fp + p) as f1 from ({CURVE})))
            group by 1""",
    ),
    Query(
        "m9_roc_curve",
        "model:s cut:f sensitivity:f specificity:f distance:f",
        lambda s, d: M.roc_curve(_hist(s, d), BY),
        f"""select model, score as cut, tp / p as sensitivity, 1 - fp / n as specificity, abs(tp / p - (1 - fp / n)) as distance
            from ({CURVE})""",
    ),
    Query(
        "f3_best_cuts",
        "model:s cut:f sensitivity:f specificity:f distance:f",
        lambda s, d: M.best_cuts(M.roc_curve(_hist(s, d), BY), BY),
        f"""select model, round(score, 3) as cut, round(sens, 3) as sensitivity, round(spec, 3) as specificity,
              round(abs(sens - spec), 3) as distance
            from (select model, score, tp / p as sens, 1 - fp / n as spec,
                    row_number() over (partition by model order by abs(tp / p - (1 - fp / n)), score) as r from ({CURVE})) where r <= 5""",
    ),
    Query(
        "m10_ks_curve",
        "model:s threshold:f cum_pos:f cum_neg:f diff:f",
        lambda s, d: M.ks_curve(_hist(s, d), BY),
        f"select *, cum_neg - cum_pos as diff from ({GRID})",
    ),
    Query(
        "m10_ks_point",
        "model:s ks:f ks_threshold:f",
        lambda s, d: M.ks_point(M.ks_curve(_hist(s, d), BY), BY),
        f"""select model, ks, ks_threshold from (select model, cum_neg - cum_pos as ks, threshold as ks_threshold,
              row_number() over (partition by model order by cum_neg - cum_pos desc, threshold) as r from ({GRID})) where r = 1""",
    ),
    Query(
        "m11_lorenz",
        "model:s score:f cum_population:f cum_positives:f",
        lambda s, d: M.lorenz(_hist(s, d), BY),
        f"select model, score, (tp + fp) / (p + n) as cum_population, tp / p as cum_positives from ({CURVE})",
    ),
    Query(
        "m12_calibration",
        "model:s bin:i n:i mean_score:f positive_rate:f",
        lambda s, d: M.calibration(_hist(s, d), BY),
        """select model, least(greatest(ceil(y_score * 15) - 1, 0), 14) as bin, count(*) as n, avg(y_score) as mean_score,
           avg(y_true) as positive_rate from scores group by 1, 2""",
    ),
    Query(
        "m13_report",
        "model:s label:s precision:f recall:f f1:f support:i",
        lambda s, d: M.report(_decided(s, d), "y_true", "pred", BY),
        f"""select model, unnest(['0', '1', 'macro avg', 'weighted avg']) as label,
              unnest([p0, p1, (p0 + p1) / 2, (n0 * p0 + n1 * p1) / n]) as precision,
              unnest([r0, r1, (r0 + r1) / 2, (n0 * r0 + n1 * r1) / n]) as recall,
              unnest([f0, f1, (f0 + f1) / 2, (n0 * f0 + n1 * f1) / n]) as f1, unnest([n0, n1, n, n]) as support from ({TERMS})""",
    ),
    Query(
        "m14_metrics_table",
        "model:s metric:s value:f",
        lambda s, d: M.metrics_table(_decided(s, d), "y_true", "pred", "y_score", BY),
        f"""{LONG_VALUES} union all select model, unnest(['roc_auc', 'roc_auc_ovr', 'roc_auc_ovo', 'roc_auc_ovr_weighted',
              'roc_auc_ovo_weighted', 'gini_coefficient']), unnest([roc_auc, roc_auc, roc_auc, roc_auc, roc_auc, 2 * roc_auc - 1])
            from ({AUC}) union all select model, 'pr_auc', pr_auc from ({PR}) union all select model, 'ks_statistic', ks_statistic from ({KS})
            union all select model, 'brier_score_loss', brier_score_loss from ({BRIER})""",
    ),
]
