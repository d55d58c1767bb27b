"""Edge cases on hand-made frames."""

import math
import statistics
from datetime import date, datetime
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from clientpulse.operators import history as H
from clientpulse.operators import metrics as M
from clientpulse.operators import statistics as S
from clientpulse.operators.folds import add_period, assert_no_leak, calendar, expanding_folds
from clientpulse.operators.rollup import category_profile
from clientpulse.operators.sampling import balanced_weight, fraction_sample, stratified_sample
from clientpulse.plans.features import feats_purchase, feats_trx, trx_rollup
from clientpulse.plans.master import pick_columns
from clientpulse.sources.bucketed import exchanges


def test_mode_and_entropy_with_null_category(spark):
    rows = [(1, None), (1, None), (1, 2), (1, 10), (1, 10), (2, 5)]
    got = {r.k: r for r in category_profile(spark.createDataFrame(rows, "k int, c int"), ["k"], {"c": "c"}).collect()}
    assert got[1].c_mode is None and got[1].c_distinct == 2
    shares = [2 / 5, 2 / 5, 1 / 5]
    assert got[1].c_entropy == pytest.approx(-sum(p * math.log(p) for p in shares))
    assert got[2].c_mode == 5 and got[2].c_entropy == pytest.approx(0.0, abs=1e-12)


def test_mode_ties_follow_the_number_not_its_text(spark):
    frame = spark.createDataFrame([(1, 10), (1, 9)], "k int, c int")
    assert category_profile(frame, ["k"], {"c": "c"}).first().c_mode == 9


def test_single_row_windows_and_zero_lag(spark):
    frame = spark.createDataFrame([(1, date(2020, 1, 1), 0), (1, date(2020, 2, 1), 3), (2, date(2020, 1, 1), 4)], "k int, mon date, x int")
    span = H.timeline("k", "mon")
    out = frame.withColumns({"s": H.trailing(span, "x", "std", 3), "r": H.change_over(span, "x", 1)})
    got = {(r.k, r.mon.month): (r.s, r.r) for r in out.collect()}
    assert got[2, 1] == (None, None)
    assert got[1, 2][1] is None


def test_lookahead_is_five_rows(spark):
    frame = spark.createDataFrame([(1, m, int(m == 6)) for m in range(1, 9)], "k int, mon int, flag int")
    out = frame.withColumn("n", H.lookahead_max(H.timeline("k", "mon"), "flag", 4))
    assert [r.n for r in out.orderBy("mon").collect()] == [0, 1, 1, 1, 1, 1, 0, 0]


def test_growth_streak(spark):
    values = [1, 2, 3, 4, 4, 5, 6, 7]
    frame = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, mon int, x int")
    out = H.growth_streak(frame, "k", "mon", "x", "s").orderBy("mon").collect()
    assert [r.s for r in out] == [0, 0, 0, 1, 0, 0, 0, 1]


def test_features_only_describe_earlier_months(spark):
    """Changing a month's values must not change any feature row of that month or an earlier one."""
    base = [(1, date(2020, m, 1), m % 2, 0, 0, 1, m, m) for m in range(1, 7)]
    schema = "client_id int, mon date, target_1 int, target_2 int, target_3 int, target_4 int, trans_count int, diff_trans_date int"
    other = base[:-1] + [(1, date(2020, 6, 1), 1, 1, 1, 1, 99, 99)]
    a, b = (feats_purchase(spark.createDataFrame(r, schema)).filter("mon <= date'2020-06-01'") for r in (base, other))
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def brute(rows):
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    cuts = sorted({s for _, s in rows})
    ks = max(abs(sum(p <= c for p in pos) / len(pos) - sum(n <= c for n in neg) / len(neg)) for c in cuts)
    area, before = 0.0, (0.0, 1.0)
    for c in reversed(cuts):
        tp, fp = sum(p >= c for p in pos), sum(n >= c for n in neg)
        here = (tp / len(pos), tp / (tp + fp))
        area += (here[0] - before[0]) * (here[1] + before[1]) / 2
        before = here
    return auc, ks, area, sum((y - s) ** 2 for y, s in rows) / len(rows)


def test_ranking_metrics_with_ties(spark):
    rows = [((i * 7) % 3 % 2, (i * 13 % 20) / 20) for i in range(200)]
    hist = M.score_histogram(spark.createDataFrame(rows, "y int, s double"), "y", "s")
    got = M.ranking_metrics(hist).first()
    assert (got.roc_auc, got.ks_statistic, got.pr_auc, got.brier_score_loss) == pytest.approx(brute(rows))


def test_auc_ignores_monotone_transforms_and_equal_scores(spark):
    rows = spark.createDataFrame([(i % 3 == 0, (i * 11 % 17) / 17) for i in range(90)], "b boolean, s double").select(
        F.col("b").cast("int").alias("y"), "s"
    )
    auc = [M.ranking_metrics(M.score_histogram(rows.withColumn("s", e), "y", "s")).first().roc_auc for e in (F.col("s"), F.exp("s") - 5)]
    assert auc[0] == pytest.approx(auc[1])
    assert M.ranking_metrics(M.score_histogram(rows.withColumn("s", F.lit(0.5)), "y", "s")).first().roc_auc == 0.5


def test_metrics_with_one_class(spark):
    rows = spark.createDataFrame([(1, 0.2, 0), (1, 0.9, 1)], "y int, s double, pred int")
    assert M.ranking_metrics(M.score_histogram(rows, "y", "s")).first().roc_auc is None
    got = M.threshold_metrics(rows, "y", "pred").first()
    assert (got.fpr, got.fnr, got.matthews_corrcoef) == (0.0, 0.5, 0.0)


def test_cramers_v_yates_on_two_by_two(spark):
    cells = {("a", 0): 10, ("a", 1): 20, ("b", 0): 25, ("b", 1): 15}
    rows = [k for k, n in cells.items() for _ in range(n)]
    got = S.cramers_v(spark.createDataFrame(rows, "c string, target int"), "target", ["c"]).first()
    n, chi = 70, 0.0
    for (level, y), o in cells.items():
        e = sum(v for (a, _), v in cells.items() if a == level) * sum(v for (_, b), v in cells.items() if b == y) / n
        chi += (abs(o - e) - 0.5) ** 2 / e
    assert got.v == pytest.approx(math.sqrt(chi / n))


def test_cramers_v_of_a_single_class_is_null(spark):
    frame = spark.createDataFrame([("a", 0), ("b", 0)], "c string, target int")
    assert S.cramers_v(frame, "target", ["c"]).first().v is None


def test_f_tail_known_values():
    # t distribution with 10 degrees: P(|t| > 2.228139) = 0.05, F = t squared
    f = 2.2281388519649385**2
    assert S.beta_tail(10 / (10 + f), 5.0, 0.5) == pytest.approx(0.05, abs=1e-9)
    assert S.beta_tail(0.3, 2.0, 3.0) == pytest.approx(0.3483, abs=1e-9)


def test_iv_leaves_out_pure_bins(spark):
    rows = [("a", 0), ("a", 1), ("a", 1), ("b", 0), ("b", 0), ("b", 1), ("c", 1)]
    got = S.information_value(spark.createDataFrame(rows, "c string, target int"), "target", [], ["c"]).first()
    pairs = [(1 / 3, 2 / 3), (2 / 3, 1 / 3)]
    assert got.iv == pytest.approx(sum((g - b) * math.log(g / b) for g, b in pairs))


def test_vif_elimination(spark):
    rows = [(float(i), 2.0 * i + (i % 3), float(i * 17 % 7)) for i in range(60)]
    got = {r.feature: r for r in S.vif_eliminate(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert sum(r.dropped_at is not None for r in got.values()) == 1
    assert all(r.vif <= 5 for r in got.values() if r.dropped_at is None)


def test_quotas_are_met_and_stable(spark):
    zero = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 3).alias("c"))
    one = spark.range(5000, 5300).select(F.col("id").alias("k"))
    first, again = (stratified_sample(zero.repartition(n), one, "c", ["k"], 0.6) for n in (3, 7))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    kept = first.filter("class = 0").count()
    assert abs(kept - round(0.6 / 0.4 * 300)) <= 3
    assert first.filter("class = 1").count() == 300


def test_fraction_sample_checks_the_fraction(spark):
    with pytest.raises(ValueError):
        fraction_sample(spark.range(3), ["id"], 0.0)
    assert fraction_sample(spark.range(3), ["id"], 1.0).count() == 3


def test_balanced_weight(spark):
    frame = spark.createDataFrame([(0,)] * 8 + [(1,)] * 2, "y int")
    got = balanced_weight(frame, "y", 2).filter("y = 1").first().weight
    assert got == pytest.approx(2.0)


def test_calendar_rejects_unknown_names(spark):
    bounds = spark.createDataFrame([(date(2020, 1, 15), date(2020, 7, 1))], "start date, end date")
    with pytest.raises(ValueError):
        calendar(bounds, "daily")
    with pytest.raises(ValueError):
        add_period("start", "daily")
    got = sorted(r.cut for r in calendar(bounds, "bi_monthly").collect())
    assert got == [date(2020, 2, 3), date(2020, 4, 1), date(2020, 6, 1)]


def test_leak_check(spark):
    rows = spark.createDataFrame([(date(2020, m, 1),) for m in range(1, 6)], "mon date")
    cuts = F.array(F.lit(date(2020, 3, 1)), F.lit(date(2020, 4, 1)))
    folds = expanding_folds(rows, "mon", cuts)
    assert_no_leak(folds, "mon")
    bad = folds.unionByName(folds.filter("part = 'test'").withColumn("part", F.lit("train")))
    with pytest.raises(ValueError):
        assert_no_leak(bad, "mon")


def test_pick_columns_reports_missing(spark):
    with pytest.raises(ValueError, match="nope"):
        pick_columns(spark.range(1), ["id"], ["nope"])


def test_transactions_move_as_combinations_and_amounts_are_exact(spark):
    """One row per combination moves, then to its client; large amounts that differ little keep their deviation."""
    months = [datetime(2020, m, d) for m, d in ((1, 3), (1, 3), (1, 9), (2, 1))]
    rows = [
        (c, t, e, cur, None if (i + (c or 0)) % 5 == 0 else 1e9 + i * 1e-3, s, None)
        for c in (1, 2, None)
        for t in months
        for i, (e, cur, s) in enumerate([("a", 1, "x"), ("b", 1, "x"), ("b", None, "y"), ("b", 2, None), (None, 9, "y"), ("a", 1, "y")])
    ] + [(3, months[0], "a", 1, 7.5, "x", "z")]
    schema = "client_id int, event_time timestamp, event_type string, currency int, amount double, src_type11 string, dst_type11 string"
    trx = spark.createDataFrame(rows, schema)
    rolled = trx_rollup(trx, (1, 2, 3))
    assert exchanges(feats_trx(trx, (1, 2, 3))) == 2
    got = {(r.client_id, r.mon.month): r for r in rolled.collect()}
    assert len(got) == 7
    for (client, mon), r in got.items():
        own = [x for x in rows if x[0] == client and x[1].month == mon]
        paid = [x[4] for x in own if x[3] == 1 and x[4] is not None]
        assert r.trans_trx_cnt_m == len(own) and r.trans_trx_others_currency_cnt_m == sum(x[3] not in (1, 2, 3) for x in own)
        assert r.trans_days_active_m == len({x[1] for x in own}) and r.trans_type_src_account_cnt_m == len({x[5] for x in own} - {None})
        assert r.trans_amt_trx_currency_1_sum_m == pytest.approx(sum(paid)) and r.trans_amt_currency_1_avg_m == pytest.approx(sum(paid) / len(paid))
        if len(paid) > 1:
            assert r.trans_amt_currency_1_std_m == pytest.approx(statistics.stdev(map(Fraction, paid)), rel=1e-3)
        else:
            assert r.trans_amt_currency_1_std_m is None
