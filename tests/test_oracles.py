"""Registered queries against DuckDB. ``ALL_QUERIES=1`` runs every one instead of the quicker selection."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

from check_oracles import compare, duck, rows_of  # noqa: E402

from clientpulse.catalog import all_queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUICK = (
    "a3_split_layout b8_latest b10_temporal_split c4_pairs_in_row c10_scope_split d6_share_of_total d12_symmetric_pivot "
    "d13_transitions d15_mode d16_gap_distribution d17_box_plot e2_lookahead e5_rate_of_change e7_recency e14_quota "
    "feats_trx feats_geo feats_dialog feats_purchase h8_ids_in_text h21_reply_json i4_spearman i7_anova i8_cramers_v i12_iv_table "
    "j1_outlier_capping j4_random_imputation j5_woe_categories j6_rare_levels j8_woe_bins k4_stratified_sample l1_calendar "
    "l4_rolling_folds m2_threshold_metrics m8_pr_points m10_ks_point m12_calibration m14_metrics_table n5_global_reasons n9_scope "
    "n12_answers o4_answer_stream"
).split()
KEYS = [k for k, q in all_queries().items() if q.body and (os.environ.get("ALL_QUERIES") or k in QUICK)]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_quick_selection_exists():
    assert set(QUICK) <= set(all_queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, con, key):
    query = all_queries()[key]
    df = query.run(spark, SF)
    rel = con.execute(query.oracle())
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    got = rows_of(df.columns, df.collect())
    assert got
    assert compare(got, rows_of(names, rel.fetchall())) is None
