"""The four feature tables and the master table."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientpulse.catalog.base import Query
from clientpulse.plans import features as FT
from clientpulse.plans import master as M
from clientpulse.plans.target import lookahead_label
from clientpulse.sources import bindings as B
from clientpulse.sources import bucketed as BU

OVER = "over (partition by client_id order by mon"


def _profile_sql(source: str, col: str) -> str:
    return f"""select client_id, mon, -sum(p * ln(p)) as h, max(v) filter (r = 1) as m from (
        select client_id, mon, {col} as v, count(*) / sum(count(*)) over (partition by client_id, mon) as p,
          row_number() over (partition by client_id, mon order by count(*) desc, {col} asc nulls first) as r
        from {source} group by client_id, mon, {col}) group by 1, 2"""


TRX_BODY = f"""
select client_id, cast(mon + interval 1 month as date) as mon, days as trans_days_active_m, n as trans_trx_cnt_m,
  types as trans_type_trx_cnt_m, currencies as trans_type_currency_cnt_m, src as trans_type_src_account_cnt_m,
  dst as trans_type_dst_account_cnt_m, c1 as trans_trx_currency_1_cnt_m, c2 as trans_trx_currency_2_cnt_m,
  c3 as trans_trx_currency_3_cnt_m, c0 as trans_trx_others_currency_cnt_m, s1 as trans_amt_trx_currency_1_sum_m,
  s2 as trans_amt_trx_currency_2_sum_m, s3 as trans_amt_trx_currency_3_sum_m, a1 as trans_amt_currency_1_avg_m,
  d1 as trans_amt_currency_1_std_m, em as trans_event_type_mode_m, eh as trans_event_type_entropy_m,
  dm as trans_dst_type_mode_m, dh as trans_dst_type_entropy_m, n / days as trans_trx_per_day_m,
  avg(dh) {OVER} rows 2 preceding) as trans_dst_type_entropy_ravg_3m,
  avg(eh) {OVER} rows 2 preceding) as trans_event_type_entropy_ravg_3m,
  n / nullif(lag(n, 1) {OVER}), 0) - 1 as trans_trx_cnt_roc_1m, n / nullif(lag(n, 3) {OVER}), 0) - 1 as trans_trx_cnt_roc_3m,
  n / nullif(lag(n, 6) {OVER}), 0) - 1 as trans_trx_cnt_roc_6m, n / nullif(lag(n, 12) {OVER}), 0) - 1 as trans_trx_cnt_roc_12m,
  stddev_samp(days) {OVER} rows 5 preceding) as trans_days_active_rstd_6m,
  case when currencies > 1 then 1 else 0 end as trans_ind_trx_multicurrency,
  case when sum(g) {OVER} rows 2 preceding) = 3 then 1 else 0 end as trx_growth_streak_3m
from (
  select b.*, e.h as eh, e.m as em, d.h as dh, d.m as dm, case when n > lag(n) over (partition by b.client_id order by b.mon) then 1 else 0 end as g
  from (select client_id, mon, count(distinct cast(event_time as date)) as days, count(*) as n,
          count(distinct event_type) as types, count(distinct currency) as currencies, count(distinct src_type11) as src,
          count(distinct dst_type11) as dst, count(*) filter (currency = 1) as c1, count(*) filter (currency = 2) as c2,
          count(*) filter (currency = 3) as c3, count(*) filter (currency is null or currency not in (1, 2, 3)) as c0,
          coalesce(sum(amount) filter (currency = 1), 0) as s1, coalesce(sum(amount) filter (currency = 2), 0) as s2,
          coalesce(sum(amount) filter (currency = 3), 0) as s3, avg(amount) filter (currency = 1) as a1,
          stddev_samp(amount) filter (currency = 1) as d1 from trx group by 1, 2) b
  join ({_profile_sql('trx', 'event_type')}) e on b.client_id = e.client_id and b.mon = e.mon
  join ({_profile_sql('trx', 'dst_type11')}) d on b.client_id = d.client_id and b.mon = d.mon)"""

TRX_COLUMNS = """client_id:i mon:d trans_days_active_m:i trans_trx_cnt_m:i trans_type_trx_cnt_m:i trans_type_currency_cnt_m:i
trans_type_src_account_cnt_m:i trans_type_dst_account_cnt_m:i trans_trx_currency_1_cnt_m:i trans_trx_currency_2_cnt_m:i
trans_trx_currency_3_cnt_m:i trans_trx_others_currency_cnt_m:i trans_amt_trx_currency_1_sum_m:f2
trans_amt_trx_currency_2_sum_m:f2 trans_amt_trx_currency_3_sum_m:f2 trans_amt_currency_1_avg_m:f4
trans_amt_currency_1_std_m:f4 trans_event_type_mode_m:s trans_event_type_entropy_m:f trans_dst_type_mode_m:s
trans_dst_type_entropy_m:f trans_trx_per_day_m:f trans_dst_type_entropy_ravg_3m:f trans_event_type_entropy_ravg_3m:f
trans_trx_cnt_roc_1m:f trans_trx_cnt_roc_3m:f trans_trx_cnt_roc_6m:f trans_trx_cnt_roc_12m:f trans_days_active_rstd_6m:f
trans_ind_trx_multicurrency:i trx_growth_streak_3m:i"""

GEO_BODY = f"""
select client_id, cast(mon + interval 1 month as date) as mon, n as geo_ping_cnt_m, days as geo_days_active_m,
  day_n as geo_day_cnt_m, night_n as geo_night_cnt_m, g4 as geo_geohash_4_cnt_m, g5 as geo_geohash_5_cnt_m,
  g6 as geo_geohash_6_cnt_m, h4 as geo_geohash_4_entropy_m, h5 as geo_geohash_5_entropy_m, h6 as geo_geohash_6_entropy_m,
  avg(days) {OVER} rows 5 preceding) as geo_days_active_avg_6m,
  stddev_samp(h4) {OVER} rows 5 preceding) as geo_geohash_4_rstd_6m, stddev_samp(h5) {OVER} rows 5 preceding) as geo_geohash_5_rstd_6m,
  stddev_samp(h6) {OVER} rows 5 preceding) as geo_geohash_6_rstd_6m, g6 / nullif(lag(g6, 1) {OVER}), 0) - 1 as geo_geohash_6_roc_1m,
  g6 / nullif(lag(g6, 3) {OVER}), 0) - 1 as geo_geohash_6_roc_3m, g6 / nullif(lag(g6, 6) {OVER}), 0) - 1 as geo_geohash_6_roc_6m,
  n / days as geo_usage_per_day_m
from (select b.*, x.h as h4, y.h as h5, z.h as h6 from (
  select client_id, mon, count(*) as n, count(distinct day) as days, count(*) filter (hour(event_time) between 6 and 17) as day_n,
    count(*) filter (hour(event_time) not between 6 and 17) as night_n, count(distinct geohash_4) as g4,
    count(distinct geohash_5) as g5, count(distinct geohash_6) as g6 from geo group by 1, 2) b
  join ({_profile_sql('geo', 'geohash_4')}) x on b.client_id = x.client_id and b.mon = x.mon
  join ({_profile_sql('geo', 'geohash_5')}) y on b.client_id = y.client_id and b.mon = y.mon
  join ({_profile_sql('geo', 'geohash_6')}) z on b.client_id = z.client_id and b.mon = z.mon)"""

GEO_COLUMNS = """client_id:i mon:d geo_ping_cnt_m:i geo_days_active_m:i geo_day_cnt_m:i geo_night_cnt_m:i geo_geohash_4_cnt_m:i
geo_geohash_5_cnt_m:i geo_geohash_6_cnt_m:i geo_geohash_4_entropy_m:f geo_geohash_5_entropy_m:f geo_geohash_6_entropy_m:f
geo_days_active_avg_6m:f geo_geohash_4_rstd_6m:f geo_geohash_5_rstd_6m:f geo_geohash_6_rstd_6m:f geo_geohash_6_roc_1m:f
geo_geohash_6_roc_3m:f geo_geohash_6_roc_6m:f geo_usage_per_day_m:f"""

DIALOG_BODY = f"""
select client_id, cast(mon + interval 1 month as date) as mon, n as dialog_cnt_m, days as dialog_days_active_m,
  nm as dialog_norm_mean_m, ns as dialog_norm_std_m, nd as dialog_norm_median_m, drift as dialog_drift_m,
  cm as dialog_cos_dist_mean_m, cs as dialog_cos_dist_std_m, cd as dialog_cos_dist_median_m, n / days as dialog_avg_per_day_m,
  stddev_samp(drift) {OVER} rows 2 preceding) as dialog_drift_rstd_3m,
  stddev_samp(drift) {OVER} rows 5 preceding) as dialog_drift_rstd_6m, date_diff('month', lag(mon) {OVER}), mon) as dialog_recency_m
from (
  select client_id, mon, count(*) as n, count(distinct event_time) as days, avg(v) as nm, stddev_samp(v) as ns, median(v) as nd,
    list_distance(arg_min(embedding, event_time), arg_max(embedding, event_time)) as drift,
    avg(c) as cm, stddev_samp(c) as cs, median(c) as cd
  from (select *, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) as v,
          1 - list_cosine_similarity(embedding, lag(embedding) over (partition by client_id, mon order by event_time)) as c
        from dialog) group by 1, 2)"""

DIALOG_COLUMNS = """client_id:i mon:d dialog_cnt_m:i dialog_days_active_m:i dialog_norm_mean_m:f dialog_norm_std_m:f
dialog_norm_median_m:f dialog_drift_m:f dialog_cos_dist_mean_m:f dialog_cos_dist_std_m:f dialog_cos_dist_median_m:f
dialog_avg_per_day_m:f dialog_drift_rstd_3m:f dialog_drift_rstd_6m:f dialog_recency_m:f"""

PURCHASE_BODY = f"""
select client_id, cast(mon + interval 1 month as date) as mon, trans_count as pur_trans_count_m, diff_trans_date as pur_diff_trans_date_m,
  sum(target_1) {OVER} rows unbounded preceding) as pur_product_1_rsum_m, sum(target_2) {OVER} rows unbounded preceding) as pur_product_2_rsum_m,
  sum(target_3) {OVER} rows unbounded preceding) as pur_product_3_rsum_m, sum(target_4) {OVER} rows unbounded preceding) as pur_product_4_rsum_m,
  bought as pur_any_purchase, avg(trans_count) {OVER} rows 2 preceding) as pur_trans_count_avg_3m,
  avg(trans_count) {OVER} rows 5 preceding) as pur_trans_count_avg_6m, stddev_samp(trans_count) {OVER} rows 2 preceding) as pur_trans_count_std_3m,
  stddev_samp(trans_count) {OVER} rows 5 preceding) as pur_trans_count_std_6m,
  date_diff('month', last_value(case when bought > 0 then mon end ignore nulls) {OVER} rows between unbounded preceding and 1 preceding), mon)
    as pur_recency_purchase,
  sum(bought) {OVER} rows 3 preceding) as pur_any_purchase_sum_3m, sum(bought) {OVER} rows 5 preceding) as pur_any_purchase_sum_6m
from (select *, case when target_1 + target_2 + target_3 + target_4 > 0 then 1 else 0 end as bought from purchase)"""

PURCHASE_COLUMNS = """client_id:i mon:d pur_trans_count_m:i pur_diff_trans_date_m:i pur_product_1_rsum_m:i pur_product_2_rsum_m:i
pur_product_3_rsum_m:i pur_product_4_rsum_m:i pur_any_purchase:i pur_trans_count_avg_3m:f pur_trans_count_avg_6m:f
pur_trans_count_std_3m:f pur_trans_count_std_6m:f pur_recency_purchase:f pur_any_purchase_sum_3m:i pur_any_purchase_sum_6m:i"""

MASTER_COLUMNS = """client_id:i mon:d target_1:i dialog_cnt_m:i trans_trx_cnt_m:i trans_event_type_entropy_m:f
trans_trx_cnt_roc_1m:f geo_ping_cnt_m:i pur_product_1_rsum_m:i pur_recency_purchase:f"""


def master_parts(spark, sf):
    """Product-1 label and the features of all four tables."""
    purchase = B.purchase(spark, sf)
    return [
        lookahead_label(purchase, "target_1", "target_1"),
        FT.feats_dialog(B.dialog(spark, sf), summaries=False).select("client_id", "mon", "dialog_cnt_m"),
        FT.feats_trx(B.trx(spark, sf), B.CURRENCIES),
        FT.feats_geo(B.geo(spark, sf)).select("client_id", "mon", "geo_ping_cnt_m"),
        FT.feats_purchase(purchase),
    ]


def master(spark, sf):
    return M.join_features(*master_parts(spark, sf))


def bucketed_master(spark, sf, buckets: int = 16):
    """The master table from tables stored in buckets of the key: the join moves nothing."""
    # a bucket is a hash of the typed key, so the key has one type in all tables
    typed = [part.withColumn("client_id", F.col("client_id").cast("long")) for part in master_parts(spark, sf)]
    label, *tables = [BU.write_bucketed(part, M.KEY, buckets) for part in typed]
    return BU.co_located(spark, label, tables, M.KEY)


def exchange_counts(spark, sf):
    """How many exchanges the join of the bucketed tables plans."""
    return spark.createDataFrame([("c1_bucketed_master", BU.exchanges(bucketed_master(spark, sf)))], "plan string, exchanges int")


QUERIES = [
    Query("feats_trx", TRX_COLUMNS, lambda s, d: FT.feats_trx(B.trx(s, d), B.CURRENCIES), TRX_BODY),
    Query("feats_geo", GEO_COLUMNS, lambda s, d: FT.feats_geo(B.geo(s, d), "week"), GEO_BODY),
    Query("feats_dialog", DIALOG_COLUMNS, lambda s, d: FT.feats_dialog(B.dialog(s, d)), DIALOG_BODY),
    Query("feats_purchase", PURCHASE_COLUMNS, lambda s, d: FT.feats_purchase(B.purchase(s, d)), PURCHASE_BODY),
    *[
        Query(
            key,
            MASTER_COLUMNS,
            build,
            f"""select l.client_id, l.mon, l.target_1, d.dialog_cnt_m, t.trans_trx_cnt_m, t.trans_event_type_entropy_m,
              t.trans_trx_cnt_roc_1m, g.geo_ping_cnt_m, p.pur_product_1_rsum_m, p.pur_recency_purchase
            from (select client_id, mon, target_1 from (select client_id, mon,
                    max(target_1) over (partition by client_id order by mon rows between current row and 4 following) as target_1
                    from purchase) where mon <= (select max(mon) - interval 4 month from purchase)) l
            left join ({DIALOG_BODY}) d on l.client_id = d.client_id and l.mon = d.mon
            left join ({TRX_BODY}) t on l.client_id = t.client_id and l.mon = t.mon
            left join (select client_id, date '2024-02-01' as mon, count(*) as geo_ping_cnt_m from geo group by 1) g
              on l.client_id = g.client_id and l.mon = g.mon
            left join ({PURCHASE_BODY}) p on l.client_id = p.client_id and l.mon = p.mon""",
        )
        for key, build in (("c1_master", master), ("c1_bucketed_master", bucketed_master))
    ],
    Query(
        "c1_bucketed_exchanges",
        "plan:s exchanges:i",
        exchange_counts,
        "select 'c1_bucketed_master' as plan, 0 * count(*) as exchanges from purchase",
    ),
]
