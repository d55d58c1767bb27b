"""Sources, projections, joins, aggregations, windows, sorts, sets and scalars (A-H)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientpulse.catalog.base import Query
from clientpulse.functions.dates import is_day, is_night, month_gap, period_start, shift_months
from clientpulse.functions.scalars import any_flag, hash_uniform, percent_text, signed_log
from clientpulse.functions.text import ids_in_text, normal_id, reply_ids, reply_intents, split_pair
from clientpulse.functions.vectors import cosine_distance, euclidean, l2_norm, subtract, total
from clientpulse.operators import history as H
from clientpulse.operators import pairs as P
from clientpulse.operators import rollup as R
from clientpulse.operators.ordered import exact_quantiles, previous_row
from clientpulse.operators.sampling import pick_quota
from clientpulse.operators.statistics import zero_variance
from clientpulse.plans import features as FT
from clientpulse.plans import master as M
from clientpulse.plans import recommend as RC
from clientpulse.plans.features import KEY
from clientpulse.plans.target import by_class, latest, observable
from clientpulse.session import scratch_path
from clientpulse.sources import artifacts, tables
from clientpulse.sources import bindings as B

FLAGS = {f"product_{k}": f"target_{k}" for k in range(1, 5)}
SPAN = lambda: H.timeline("client_id", "mon")
ANY = "case when target_1 + target_2 + target_3 + target_4 > 0 then 1 else 0 end"
OVER = "over (partition by client_id order by mon"


# A ------------------------------------------------------------------------------------------------------------------
def _sink(spark, sf):
    path = scratch_path(spark, "a2")
    source = B.purchase(spark, sf)
    tables.write_table(source, path)
    return tables.read_table(spark, path, source.schema)


def _split_layout(spark, sf):
    path = scratch_path(spark, "a3")
    purchase = B.purchase(spark, sf)
    masters = {
        k: M.temporal_split(purchase.select(*KEY, f"target_{k}", "trans_count"), purchase) for k in B.PRODUCTS
    }
    tables.write_split(masters, path)
    return tables.read_split(spark, path, 3, "test")


def _feature_lists(spark, sf):
    path = scratch_path(spark, "a4")
    useful = zero_variance(B.feat(spark, sf), ["f_qty", "f_skew", "f_disc", "f_const"]).filter("constant = 0")
    products = F.explode(F.array(*[F.lit(f"product_{k}") for k in B.PRODUCTS])).alias("product")
    lists = useful.select("feature", products).groupBy("product").agg(F.sort_array(F.collect_list("feature")).alias("features"))
    artifacts.write_feature_lists(lists, path)
    return artifacts.read_feature_lists(spark, path).select("product", F.explode("features").alias("feature"))


def _reasons_artifact(spark, sf):
    from clientpulse.catalog.answers import stored_reasons

    path = scratch_path(spark, "a5")
    artifacts.write_reasons(stored_reasons(spark, sf), path)
    back = artifacts.read_reasons(spark, path)
    return back.withColumn("reasons", F.array_join("reasons", "; "))


def _literal(spark, sf):
    rows = [("BUILDING", 1), ("HOUSEHOLD", 2), ("MACHINERY", 3)]
    dim = tables.literal_table(spark, rows, "segment string, team int")
    customers = B.raw(spark, sf, "customer")
    return customers.join(dim, customers.c_mktsegment == dim.segment).select("c_custkey", "segment", "team")


SPLIT_START = """(select max(mon) - to_months(cast(floor(0.3 * count(distinct mon)) as int)) from purchase)"""

QUERIES = [
    Query(
        "a1_scan",
        "o_custkey:i o_totalprice:f",
        lambda s, d: tables.read_table(
            s, f"{d}/orders.parquet", "o_custkey bigint, o_totalprice double, o_orderpriority string"
        ).filter(F.col("o_totalprice") > 400000).select("o_custkey", "o_totalprice"),
        "select o_custkey, o_totalprice from orders where o_totalprice > 400000",
    ),
    Query(
        "a2_sink",
        "client_id:i mon:d target_1:i target_2:i target_3:i target_4:i trans_count:i diff_trans_date:i",
        _sink,
        "select * from purchase",
    ),
    Query(
        "a3_split_layout",
        "client_id:i mon:d target_3:i trans_count:i",
        _split_layout,
        f"select client_id, mon, target_3, trans_count from purchase where mon > {SPLIT_START}",
    ),
    Query(
        "a4_feature_lists",
        "product:s feature:s",
        _feature_lists,
        """select product, feature from (values ('product_1'), ('product_3'), ('product_4')) p(product),
           (select 'f_qty' as feature, var_samp(f_qty) as v from feat union all select 'f_skew', var_samp(f_skew) from feat
            union all select 'f_disc', var_samp(f_disc) from feat union all select 'f_const', var_samp(f_const) from feat)
           where v > 0""",
    ),
    Query(
        "a5_reasons_artifact",
        "client_id:s product_id:i reasons:s",
        _reasons_artifact,
        """select p.client_id, p.product_id, string_agg(reason, '; ' order by place) as reasons
           from positives p join reason_rows r on p.client_id = r.client_id group by 1, 2""",
    ),
    Query(
        "a6_literal",
        "c_custkey:i segment:s team:i",
        _literal,
        """select c_custkey, segment, team from customer join (values ('BUILDING', 1), ('HOUSEHOLD', 2), ('MACHINERY', 3))
           t(segment, team) on c_mktsegment = segment""",
    ),
    # B --------------------------------------------------------------------------------------------------------------
    Query(
        "b1_rename",
        "client_id:i mon:d product_1:i product_2:i product_3:i product_4:i",
        lambda s, d: B.purchase(s, d).withColumnsRenamed({c: p for p, c in FLAGS.items()}),
        """select client_id, mon, target_1 as product_1, target_2 as product_2, target_3 as product_3,
           target_4 as product_4 from purchase""",
    ),
    Query(
        "b2_derive",
        "client_id:i event_time:d is_night:i",
        lambda s, d: B.geo(s, d)
        .withColumns({"event_time": F.to_date("event_time"), "is_night": is_night("event_time")})
        .drop("geohash_4", "geohash_5", "geohash_6"),
        """select client_id, cast(event_time as date) as event_time,
           case when hour(event_time) >= 18 or hour(event_time) < 6 then 1 else 0 end as is_night from geo""",
    ),
    Query(
        "b3_indicator",
        "client_id:i mon:d any_purchase:i bought_1:i",
        lambda s, d: B.purchase(s, d).withColumns(
            {"any_purchase": any_flag(list(FLAGS.values())), "bought_1": any_flag(["target_1"])}
        ),
        f"select client_id, mon, {ANY} as any_purchase, case when target_1 > 0 then 1 else 0 end as bought_1 from purchase",
    ),
    Query(
        "b4_bucket",
        "id_currency:i n:i",
        lambda s, d: B.trx(s, d).groupBy(R.top_code("currency", B.CURRENCIES).alias("id_currency")).agg(F.count("*").alias("n")),
        "select case when currency in (1, 2, 3) then currency else 0 end as id_currency, count(*) as n from trx group by 1",
    ),
    Query(
        "b5_null_tests",
        "no_currency:i with_dst:i",
        lambda s, d: B.trx(s, d).agg(
            F.count_if(F.col("currency").isNull()).alias("no_currency"),
            F.count_if(F.col("dst_type11").isNotNull()).alias("with_dst"),
        ),
        "select count(*) - count(currency) as no_currency, count(dst_type11) as with_dst from trx",
    ),
    Query(
        "b6_sql_predicate",
        "client_id:i mon:d",
        lambda s, d: B.purchase(s, d).filter("target_1 = 1 and mon is not null"),
        "select client_id, mon from purchase where target_1 = 1 and mon is not null",
    ),
    Query(
        "b7_pick_columns",
        "client_id:i mon:d trans_count:i diff_trans_date:i target_4:i",
        lambda s, d: M.pick_columns(B.purchase(s, d), KEY, ["trans_count", "diff_trans_date"], "target_4"),
        "select client_id, mon, trans_count, diff_trans_date, target_4 from purchase",
    ),
    Query(
        "b8_latest",
        "client_id:i mon:d trans_count:i",
        lambda s, d: latest(B.purchase(s, d)),
        "select client_id, mon, trans_count from purchase where mon = (select max(mon) from purchase)",
    ),
    Query(
        "b9_observable",
        "client_id:i mon:d",
        lambda s, d: observable(B.purchase(s, d), 4),
        "select client_id, mon from purchase where mon <= (select max(mon) - interval 4 month from purchase)",
    ),
    Query(
        "b10_temporal_split",
        "split:s mon:d n:i",
        lambda s, d: (
            lambda parts: parts[0].withColumn("split", F.lit("train")).unionByName(parts[1].withColumn("split", F.lit("test")))
        )(M.temporal_split(B.purchase(s, d))).groupBy("split", "mon").agg(F.count("*").alias("n")),
        f"select case when mon <= {SPLIT_START} then 'train' else 'test' end as split, mon, count(*) as n from purchase group by 1, 2",
    ),
    Query(
        "b11_positive",
        "mon:d client_id:s product_id:i name_product:s prob:f",
        lambda s, d: RC.positive_predictions(B.predictions(s, d)),
        "select * from positives",
    ),
    Query(
        "b12_class_partition",
        "class:i n:i trans:i",
        lambda s, d: (
            lambda both: both[0].withColumn("class", F.lit(0)).unionByName(both[1].withColumn("class", F.lit(1)))
        )(by_class(B.purchase(s, d).withColumn("any", any_flag(list(FLAGS.values()))), "any"))
        .groupBy("class")
        .agg(F.count("*").alias("n"), F.sum("trans_count").alias("trans")),
        f"select {ANY} as class, count(*) as n, sum(trans_count) as trans from purchase group by 1",
    ),
    # C --------------------------------------------------------------------------------------------------------------
    Query(
        "c2_feature_assembly",
        "client_id:i mon:d n:i event_entropy:f dst_entropy:f",
        lambda s, d: (
            lambda t: M.join_features(
                t.groupBy(*KEY).agg(F.count("*").alias("n")),
                R.category_profile(t, KEY, {"event": "event_type"}).select(*KEY, "event_entropy"),
                R.category_profile(t, KEY, {"dst": "dst_type11"}).select(*KEY, "dst_entropy"),
            )
        )(B.trx(s, d).withColumn("mon", period_start("event_time"))),
        """select b.client_id, b.mon, b.n, e.h as event_entropy, x.h as dst_entropy
           from (select client_id, mon, count(*) as n from trx group by 1, 2) b
           left join (select client_id, mon, -sum(p * ln(p)) as h from (select client_id, mon, count(*) / sum(count(*)) over
                      (partition by client_id, mon) as p from trx group by client_id, mon, event_type) group by 1, 2) e
             on b.client_id = e.client_id and b.mon = e.mon
           left join (select client_id, mon, -sum(p * ln(p)) as h from (select client_id, mon, count(*) / sum(count(*)) over
                      (partition by client_id, mon) as p from trx group by client_id, mon, dst_type11) group by 1, 2) x
             on b.client_id = x.client_id and b.mon = x.mon""",
    ),
    Query(
        "c3_sampled_population",
        "client_id:i mon:d trans_count:i",
        lambda s, d: B.purchase(s, d).join(B.purchase(s, d).filter("target_1 = 1").select(*KEY), KEY, "left_semi"),
        "select client_id, mon, trans_count from purchase where target_1 = 1",
    ),
    Query(
        "c4_pairs_in_row",
        "client_id:i mon:d p1:s p2:s",
        lambda s, d: P.product_pairs(P.products_ahead(B.purchase(s, d), "client_id", "mon", FLAGS), KEY),
        f"""with a as (select client_id, mon, unnest(['product_1', 'product_2', 'product_3', 'product_4']) as p,
                unnest([max(target_1) over w, max(target_2) over w, max(target_3) over w, max(target_4) over w]) as f
              from purchase window w as (partition by client_id order by mon rows between current row and 4 following))
            select x.client_id, x.mon, x.p as p1, y.p as p2 from a x join a y on x.client_id = y.client_id and x.mon = y.mon
            where x.f = 1 and y.f = 1 and x.p < y.p""",
    ),
    Query(
        "c5_group_totals",
        "p1:s p2:s n:i tot_p1:i tot_p2:i",
        lambda s, d: P.conditional_probs(_cooc(s, d)),
        """select p1, p2, n, sum(n) over (partition by p1) as tot_p1, sum(n) over (partition by p2) as tot_p2 from (@cooc)""",
    ),
    Query(
        "c6_latest_join",
        "client_id:i mon:d target_1:i target_3:i target_4:i",
        lambda s, d: latest(B.purchase(s, d)).select(*KEY, *[f"target_{k}" for k in B.PRODUCTS]),
        """select p.client_id, p.mon, target_1, target_3, target_4 from purchase p
           join (select max(mon) as mon from purchase) m on p.mon = m.mon""",
    ),
    Query(
        "c7_cluster_share",
        "id:i model:s pct:f",
        lambda s, d: (
            lambda sc: sc.join(R.share_of_total(sc, ["model"], {"n": F.count("*")}).withColumnRenamed("pct_n", "pct"), "model", "left")
        )(B.scores(s, d)),
        """select id, s.model, pct from scores s left join (select model, count(*) / sum(count(*)) over () as pct from scores
           group by 1) c on s.model = c.model""",
    ),
    Query(
        "c8_grid",
        "product:s diff_months:f n:i",
        lambda s, d: P.gap_distribution(_gaps(s, d)),
        "select product, g as diff_months, n from (@gapgrid)",
    ),
    Query(
        "c9_portfolio_join",
        "client_id:s product_id:i chat_id:i prob:f",
        lambda s, d: RC.in_portfolio(RC.positive_predictions(B.predictions(s, d)), B.portfolio(s, d), 7),
        """select p.client_id, product_id, chat_id, prob from positives p join portfolio f on p.client_id = f.client_id
           where chat_id = 7""",
    ),
    Query(
        "c10_scope_split",
        "update_id:i client_id:s inside:i",
        lambda s, d: (
            lambda asked, owned: asked.join(owned, KEYS_OWNED, "left_semi")
            .withColumn("inside", F.lit(1))
            .unionByName(asked.join(owned, KEYS_OWNED, "left_anti").withColumn("inside", F.lit(0)))
        )(
            RC.requested(B.requests(s, d)).select("update_id", "chat_id", F.explode("asked").alias("client_id")),
            RC.owners(B.portfolio(s, d)),
        ),
        """select a.update_id, a.client_id, case when p.client_id is null then 0 else 1 end as inside
           from (@asked) a left join portfolio p on a.client_id = p.client_id and a.chat_id = p.chat_id""",
    ),
    Query(
        "c11_first_last",
        "client_id:i mon:d dialog_drift_m:f",
        lambda s, d: FT.first_last_drift(FT.dialog_months(B.dialog(s, d))),
        """select client_id, mon, sqrt(list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))
             as dialog_drift_m
           from (select client_id, mon, arg_min(embedding, event_time) as a, arg_max(embedding, event_time) as b
                 from dialog group by 1, 2)""",
    ),
    # D --------------------------------------------------------------------------------------------------------------
    Query(
        "d1_activity",
        "client_id:i mon:d days:i n:i types:i currencies:i src:i dst:i",
        lambda s, d: R.period_rollup(
            B.trx(s, d),
            "client_id",
            "event_time",
            {
                "n": F.count("*"),
                **R.distinct_counts(
                    {
                        "days": F.to_date("event_time"),
                        "types": "event_type",
                        "currencies": "currency",
                        "src": "src_type11",
                        "dst": "dst_type11",
                    }
                ),
            },
        ),
        """select client_id, mon, count(distinct cast(event_time as date)) as days, count(*) as n,
           count(distinct event_type) as types, count(distinct currency) as currencies, count(distinct src_type11) as src,
           count(distinct dst_type11) as dst from trx group by 1, 2""",
    ),
    Query(
        "d2_conditional",
        "client_id:i mon:d cnt_1:i cnt_2:i sum_1:f4 sum_2:f4 avg_1:f4 std_1:f4",
        lambda s, d: R.period_rollup(
            B.trx(s, d),
            "client_id",
            "event_time",
            {
                **{f"cnt_{c}": v for c, v in R.by_code("currency", [1, 2], F.lit(1), F.sum, 0).items()},
                **{f"sum_{c}": v for c, v in R.by_code("currency", [1, 2], "amount", F.sum, 0.0).items()},
                "avg_1": R.by_code("currency", [1], "amount", F.avg)[1],
                "std_1": R.by_code("currency", [1], "amount", F.stddev)[1],
            },
        ),
        """select client_id, mon, count(*) filter (currency = 1) as cnt_1, count(*) filter (currency = 2) as cnt_2,
           coalesce(sum(amount) filter (currency = 1), 0) as sum_1, coalesce(sum(amount) filter (currency = 2), 0) as sum_2,
           avg(amount) filter (currency = 1) as avg_1, stddev_samp(amount) filter (currency = 1) as std_1 from trx group by 1, 2""",
    ),
    Query(
        "d3_geo_rollup",
        "client_id:i mon:d pings:i days:i day_n:i night_n:i g4:i g5:i g6:i",
        lambda s, d: FT.geo_rollup(B.geo(s, d), "week").select(
            *KEY,
            F.col("geo_ping_cnt_m").alias("pings"),
            F.col("geo_days_active_m").alias("days"),
            F.col("geo_day_cnt_m").alias("day_n"),
            F.col("geo_night_cnt_m").alias("night_n"),
            *[F.col(f"geo_geohash_{p}_cnt_m").alias(f"g{p}") for p in (4, 5, 6)],
        ),
        """select client_id, mon, count(*) as pings, count(distinct day) as days,
           count(*) filter (hour(event_time) between 6 and 17) as day_n,
           count(*) filter (hour(event_time) not between 6 and 17) as night_n, count(distinct geohash_4) as g4,
           count(distinct geohash_5) as g5, count(distinct geohash_6) as g6 from geo group by 1, 2""",
    ),
    Query(
        "d4_dialog_rollup",
        "client_id:i mon:d n:i days:i",
        lambda s, d: R.period_rollup(
            B.dialog(s, d), "client_id", "event_time", {"n": F.count("*"), "days": F.count_distinct("event_time")}
        ),
        "select client_id, mon, count(*) as n, count(distinct event_time) as days from dialog group by 1, 2",
    ),
    Query(
        "d5_score_summary",
        "client_id:i mon:d norm_mean_m:f norm_std_m:f norm_median_m:f",
        lambda s, d: FT.score_summary(FT.dialog_months(B.dialog(s, d)), "v_norm", "norm"),
        """select client_id, mon, avg(v) as norm_mean_m, stddev_samp(v) as norm_std_m, median(v) as norm_median_m
           from (select client_id, mon, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) as v from dialog) group by 1, 2""",
    ),
    Query(
        "d6_share_of_total",
        "currency:i n:i amount:f2 pct_n:f pct_amount:f",
        lambda s, d: R.share_of_total(B.trx(s, d), ["currency"], {"n": F.count("*"), "amount": F.sum("amount")}),
        """select currency, count(*) as n, sum(amount) as amount, count(*) / sum(count(*)) over () as pct_n,
           sum(amount) / sum(sum(amount)) over () as pct_amount from trx group by 1""",
    ),
    Query(
        "d7_distinct",
        "clients:i types:i subtypes:i currencies:i",
        lambda s, d: B.trx(s, d).agg(
            *[
                c.alias(n)
                for n, c in R.distinct_counts(
                    {"clients": "client_id", "types": "event_type", "subtypes": "event_subtype", "currencies": "currency"}
                ).items()
            ]
        ),
        """select count(distinct client_id) as clients, count(distinct event_type) as types,
           count(distinct event_subtype) as subtypes, count(distinct currency) as currencies from trx""",
    ),
    Query(
        "d8_frequency",
        "event_type:s event_subtype:s n:i",
        lambda s, d: R.frequency(B.trx(s, d), ["event_type", "event_subtype"]),
        "select event_type, event_subtype, count(*) as n from trx group by 1, 2 order by 1, 2",
    ),
    Query(
        "d9_having",
        "client_id:i target_1:i target_2:i target_3:i target_4:i",
        lambda s, d: R.having(B.purchase(s, d), ["client_id"], list(FLAGS.values())),
        """select client_id, sum(target_1) as target_1, sum(target_2) as target_2, sum(target_3) as target_3,
           sum(target_4) as target_4 from purchase group by 1
           having sum(target_1) > 1 or sum(target_2) > 1 or sum(target_3) > 1 or sum(target_4) > 1""",
    ),
    Query("d10_cooccurrence", "p1:s p2:s n:i", lambda s, d: _cooc(s, d), "select * from (@cooc)"),
    Query(
        "d11_conditional_probs",
        "p1:s p2:s n:i p2_given_p1:f p1_given_p2:f",
        lambda s, d: P.conditional_probs(_cooc(s, d)),
        """select p1, p2, n, n / sum(n) over (partition by p1) as p2_given_p1, n / sum(n) over (partition by p2) as p1_given_p2
           from (@cooc)""",
    ),
    Query(
        "d12_symmetric_pivot",
        "p1:s product_1:i product_2:i product_3:i product_4:i",
        lambda s, d: P.pivot_symmetric(_cooc(s, d), list(FLAGS)),
        """select p1, coalesce(sum(n) filter (p2 = 'product_1'), 0) as product_1,
           coalesce(sum(n) filter (p2 = 'product_2'), 0) as product_2, coalesce(sum(n) filter (p2 = 'product_3'), 0) as product_3,
           coalesce(sum(n) filter (p2 = 'product_4'), 0) as product_4
           from (select p1, p2, n from (@cooc) union all select p2, p1, n from (@cooc)) group by 1""",
    ),
    Query(
        "d13_transitions",
        "p_i:s p_j:s n:i",
        lambda s, d: P.transitions(P.products_ahead(B.purchase(s, d), "client_id", "mon", FLAGS), FLAGS),
        f"""with a as (select client_id, mon, target_1, target_2, target_3, target_4, max(target_1) over w as n1,
              max(target_2) over w as n2, max(target_3) over w as n3, max(target_4) over w as n4 from purchase
              window w as (partition by client_id order by mon rows between current row and 4 following))
            select 'product_' || i as p_i, 'product_' || j as p_j, count(*) as n
            from a, (select unnest([1, 2, 3, 4]) as i), (select unnest([1, 2, 3, 4]) as j)
            where i <> j and [target_1, target_2, target_3, target_4][i] = 1 and [n1, n2, n3, n4][j] = 1 group by 1, 2""",
    ),
    Query(
        "d14_entropy",
        "client_id:i mon:d event_entropy:f dst_entropy:f",
        lambda s, d: R.category_profile(
            B.trx(s, d).withColumn("mon", period_start("event_time")), KEY, {"event": "event_type", "dst": "dst_type11"}
        ),
        """select client_id, mon, max(h) filter (c = 'e') as event_entropy, max(h) filter (c = 'd') as dst_entropy from (
           select c, client_id, mon, -sum(p * ln(p)) as h from (
             select c, client_id, mon, count(*) / sum(count(*)) over (partition by c, client_id, mon) as p from (
               select 'e' as c, client_id, mon, event_type as v from trx
               union all select 'd', client_id, mon, dst_type11 from trx) group by c, client_id, mon, v)
           group by 1, 2, 3) group by 1, 2""",
    ),
    Query(
        "d15_mode",
        "client_id:i mon:d event_mode:s currency_mode:i dst_mode:s",
        lambda s, d: R.category_profile(
            B.trx(s, d).withColumn("mon", period_start("event_time")),
            KEY,
            {"event": "event_type", "currency": "currency", "dst": "dst_type11"},
        ),
        """select client_id, mon, max(v) filter (c = 'e' and r = 1) as event_mode,
           cast(max(v) filter (c = 'c' and r = 1) as int) as currency_mode, max(v) filter (c = 'd' and r = 1) as dst_mode from (
             select c, client_id, mon, v, row_number() over (partition by c, client_id, mon order by count(*) desc, v asc nulls first) as r
             from (select 'e' as c, client_id, mon, event_type as v from trx
                   union all select 'c', client_id, mon, cast(currency as varchar) from trx
                   union all select 'd', client_id, mon, dst_type11 from trx) group by c, client_id, mon, v) group by 1, 2""",
    ),
    Query(
        "d16_gap_distribution",
        "product:s diff_months:f n:i percent:f cum_percent:f",
        lambda s, d: P.gap_distribution(_gaps(s, d)),
        """select product, g as diff_months, n, 100.0 * n / sum(n) over (partition by product) as percent,
           least(100.0 * sum(n) over (partition by product order by g) / sum(n) over (partition by product), 100.0) as cum_percent
           from (@gapgrid)""",
    ),
    Query(
        "d17_box_plot",
        "any_purchase:i q0:f q1:f q2:f q3:f q4:f",
        lambda s, d: exact_quantiles(
            B.purchase(s, d).withColumn("any_purchase", any_flag(list(FLAGS.values()))),
            ["any_purchase"],
            "diff_trans_date",
            {f"q{i}": i / 4 for i in range(5)},
        ),
        f"""select any_purchase, quantile_cont(x, 0.0) as q0, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as q2,
           quantile_cont(x, 0.75) as q3, quantile_cont(x, 1.0) as q4
           from (select {ANY} as any_purchase, cast(diff_trans_date as double) as x from purchase) group by 1""",
    ),
    Query(
        "d18_describe",
        "mon:d x_count:i x_mean:f x_std:f x_min:f x_q1:f x_q2:f x_q3:f x_max:f",
        lambda s, d: R.describe_by(
            B.purchase(s, d).groupBy("mon", "client_id").agg(F.sum("trans_count").cast("double").alias("x")), ["mon"], ["x"]
        ),
        """select mon, count(x) as x_count, avg(x) as x_mean, stddev_samp(x) as x_std, min(x) as x_min,
           quantile_cont(x, 0.25) as x_q1, quantile_cont(x, 0.5) as x_q2, quantile_cont(x, 0.75) as x_q3, max(x) as x_max
           from (select mon, cast(trans_count as double) as x from purchase) group by 1""",
    ),
    Query(
        "d19_cluster_sizes",
        "model:s n:i pct_n:f",
        lambda s, d: R.share_of_total(B.scores(s, d), ["model"], {"n": F.count("*")}),
        "select model, count(*) as n, count(*) / sum(count(*)) over () as pct_n from scores group by 1",
    ),
    Query(
        "d20_distinct_per_column",
        "feature:s n:i",
        lambda s, d: R.column_counts(B.feat(s, d), ["f_qty", "f_disc", "f_const", "c_flag", "c_stat"]),
        """select 'f_qty' as feature, count(distinct f_qty) as n from feat union all select 'f_disc', count(distinct f_disc) from feat
           union all select 'f_const', count(distinct f_const) from feat union all select 'c_flag', count(distinct c_flag) from feat
           union all select 'c_stat', count(distinct c_stat) from feat""",
    ),
    Query(
        "d21_nulls_per_column",
        "feature:s n:i",
        lambda s, d: R.column_counts(B.feat(s, d), ["f_qty", "f_disc", "c_flag"], "null"),
        """select 'f_qty' as feature, count(*) - count(f_qty) as n from feat union all select 'f_disc', count(*) - count(f_disc)
           from feat union all select 'c_flag', count(*) - count(c_flag) from feat""",
    ),
    # E --------------------------------------------------------------------------------------------------------------
    Query(
        "e1_purchase_gap",
        "product:s client_id:i mon:d diff_months:f",
        lambda s, d: _gaps(s, d),
        "select product, client_id, mon, diff_months from (@gaps)",
    ),
    Query(
        "e2_lookahead",
        "client_id:i mon:d next_product_1:i next_product_2:i next_product_3:i next_product_4:i number_prods:i",
        lambda s, d: P.products_ahead(B.purchase(s, d), "client_id", "mon", FLAGS),
        """select client_id, mon, max(target_1) over w as next_product_1, max(target_2) over w as next_product_2,
           max(target_3) over w as next_product_3, max(target_4) over w as next_product_4,
           max(target_1) over w + max(target_2) over w + max(target_3) over w + max(target_4) over w as number_prods
           from purchase window w as (partition by client_id order by mon rows between current row and 4 following)""",
    ),
    Query(
        "e3_trailing",
        "client_id:i mon:d a3:f s6:f lo:i hi:i",
        lambda s, d: B.purchase(s, d).withColumns(
            {
                "a3": H.trailing(SPAN(), "trans_count", "avg", 3),
                "s6": H.trailing(SPAN(), "trans_count", "std", 6),
                "lo": H.trailing(SPAN(), "diff_trans_date", "min", 6),
                "hi": H.trailing(SPAN(), "diff_trans_date", "max", 6),
            }
        ),
        f"""select client_id, mon, avg(trans_count) {OVER} rows 2 preceding) as a3,
           stddev_samp(trans_count) {OVER} rows 5 preceding) as s6, min(diff_trans_date) {OVER} rows 5 preceding) as lo,
           max(diff_trans_date) {OVER} rows 5 preceding) as hi from purchase""",
    ),
    Query(
        "e4_running_total",
        "client_id:i mon:d r1:i r4:i",
        lambda s, d: B.purchase(s, d).withColumns(
            {"r1": H.running_sum(SPAN(), "target_1"), "r4": H.running_sum(SPAN(), "target_4")}
        ),
        f"""select client_id, mon, sum(target_1) {OVER} rows unbounded preceding) as r1,
           sum(target_4) {OVER} rows unbounded preceding) as r4 from purchase""",
    ),
    Query(
        "e5_rate_of_change",
        "client_id:i mon:d r1:f r3:f r6:f r12:f",
        lambda s, d: R.period_rollup(B.trx(s, d), "client_id", "event_time", {"n": F.count("*")}).withColumns(
            {f"r{k}": H.change_over(SPAN(), "n", k) for k in (1, 3, 6, 12)}
        ),
        f"""select client_id, mon, n / nullif(lag(n, 1) {OVER}), 0) - 1 as r1, n / nullif(lag(n, 3) {OVER}), 0) - 1 as r3,
           n / nullif(lag(n, 6) {OVER}), 0) - 1 as r6, n / nullif(lag(n, 12) {OVER}), 0) - 1 as r12
           from (select client_id, mon, count(*) as n from trx group by 1, 2)""",
    ),
    Query(
        "e6_growth_streak",
        "client_id:i mon:d streak:i",
        lambda s, d: H.growth_streak(
            R.period_rollup(B.trx(s, d), "client_id", "event_time", {"n": F.count("*")}), "client_id", "mon", "n", "streak"
        ),
        f"""select client_id, mon, case when sum(g) {OVER} rows 2 preceding) = 3 then 1 else 0 end as streak from (
             select client_id, mon, case when n > lag(n) {OVER}) then 1 else 0 end as g
             from (select client_id, mon, count(*) as n from trx group by 1, 2))""",
    ),
    Query(
        "e7_recency",
        "client_id:i mon:d recency:f",
        lambda s, d: B.purchase(s, d)
        .withColumn("any", any_flag(list(FLAGS.values())))
        .withColumn("recency", H.recency(SPAN(), "any", "mon")),
        f"""select client_id, mon, date_diff('month', last_value(m ignore nulls) {OVER} rows between unbounded preceding and
           1 preceding), mon) as recency from (select client_id, mon, case when {ANY} > 0 then mon end as m from purchase)""",
    ),
    Query(
        "e8_ranking",
        "client_id:i mon:d event_type:s place:i",
        lambda s, d: B.trx(s, d)
        .groupBy("client_id", period_start("event_time").alias("mon"), "event_type")
        .agg(F.count("*").alias("n"))
        .withColumn("place", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("n"), "event_type"))),
        """select client_id, mon, event_type, row_number() over (partition by client_id, mon order by count(*) desc, event_type
           nulls first) as place from trx group by client_id, mon, event_type""",
    ),
    Query(
        "e9_first_last",
        "client_id:i mon:d first_x:f last_x:f",
        lambda s, d: FT.dialog_months(B.dialog(s, d))
        .groupBy(*KEY)
        .agg(*FT.drift_aggs())
        .select(*KEY, F.get("first_emb", F.lit(0)).alias("first_x"), F.get("last_emb", F.lit(0)).alias("last_x")),
        """select client_id, mon, arg_min(embedding[1], event_time) as first_x, arg_max(embedding[1], event_time) as last_x
           from dialog group by 1, 2""",
    ),
    Query(
        "e10_proportion",
        "client_id:i mon:d event_type:s prop:f",
        lambda s, d: B.trx(s, d)
        .groupBy("client_id", period_start("event_time").alias("mon"), "event_type")
        .agg(F.count("*").alias("n"))
        .withColumn("prop", F.try_divide("n", F.sum("n").over(W.partitionBy(*KEY)))),
        """select client_id, mon, event_type, count(*) / sum(count(*)) over (partition by client_id, mon) as prop from trx
           group by client_id, mon, event_type""",
    ),
    Query(
        "e11_previous_vector",
        "client_id:i event_time:s x:f before:f",
        lambda s, d: previous_row(
            FT.dialog_months(B.dialog(s, d)), KEY, ["event_time", "tie"], ["embedding", "v_norm"], "prev"
        ).select(
            "client_id",
            F.date_format("event_time", "yyyy-MM-dd HH:mm").alias("event_time"),
            F.get("embedding", F.lit(0)).alias("x"),
            F.get("prev.embedding", F.lit(0)).alias("before"),
        ),
        """select client_id, strftime(event_time, '%Y-%m-%d %H:%M') as event_time, embedding[1] as x,
           lag(embedding[1]) over (partition by client_id, mon order by event_time) as before from dialog""",
    ),
    Query(
        "e12_since_previous",
        "client_id:i mon:d gap:f",
        lambda s, d: B.purchase(s, d).withColumn("gap", H.since_previous(SPAN(), "mon")),
        f"select client_id, mon, date_diff('month', lag(mon) {OVER}), mon) as gap from purchase",
    ),
    Query(
        "e13_trailing_count",
        "client_id:i mon:d s3:i s6:i",
        lambda s, d: B.purchase(s, d)
        .withColumn("any", any_flag(list(FLAGS.values())))
        .withColumns({"s3": H.trailing(SPAN(), "any", "sum", 4), "s6": H.trailing(SPAN(), "any", "sum", 6)}),
        f"""select client_id, mon, sum({ANY}) {OVER} rows 3 preceding) as s3, sum({ANY}) {OVER} rows 5 preceding) as s6
            from purchase""",
    ),
    Query(
        "e14_quota",
        "client_id:i mon:d stratum:i",
        lambda s, d: (
            lambda p: pick_quota(
                p,
                p.groupBy("stratum").agg(F.round(F.count("*") * 0.3).cast("long").alias("quota")),
                "stratum",
                KEY,
                42,
            )
        )(B.purchase(s, d).withColumn("stratum", F.col("client_id") % 3)),
        """select client_id, mon, stratum from (
             select client_id, mon, client_id % 3 as stratum,
               row_number() over (partition by client_id % 3 order by md5(client_id || '|' || strftime(mon, '%Y-%m-%d') || '|42')) as r,
               round(count(*) over (partition by client_id % 3) * 0.3) as quota from purchase) where r <= quota""",
    ),
    Query(
        "e15_cumulative_percent",
        "product:s diff_months:f cum_percent:f",
        lambda s, d: P.gap_distribution(_gaps(s, d)),
        """select product, g as diff_months, least(100.0 * sum(n) over (partition by product order by g) /
           sum(n) over (partition by product), 100.0) as cum_percent from (@gapgrid)""",
    ),
    # F, G -----------------------------------------------------------------------------------------------------------
    Query(
        "f1_order_by",
        "client_id:i n:i",
        lambda s, d: B.purchase(s, d).groupBy("client_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "client_id"),
        "select client_id, count(*) as n from purchase group by 1 order by 2 desc, 1",
    ),
    Query(
        "f2_order_in_group",
        "client_id:s products:s",
        lambda s, d: RC.positive_predictions(B.predictions(s, d))
        .groupBy("client_id")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("prob")).alias("p"), "product_id"))).alias("e"))
        .select("client_id", F.array_join(F.transform("e", lambda x: x["product_id"].cast("string")), ",").alias("products")),
        "select client_id, string_agg(product_id, ',' order by prob desc, product_id) as products from positives group by 1",
    ),
    Query(
        "g1_union",
        "class:i n:i",
        lambda s, d: (
            lambda p: p.filter("target_1 = 1")
            .withColumn("class", F.lit(1))
            .unionByName(p.filter("target_1 = 0").withColumn("class", F.lit(0)))
        )(B.purchase(s, d)).groupBy("class").agg(F.count("*").alias("n")),
        "select target_1 as class, count(*) as n from purchase group by 1",
    ),
    Query(
        "g2_product_frames",
        "product:s client_id:i mon:d",
        lambda s, d: B.purchase(s, d)
        .select(*KEY, *[F.col(c).alias(p) for p, c in FLAGS.items()])
        .unpivot(KEY, list(FLAGS), "product", "flag")
        .filter("flag = 1"),
        """select 'product_1' as product, client_id, mon from purchase where target_1 = 1 union all
           select 'product_2', client_id, mon from purchase where target_2 = 1 union all
           select 'product_3', client_id, mon from purchase where target_3 = 1 union all
           select 'product_4', client_id, mon from purchase where target_4 = 1""",
    ),
    Query(
        "g5_distinct",
        "mon:d",
        lambda s, d: B.purchase(s, d).select("mon").distinct(),
        "select distinct mon from purchase",
    ),
    # H --------------------------------------------------------------------------------------------------------------
    Query(
        "h1_period_start",
        "client_id:i month:d week:d",
        lambda s, d: B.raw(s, d, "events").select(
            F.col("user_id").alias("client_id"),
            period_start("ts").alias("month"),
            period_start("ts", "week").alias("week"),
        ),
        "select user_id as client_id, date_trunc('month', ts) as month, date_trunc('week', ts) as week from events",
    ),
    Query(
        "h2_add_months",
        "client_id:i mon:d next:d back:d",
        lambda s, d: B.purchase(s, d).select(
            *KEY, shift_months("mon", 1).alias("next"), shift_months("mon", -4).alias("back")
        ),
        "select client_id, mon, mon + interval 1 month as next, mon - interval 4 month as back from purchase",
    ),
    Query(
        "h3_month_gap",
        "client_id:i gap:f",
        lambda s, d: B.purchase(s, d).groupBy("client_id").agg(month_gap(F.max("mon"), F.min("mon")).alias("gap")),
        "select client_id, date_diff('month', min(mon), max(mon)) as gap from purchase group by 1",
    ),
    Query(
        "h4_day_night",
        "event_id:i night:i day:i",
        lambda s, d: B.raw(s, d, "events").select("event_id", is_night("ts").alias("night"), is_day("ts").alias("day")),
        """select event_id, case when hour(ts) >= 18 or hour(ts) < 6 then 1 else 0 end as night,
           case when hour(ts) >= 6 and hour(ts) < 18 then 1 else 0 end as day from events""",
    ),
    Query(
        "h5_math",
        "o_orderkey:i ln_price:f root:f signed:f shares:f",
        lambda s, d: B.raw(s, d, "orders").select(
            "o_orderkey",
            F.ln("o_totalprice").alias("ln_price"),
            F.sqrt("o_totalprice").alias("root"),
            signed_log(F.col("o_totalprice") - 250000).alias("signed"),
            F.try_divide("o_totalprice", (F.col("o_orderkey") % 3).cast("double")).alias("shares"),
        ),
        """select o_orderkey, ln(o_totalprice) as ln_price, sqrt(o_totalprice) as root,
           sign(o_totalprice - 250000) * ln(1 + abs(o_totalprice - 250000)) as signed,
           o_totalprice / nullif(o_orderkey % 3, 0) as shares from orders""",
    ),
    Query(
        "h6_split",
        "p_i:s p_j:s n:i",
        lambda s, d: B.trx(s, d)
        .select(F.concat_ws("|", "event_type", "event_subtype").alias("pair"))
        .select(*[c.alias(n) for n, c in zip(("p_i", "p_j"), split_pair("pair"))])
        .groupBy("p_i", "p_j")
        .agg(F.count("*").alias("n")),
        "select event_type as p_i, event_subtype as p_j, count(*) as n from trx group by 1, 2",
    ),
    Query(
        "h7_normal_id",
        "c_custkey:i id:s",
        lambda s, d: B.raw(s, d, "customer").select(
            "c_custkey", normal_id(F.concat(F.lit("  "), F.upper("c_name"), F.lit(" "))).alias("id")
        ),
        "select c_custkey, lower(trim('  ' || upper(c_name) || ' ')) as id from customer",
    ),
    Query(
        "h8_ids_in_text",
        "update_id:i ids:s",
        lambda s, d: B.requests(s, d).select("update_id", F.array_join(ids_in_text("text"), ",").alias("ids")),
        """select update_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')),
           '[0-9a-f]{16,}'))), ',') as ids from requests""",
    ),
    Query(
        "h9_format",
        "client_id:s line:s",
        lambda s, d: RC.positive_predictions(B.predictions(s, d)).select(
            "client_id", F.concat_ws(" — Prob ", "name_product", percent_text("prob")).alias("line")
        ),
        """select client_id, name_product || ' — Prob ' || cast(cast(round_even(prob * 100, 0) as int) as varchar) || '%' as line
           from positives""",
    ),
    Query(
        "h10_array_build",
        "client_id:i mon:d prods:s n:i",
        lambda s, d: B.purchase(s, d)
        .withColumn("a", F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(p)) for p, c in FLAGS.items()])))
        .select(*KEY, F.array_join("a", ",").alias("prods"), F.size("a").alias("n")),
        """select client_id, mon, array_to_string(a, ',') as prods, len(a) as n from (select client_id, mon, list_filter(
           [case when target_1 = 1 then 'product_1' end, case when target_2 = 1 then 'product_2' end,
            case when target_3 = 1 then 'product_3' end, case when target_4 = 1 then 'product_4' end],
           lambda x: x is not null) as a from purchase)""",
    ),
    Query(
        "h11_explode",
        "client_id:i mon:d pos:i flag:i",
        lambda s, d: B.purchase(s, d).select(*KEY, F.posexplode(F.array(*FLAGS.values())).alias("pos", "flag")),
        """select client_id, mon, unnest([0, 1, 2, 3]) as pos, unnest([target_1, target_2, target_3, target_4]) as flag
           from purchase""",
    ),
    Query(
        "h12_array_fold",
        "vec_id:i s:f sq:f",
        lambda s, d: B.raw(s, d, "embeddings").select(
            "vec_id",
            total(F.transform("embedding", lambda x: x.cast("double"))).alias("s"),
            total(F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))).alias("sq"),
        ),
        """select vec_id, list_sum(list_transform(embedding, lambda x: cast(x as double))) as s,
           list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))) as sq from embeddings""",
    ),
    Query(
        "h13_array_zip",
        "client_id:i event_time:s first_gap:f",
        lambda s, d: B.dialog(s, d).select(
            "client_id",
            F.date_format("event_time", "yyyy-MM-dd HH:mm").alias("event_time"),
            F.get(subtract("embedding", F.reverse("embedding")), F.lit(0)).alias("first_gap"),
        ),
        """select client_id, strftime(event_time, '%Y-%m-%d %H:%M') as event_time, embedding[1] - embedding[-1] as first_gap
           from dialog""",
    ),
    Query(
        "h14_l2_norm",
        "client_id:i event_time:s norm:f",
        lambda s, d: B.dialog(s, d).select(
            "client_id", F.date_format("event_time", "yyyy-MM-dd HH:mm").alias("event_time"), l2_norm("embedding").alias("norm")
        ),
        """select client_id, strftime(event_time, '%Y-%m-%d %H:%M') as event_time,
           sqrt(list_sum(list_transform(embedding, lambda x: x * x))) as norm from dialog""",
    ),
    Query(
        "h15_euclidean",
        "client_id:i event_time:s dist:f",
        lambda s, d: B.dialog(s, d).select(
            "client_id",
            F.date_format("event_time", "yyyy-MM-dd HH:mm").alias("event_time"),
            euclidean("embedding", F.reverse("embedding")).alias("dist"),
        ),
        """select client_id, strftime(event_time, '%Y-%m-%d %H:%M') as event_time,
           list_distance(embedding, list_reverse(embedding)) as dist from dialog""",
    ),
    Query(
        "h16_cosine_distance",
        "client_id:i event_time:s dist:f",
        lambda s, d: B.dialog(s, d).select(
            "client_id",
            F.date_format("event_time", "yyyy-MM-dd HH:mm").alias("event_time"),
            cosine_distance("embedding", F.reverse("embedding")).alias("dist"),
        ),
        """select client_id, strftime(event_time, '%Y-%m-%d %H:%M') as event_time,
           1 - list_cosine_similarity(embedding, list_reverse(embedding)) as dist from dialog""",
    ),
    Query(
        "h17_null_default",
        "l_orderkey:i l_linenumber:i disc:f flag:s",
        lambda s, d: B.feat(s, d)
        .na.fill(0.0, ["f_disc"])
        .select("l_orderkey", "l_linenumber", F.col("f_disc").alias("disc"), F.coalesce("c_flag", F.lit("none")).alias("flag")),
        "select l_orderkey, l_linenumber, coalesce(f_disc, 0) as disc, coalesce(c_flag, 'none') as flag from feat",
    ),
    Query(
        "h18_cast",
        "o_orderkey:i whole:i word:s number:i",
        lambda s, d: B.raw(s, d, "orders").select(
            "o_orderkey",
            F.floor("o_totalprice").cast("int").alias("whole"),
            F.col("o_custkey").cast("string").alias("word"),
            F.col("o_orderstatus").try_cast("int").alias("number"),
        ),
        """select o_orderkey, cast(floor(o_totalprice) as int) as whole, cast(o_custkey as varchar) as word,
           try_cast(o_orderstatus as int) as number from orders""",
    ),
    Query(
        "h19_row_label",
        "rows:i labels:i",
        lambda s, d: B.purchase(s, d)
        .withColumn("label", F.monotonically_increasing_id())
        .agg(F.count("*").alias("rows"), F.count_distinct("label").alias("labels")),
        "select count(*) as rows, count(*) as labels from purchase",
    ),
    Query(
        "h20_hash_uniform",
        "client_id:i mon:d u:f",
        lambda s, d: B.purchase(s, d).withColumn("u", hash_uniform(42, *KEY)),
        """select client_id, mon, cast('0x' || substr(md5(client_id || '|' || strftime(mon, '%Y-%m-%d') || '|42'), 1, 12) as bigint)
           / 281474976710656.0 as u from purchase""",
    ),
    Query(
        "h21_reply_json",
        "update_id:i intents:s ids:s",
        lambda s, d: B.requests(s, d).select(
            "update_id",
            F.array_join(reply_intents("reply_json"), ",").alias("intents"),
            F.array_join(reply_ids("reply_json"), ",").alias("ids"),
        ),
        """select update_id, case update_id % 7 when 1 then 'razones,recs' when 3 then 'razones' when 4 then 'recs,razones'
             when 5 then 'razones' else 'recs' end as intents,
           case update_id % 7 when 4 then md5(cast(update_id % 1000 + 7 as varchar))
             when 5 then md5(cast(update_id % 1500 as varchar)) else '' end as ids from requests""",
    ),
]

KEYS_OWNED = ["client_id", "chat_id"]


def _cooc(spark, sf):
    return P.cooccurrence(P.product_pairs(P.products_ahead(B.purchase(spark, sf), "client_id", "mon", FLAGS), KEY))


def _gaps(spark, sf):
    flagged = B.purchase(spark, sf).withColumn("any", any_flag(list(FLAGS.values())))
    return H.purchase_gaps(flagged, "client_id", "mon", {**FLAGS, "any_product": "any"})


# Shared SQL fragments, put in place of @name.
FRAGMENTS = {
    "cooc": """select x.p as p1, y.p as p2, count(*) as n
      from (select client_id, mon, unnest([1, 2, 3, 4]) as i, 'product_' || unnest([1, 2, 3, 4]) as p,
              unnest([max(target_1) over w, max(target_2) over w, max(target_3) over w, max(target_4) over w]) as f from purchase
              window w as (partition by client_id order by mon rows between current row and 4 following)) x
      join (select client_id, mon, 'product_' || unnest([1, 2, 3, 4]) as p,
              unnest([max(target_1) over w, max(target_2) over w, max(target_3) over w, max(target_4) over w]) as f from purchase
              window w as (partition by client_id order by mon rows between current row and 4 following)) y
      on x.client_id = y.client_id and x.mon = y.mon and x.p < y.p where x.f = 1 and y.f = 1 group by 1, 2""",
    "gaps": f"""select product, client_id, mon, cast(date_diff('month', before, mon) as double) as diff_months from (
      select product, client_id, mon, lag(mon) over (partition by product, client_id order by mon) as before from (
        select 'product_1' as product, client_id, mon from purchase where target_1 = 1 union all
        select 'product_2', client_id, mon from purchase where target_2 = 1 union all
        select 'product_3', client_id, mon from purchase where target_3 = 1 union all
        select 'product_4', client_id, mon from purchase where target_4 = 1 union all
        select 'any_product', client_id, mon from purchase where {ANY} = 1)) where before is not null""",
    "asked": """select distinct update_id, chat_id, unnest(ids) as client_id from (select update_id, chat_id, list_concat(
        regexp_extract_all(lower(coalesce(text, '')), '[0-9a-f]{16,}'),
        case update_id % 7 when 4 then [md5(cast(update_id % 1000 + 7 as varchar))]
             when 5 then [md5(cast(update_id % 1500 as varchar))] else [] end) as ids from requests)""",
}
FRAGMENTS["gapgrid"] = f"""select p.product, g.g, coalesce(c.n, 0) as n
  from (select distinct product from ({FRAGMENTS['gaps']})) p
  cross join (select unnest(range(cast(min(diff_months) as bigint), cast(max(diff_months) as bigint) + 1)) as g from ({FRAGMENTS['gaps']})) g
  left join (select product, diff_months, count(*) as n from ({FRAGMENTS['gaps']}) group by 1, 2) c
  on c.product = p.product and c.diff_months = g.g"""


def _filled(query: Query) -> Query:
    body = query.body
    for name, text in FRAGMENTS.items():
        body = body.replace(f"@{name})", f"{text})") if body else body
    return Query(query.key, query.columns, query.build, body)


QUERIES = [_filled(q) for q in QUERIES]
