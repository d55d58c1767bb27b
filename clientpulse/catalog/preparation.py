"""Preprocessing stages (J)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from clientpulse.catalog.base import Query
from clientpulse.catalog.selection import IDS, NUMERIC, bins_sql, edges_sql
from clientpulse.prep import (
    CategoryImputer,
    ColumnPicker,
    NumericImputer,
    OutlierCapper,
    Scaler,
    SignedLog,
    WoeEncoder,
)
from clientpulse.prep.woe import merge_similar, rare_levels, woe
from clientpulse.sources import bindings as B

CAPPED = ["f_qty", "f_skew", "f_disc", "f_price"]


def _brands(s, d):
    return B.raw(s, d, "part").select("p_partkey", "p_brand", "p_retailprice", (F.col("p_size") > 25).cast("int").alias("target"))


def _brand_levels(s, d):
    return (
        _brands(s, d)
        .groupBy(F.lit("p_brand").alias("feature"), F.col("p_brand").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("bad"))
    )


def _pooled_members(s, d):
    """Level, its share pool and the pool's size."""
    pooled = rare_levels(_brand_levels(s, d), 0.05)
    sizes = pooled.groupBy("feature", "slot").agg(F.sum("n").alias("pool_n"))
    return pooled.filter("slot is not null").join(sizes, ["feature", "slot"]).select("value", "slot", "pool_n")


def _merged(s, d):
    """Nations by customer segment: groups of levels with similar WoE."""
    rows = (
        B.raw(s, d, "customer")
        .groupBy("c_mktsegment")
        .agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("c_acctbal") > 4500).cast("int")).alias("bad"))
        .collect()
    )
    good, bad = sum(r["n"] - r["bad"] for r in rows), sum(r["bad"] for r in rows)
    groups = merge_similar({r["c_mktsegment"]: woe(r["n"] - r["bad"], r["bad"], good, bad) for r in rows}, 0.1)
    return s.createDataFrame([(v, i) for i, g in enumerate(groups) for v in g], "level string, grp int")


def _encoded(s, d, **settings):
    f = B.feat(s, d)
    return WoeEncoder(targetCol="target", **settings).fit(f).transform(f)


# Recursive twin of the greedy pooling: levels in falling frequency, a pool closes at five percent.
GREEDY = """
  select r.value, r.i, r.n, r.total, 0 as slot, r.n as acc from ordered r where i = 1
  union all
  select r.value, r.i, r.n, r.total, case when g.acc / g.total >= 0.05 then g.slot + 1 else g.slot end,
    case when g.acc / g.total >= 0.05 then r.n else g.acc + r.n end
  from greedy g join ordered r on r.i = g.i + 1"""
POOL_SQL = f"""with recursive levels as (select p_brand as value, count(*) as n, sum(count(*)) over () as total from part group by 1),
  ordered as (select *, row_number() over (order by n desc, value) as i from levels where n / total < 0.05),
  greedy as ({GREEDY})
  select value, slot, sum(n) over (partition by slot) as pool_n from greedy"""
MERGE_SQL = """with recursive w as (
    select level, ln(((n - b) / (gt + 1e-4) + 1e-4) / (b / (bt + 1e-4) + 1e-4)) as woe from (
      select c_mktsegment as level, count(*) as n, count(*) filter (c_acctbal > 4500) as b,
        sum(count(*) filter (c_acctbal <= 4500)) over () as gt, sum(count(*) filter (c_acctbal > 4500)) over () as bt
      from customer group by 1)),
  o as (select *, row_number() over (order by woe, level) as i from w),
  m as (select level, woe, i, 0 as grp, woe as anchor from o where i = 1
    union all select o.level, o.woe, o.i, case when abs(o.woe - m.anchor) <= 0.1 then m.grp else m.grp + 1 end,
      case when abs(o.woe - m.anchor) <= 0.1 then m.anchor else o.woe end from m join o on o.i = m.i + 1)
  select level, grp from m"""


def _cap_sql(c: str) -> str:
    return f"""select l_orderkey, l_linenumber, '{c}' as feature, case when far and x < lo then lo when far and x > hi then hi else x end as value
      from (select *, case when abs(sk) < 1 then abs(x - mean) > (case when abs(sk) > 0.7 then 2 else 3 end) * sd
                      else med <> 0 and mad > 0 and abs(x - med) > 8 * mad / 0.6744897501960817 end as far
        from (select l_orderkey, l_linenumber, {c} as x from feat),
          (select skewness({c}) as sk, avg({c}) as mean, stddev_samp({c}) as sd, median({c}) as med, mad({c}) as mad,
             case when quantile_cont({c}, 0.25) - 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) < min({c})
               then quantile_cont({c}, 0.01) else quantile_cont({c}, 0.25) - 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) end as lo,
             case when quantile_cont({c}, 0.75) + 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) > max({c})
               then quantile_cont({c}, 0.99) else quantile_cont({c}, 0.75) + 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) end as hi
           from feat))"""


def _long(df, cols):
    return df.select(*IDS, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(IDS, list(cols), "feature", "value")


LOGGED = """(select *, case when abs(skewness(f_skew) over ()) > 1.0 then sign(f_skew) * ln(1 + abs(f_skew)) else f_skew end as logged from feat)"""
WOE_SQL = """ln(((n - bad) / (gt + 1e-4) + 1e-4) / (bad / (bt + 1e-4) + 1e-4))"""

QUERIES = [
    Query(
        "j1_outlier_capping",
        "l_orderkey:i l_linenumber:i feature:s value:f2",
        lambda s, d: _long(OutlierCapper(inputCols=CAPPED).fit(B.feat(s, d)).transform(B.feat(s, d)), CAPPED),
        " union all ".join(_cap_sql(c) for c in CAPPED),
    ),
    Query(
        "j2_category_imputation",
        "l_orderkey:i l_linenumber:i c_flag:s c_flag_null:i",
        lambda s, d: CategoryImputer(inputCols=["c_flag", "c_stat"]).fit(B.feat(s, d)).transform(B.feat(s, d)),
        """select l_orderkey, l_linenumber, coalesce(c_flag, (select c_flag from feat where c_flag is not null group by 1
             order by count(*) desc, c_flag limit 1)) as c_flag, cast(c_flag is null as int) as c_flag_null from feat""",
    ),
    Query(
        "j3_mean_imputation",
        "l_orderkey:i l_linenumber:i f_disc:f f_disc_null:i",
        lambda s, d: NumericImputer(inputCols=["f_disc", "f_qty"]).fit(B.feat(s, d)).transform(B.feat(s, d)),
        """select l_orderkey, l_linenumber, coalesce(f_disc, (select avg(f_disc) from feat)) as f_disc,
           cast(f_disc is null as int) as f_disc_null from feat""",
    ),
    Query(
        "j3_median_imputation",
        "l_orderkey:i l_linenumber:i f_disc:f",
        lambda s, d: NumericImputer(inputCols=["f_disc"], strategy="median", addFlags=False)
        .fit(B.feat(s, d))
        .transform(B.feat(s, d)),
        "select l_orderkey, l_linenumber, coalesce(f_disc, (select median(f_disc) from feat)) as f_disc from feat",
    ),
    Query(
        "j4_random_imputation",
        "l_orderkey:i l_linenumber:i f_disc:f",
        lambda s, d: NumericImputer(inputCols=["f_disc"], strategy="random", keyCols=IDS, addFlags=False)
        .fit(B.feat(s, d))
        .transform(B.feat(s, d)),
        """with c as (select v, share, lag(v) over (order by v) as v0, lag(share) over (order by v) as s0 from (
             select f_disc as v, sum(count(*)) over (order by f_disc) / sum(count(*)) over () as share from feat
             where f_disc is not null group by 1)),
           u as (select l_orderkey, l_linenumber, (select min(share) from c) + (1 - (select min(share) from c)) *
             (cast('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|f_disc|42'), 1, 12) as bigint) / 281474976710656.0) as u
             from feat where f_disc is null)
           select l_orderkey, l_linenumber, f_disc from feat where f_disc is not null
           union all select l_orderkey, l_linenumber, coalesce(v0 + (v - v0) * (u - s0) / (share - s0), v) from u
             join c on u.u <= c.share and (c.s0 is null or u.u > c.s0)""",
    ),
    Query(
        "j5_woe_categories",
        "l_orderkey:i l_linenumber:i c_flag:f c_stat:f",
        lambda s, d: _encoded(s, d, categoricalCols=["c_flag", "c_stat"], similarity=0.0),
        " ".join(
            [
                "select f.l_orderkey, f.l_linenumber, a.w as c_flag, b.w as c_stat from feat f",
                *[
                    f"""join (select v, {WOE_SQL} as w from (select coalesce({c}, 'nan') as v, count(*) as n, sum(target) as bad,
                      sum(count(*) - sum(target)) over () as gt, sum(sum(target)) over () as bt from feat group by 1)) {t}
                      on coalesce(f.{c}, 'nan') = {t}.v"""
                    for t, c in (("a", "c_flag"), ("b", "c_stat"))
                ],
            ]
        ),
    ),
    Query("j6_rare_levels", "value:s slot:i pool_n:i", _pooled_members, POOL_SQL),
    Query("j7_similar_levels", "level:s grp:i", _merged, MERGE_SQL),
    Query(
        "j7_woe_pooled",
        "p_partkey:i p_brand:f",
        lambda s, d: WoeEncoder(categoricalCols=["p_brand"]).fit(_brands(s, d)).transform(_brands(s, d)),
    ),
    Query(
        "j8_woe_bins",
        "l_orderkey:i l_linenumber:i f_price:f",
        lambda s, d: _encoded(s, d, numericCols=["f_price"], bins=5),
        f"""with b as (select bin, {WOE_SQL} as w from (select bin, n, bad, sum(n - bad) over () as gt, sum(bad) over () as bt
              from ({bins_sql("select 'f_price' as feature, f_price as value, target from feat", 5)})))
            select l_orderkey, l_linenumber, b.w as f_price from feat
            join ({edges_sql("select 'f_price' as feature, f_price as value from feat", 5)}) e on true
            join b on b.bin = greatest(len(list_filter(edges, lambda x: x < f_price)) - 1, 0)""",
    ),
    Query(
        "j9_signed_log",
        "l_orderkey:i l_linenumber:i f_skew:f f_qty:f",
        lambda s, d: SignedLog(inputCols=["f_skew", "f_qty"], threshold=1.0).fit(B.feat(s, d)).transform(B.feat(s, d)),
        f"select l_orderkey, l_linenumber, logged as f_skew, f_qty from {LOGGED}",
    ),
    Query(
        "j10_standard_scale",
        "l_orderkey:i l_linenumber:i f_qty:f f_price:f f_const:f",
        lambda s, d: Scaler(inputCols=["f_qty", "f_price", "f_const"], kind="standard").fit(B.feat(s, d)).transform(B.feat(s, d)),
        """select l_orderkey, l_linenumber, (f_qty - (select avg(f_qty) from feat)) / (select stddev_pop(f_qty) from feat) as f_qty,
           (f_price - (select avg(f_price) from feat)) / (select stddev_pop(f_price) from feat) as f_price, 0.0 as f_const from feat""",
    ),
    Query(
        "j10_robust_scale",
        "l_orderkey:i l_linenumber:i f_price:f f_disc:f",
        lambda s, d: Scaler(inputCols=["f_price", "f_disc"]).fit(B.feat(s, d)).transform(B.feat(s, d)),
        """select l_orderkey, l_linenumber, (f_price - pm) / (p3 - p1) as f_price, (f_disc - dm) / (d3 - d1) as f_disc from feat,
           (select median(f_price) as pm, quantile_cont(f_price, 0.25) as p1, quantile_cont(f_price, 0.75) as p3,
              median(f_disc) as dm, quantile_cont(f_disc, 0.25) as d1, quantile_cont(f_disc, 0.75) as d3 from feat)""",
    ),
    Query(
        "j11_pipeline",
        "l_orderkey:i l_linenumber:i f_qty:f f_skew:f f_disc:f f_price:f f_tax:f c_flag:f c_stat:f",
        lambda s, d: Pipeline(
            stages=[
                ColumnPicker(inputCols=[*IDS, *NUMERIC, "c_flag", "c_stat"], optionalCols=["target"]),
                OutlierCapper(inputCols=NUMERIC),
                CategoryImputer(inputCols=["c_flag", "c_stat"]),
                NumericImputer(inputCols=NUMERIC, strategy="median"),
                WoeEncoder(categoricalCols=["c_flag", "c_stat"]),
                SignedLog(inputCols=NUMERIC),
                Scaler(inputCols=NUMERIC),
            ]
        )
        .fit(B.feat(s, d))
        .transform(B.feat(s, d)),
    ),
]
