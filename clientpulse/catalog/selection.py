"""Feature statistics and selection (I, F3-like rankings, G3, G4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientpulse.catalog.base import Query
from clientpulse.operators import statistics as S
from clientpulse.sources import bindings as B

IDS = ["l_orderkey", "l_linenumber"]
NUMERIC = ["f_qty", "f_skew", "f_disc", "f_price", "f_tax"]
CATEGORICAL = ["c_flag", "c_stat"]


def _union(template: str, cols: list[str]) -> str:
    return " union all ".join(template.format(c=c) for c in cols)


LONG = _union("select '{c}' as feature, cast({c} as double) as value, target from feat", NUMERIC)
LEVELS = _union("select '{c}' as feature, {c} as value, target from feat", CATEGORICAL)
PAIRS = [("f_qty", "f_price"), ("f_qty", "f_tax"), ("f_qty", "f_disc"), ("f_price", "f_tax"), ("f_price", "f_disc"), ("f_tax", "f_disc")]
CORR_COLS = ["f_qty", "f_price", "f_tax", "f_disc"]


def _pairs_sql(table: str, pairs=PAIRS) -> str:
    ordered = [(a, b) if CORR_COLS.index(a) < CORR_COLS.index(b) else (b, a) for a, b in pairs]
    return " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as corr from {table}" for a, b in ordered)


RANKED = "(select {} from feat)".format(
    ", ".join(
        f"case when {c} is not null then rank() over (order by {c} nulls last) + "
        f"(count(*) over (partition by {c}) - 1) / 2.0 end as {c}"
        for c in CORR_COLS
    )
)

ANOVA = f"""select feature, n0 + n1 as n, (n0 * n1 / (n0 + n1) * (m0 - m1) * (m0 - m1)) / (w / (n0 + n1 - 2)) as f from (
    select feature, count(*) filter (target = 0) as n0, count(*) filter (target = 1) as n1,
      avg(value) filter (target = 0) as m0, avg(value) filter (target = 1) as m1,
      count(*) filter (target = 0) * var_pop(value) filter (target = 0) + count(*) filter (target = 1) * var_pop(value) filter (target = 1) as w
    from ({LONG}) where value is not null group by 1)"""

CRAMER = f"""select feature, sqrt(sum(power(gap - y, 2) / e) / max(n * (least(k, 2) - 1))) as v, max(n) as n from (
    select *, abs(o - e) as gap, case when k = 2 then least(0.5, abs(o - e)) else 0 end as y from (
      select l.feature, l.value, t.target, coalesce(c.o, 0) as o, l.r * t.r / n.n as e, n.n, n.k
      from (select feature, value, count(*) as r from ({LEVELS}) where value is not null group by 1, 2) l
      join (select feature, target, count(*) as r from ({LEVELS}) where value is not null group by 1, 2) t on l.feature = t.feature
      join (select feature, count(*) as n, count(distinct value) as k from ({LEVELS}) where value is not null group by 1) n
        on l.feature = n.feature
      left join (select feature, value, target, count(*) as o from ({LEVELS}) where value is not null group by 1, 2, 3) c
        on c.feature = l.feature and c.value = l.value and c.target = t.target)) group by 1"""


def edges_sql(long: str, bins: int) -> str:
    probs = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"""select feature, list_sort(list_distinct(quantile_cont(value, [{probs}]))) as edges from ({long})
               where value is not null group by 1"""


def bins_sql(long: str, bins: int) -> str:
    return f"""select l.feature, greatest(len(list_filter(edges, lambda e: e < value)) - 1, 0) as bin, count(*) as n, sum(target) as bad
      from ({long}) l join ({edges_sql(long, bins)}) e on l.feature = e.feature where value is not null group by 1, 2"""


def iv_sql(counts: str) -> str:
    return f"""select feature, sum((g / gs - b / bs) * ln((g / gs) / (b / bs))) as iv from (
        select feature, n - bad as g, bad as b, sum(n - bad) over (partition by feature) as gs, sum(bad) over (partition by feature) as bs
        from ({counts}) where bad > 0 and n - bad > 0) group by 1"""


LEVEL_COUNTS = f"select feature, value, count(*) as n, sum(target) as bad from ({LEVELS}) where value is not null group by 1, 2"
ALL_IV = f"{iv_sql(bins_sql(LONG, 25))} union all {iv_sql(LEVEL_COUNTS)}"


def _dist(s, d, cols=NUMERIC):
    return S.value_counts(B.feat(s, d), "target", cols)


QUERIES = [
    Query(
        "i1_column_types",
        "feature:s n_distinct:i kind:s",
        lambda s, d: S.column_types(B.feat(s, d), [*IDS, "target"]),
        _union(
            "select '{c}' as feature, count(distinct {c}) as n_distinct, case when count(distinct {c}) > 3 and '{c}' like 'f\\_%' escape '\\' then 'numeric' else 'categorical' end as kind from feat",
            [*NUMERIC, "f_const", *CATEGORICAL],
        ),
    ),
    Query(
        "i1_capped_types",
        "feature:s n_distinct:i kind:s",
        lambda s, d: S.column_types(B.feat(s, d), [*IDS, "target"], exact=False),
        _union(
            "select '{c}' as feature, least(count(distinct {c}), 4) as n_distinct, case when count(distinct {c}) > 3 and '{c}' like 'f\\_%' escape '\\' then 'numeric' else 'categorical' end as kind from feat",
            [*NUMERIC, "f_const", *CATEGORICAL],
        ),
    ),
    Query(
        "i2_zero_share",
        "feature:s zero_share:f mostly_zero:i",
        lambda s, d: S.zero_share(B.feat(s, d), [*NUMERIC, "f_const"], 0.98),
        _union(
            "select '{c}' as feature, avg(case when coalesce({c}, 0) = 0 then 1.0 else 0.0 end) as zero_share, cast(avg(case when coalesce({c}, 0) = 0 then 1.0 else 0.0 end) > 0.98 as int) as mostly_zero from feat",
            [*NUMERIC, "f_const"],
        ),
    ),
    Query(
        "i3_zero_variance",
        "feature:s variance:f2 constant:i",
        lambda s, d: S.zero_variance(B.feat(s, d), ["f_qty", "f_disc", "f_price", "f_tax", "f_const"]),
        _union(
            "select '{c}' as feature, var_samp({c}) as variance, cast(coalesce(var_samp({c}), 0) <= 0 as int) as constant from feat",
            ["f_qty", "f_disc", "f_price", "f_tax", "f_const"],
        ),
    ),
    Query("i4_pearson", "a:s b:s corr:f", lambda s, d: S.correlation(B.feat(s, d), CORR_COLS), _pairs_sql("feat")),
    Query(
        "i4_spearman",
        "a:s b:s corr:f",
        lambda s, d: S.correlation(B.feat(s, d), CORR_COLS, "spearman"),
        _pairs_sql(RANKED),
    ),
    Query(
        "i5_vif",
        "feature:s vif:f",
        lambda s, d: S.vif(B.feat(s, d), ["f_price", "f_skew"]),
        """select unnest(['f_price', 'f_skew']) as feature, unnest([v, v]) as vif from (
           select 1 / (1 - power(corr(f_price, f_skew), 2)) as v from feat)""",
    ),
    Query(
        "i6_vif_elimination",
        "feature:s vif:f dropped_at:i",
        lambda s, d: S.vif_eliminate(B.feat(s, d), NUMERIC),
    ),
    Query("i7_anova", "feature:s n:i f:f4", lambda s, d: S.anova(B.feat(s, d), "target", NUMERIC), ANOVA),
    Query("i7_anova_p", "feature:s p_value:f", lambda s, d: S.anova(B.feat(s, d), "target", NUMERIC)),
    Query("i8_cramers_v", "feature:s v:f n:i", lambda s, d: S.cramers_v(B.feat(s, d), "target", CATEGORICAL), CRAMER),
    Query(
        "i9_quantile_bins",
        "feature:s bin:i n:i bad:i",
        lambda s, d: S.binned_counts(_dist(s, d), 10),
        bins_sql(LONG, 10),
    ),
    Query(
        "i10_equal_width_bins",
        "l_orderkey:i l_linenumber:i bin:i",
        lambda s, d: (
            lambda f, ends: f.withColumn("__e", ends.scalar()).withColumn(
                "bin", S.equal_width_bin("f_qty", F.col("__e.lo"), F.col("__e.hi"), 5)
            )
        )(B.feat(s, d), B.feat(s, d).agg(F.struct(F.min("f_qty").alias("lo"), F.max("f_qty").alias("hi")).alias("e"))),
        """select l_orderkey, l_linenumber, greatest(ceil((f_qty - lo) * 5 / (hi - lo)) - 1, 0) as bin
           from feat, (select min(f_qty) as lo, max(f_qty) as hi from feat)""",
    ),
    Query(
        "i11_information_value",
        "feature:s iv:f",
        lambda s, d: S.information_value(B.feat(s, d), "target", ["f_qty"], bins=10),
        iv_sql(bins_sql("select 'f_qty' as feature, f_qty as value, target from feat", 10)),
    ),
    Query(
        "i12_iv_table",
        "feature:s iv:f",
        lambda s, d: S.information_value(B.feat(s, d), "target", NUMERIC, CATEGORICAL, 25),
        ALL_IV,
    ),
    Query(
        "i13_selection",
        "feature:s passed:s",
        lambda s, d: (
            lambda v, iv: v.filter(F.col("v") > 0.01)
            .select("feature", F.lit("cramer").alias("passed"))
            .unionByName(iv.filter(F.col("iv") > 0.02).select("feature", F.lit("iv").alias("passed")))
        )(
            S.cramers_v(B.feat(s, d), "target", CATEGORICAL),
            S.information_value(B.feat(s, d), "target", NUMERIC, CATEGORICAL, 25),
        ),
        f"""select feature, 'cramer' as passed from ({CRAMER}) where v > 0.01
            union all select feature, 'iv' from ({ALL_IV}) where iv > 0.02""",
    ),
    Query(
        "i13_all_rules",
        "feature:s rules:s",
        lambda s, d: S.select_features(B.feat(s, d), "target", NUMERIC, CATEGORICAL),
    ),
    Query(
        "g3_set_union",
        "feature:s",
        lambda s, d: S.cramers_v(B.feat(s, d), "target", CATEGORICAL)
        .filter(F.col("v") > 0.01)
        .select("feature")
        .union(S.information_value(B.feat(s, d), "target", NUMERIC, CATEGORICAL, 25).filter("iv > 0.02").select("feature"))
        .distinct(),
        f"select feature from ({CRAMER}) where v > 0.01 union select feature from ({ALL_IV}) where iv > 0.02",
    ),
    Query(
        "g4_set_difference",
        "feature:s",
        lambda s, d: (
            lambda t: t.select("feature").exceptAll(t.filter(F.col("kind") == "numeric").select("feature"))
        )(S.column_types(B.feat(s, d), [*IDS, "target"])),
        _union("select '{c}' as feature from feat having count(distinct {c}) <= 3", ["f_const", *CATEGORICAL]),
    ),
]
