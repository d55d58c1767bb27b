"""A registered query: a Spark callable, its output columns and, where SQL can say it, the same in DuckDB.

Columns are listed once as ``name:kind`` (i whole number, f number to 6 decimals, f4 to 4, s text, d date as text) and
both sides are cast and rounded by that list.
"""

from __future__ import annotations

import re
import threading
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_MADE: dict[tuple, Any] = {}
_LOCKS: dict[tuple, threading.Lock] = defaultdict(threading.Lock)


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], Any]) -> Any:
    """What ``build`` returns, made once per session and input: several queries look at the same model or table."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _LOCKS[key]:
        if key not in _MADE:
            _MADE[key] = build()
        return _MADE[key]


@dataclass(frozen=True)
class Query:
    key: str
    columns: str
    build: Callable[[SparkSession, str], DataFrame]
    body: str | None = None

    def _spec(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.columns.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = []
        for name, kind in self._spec():
            c = F.col(name)
            if kind == "i":
                c = c.cast("long")
            elif kind == "d":
                c = F.date_format(c.cast("date"), "yyyy-MM-dd")
            elif kind == "s":
                c = c.cast("string")
            else:
                c = F.round(c.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)
            out.append(c.alias(name))
        return self.build(spark, sf_dir).select(*out)

    def oracle(self) -> str | None:
        if self.body is None:
            return None
        out = []
        for name, kind in self._spec():
            if kind == "i":
                c = f"cast({name} as bigint)"
            elif kind == "d":
                c = f"strftime(cast({name} as date), '%Y-%m-%d')"
            elif kind == "s":
                c = f"cast({name} as varchar)"
            else:
                c = f"round(cast({name} as double), {int(kind[1:] or 6)}) + 0.0"
            out.append(f"{c} as {name}")
        needed = _needed(self.body)
        ctes = ",\n".join(f"{n} as ({CTES[n]})" for n in CTES if n in needed)
        return f"with recursive {ctes}{',' if ctes else ''}\nresult as ({self.body})\nselect {', '.join(out)} from result"


def _needed(body: str) -> set[str]:
    """Names of the shared tables a body mentions, directly or through one another."""
    found, pending = set(), [body]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        for name in (words & CTES.keys()) - found:
            found.add(name)
            pending.append(CTES[name])
    return found


# The input tables in DuckDB, in order of dependency.
CTES: dict[str, str] = {
    "trx": """
select o.o_custkey as client_id, o.o_orderdate as event_time, o.o_orderpriority as event_type,
       o.o_orderstatus as event_subtype, nullif(l.l_linenumber, 7) as currency, l.l_extendedprice as amount,
       l.l_linestatus as src_type11, nullif(l.l_returnflag, 'N') as dst_type11, l.l_linestatus as dst_type12,
       cast(date_trunc('month', o.o_orderdate) as date) as mon
from lineitem l join orders o on l.l_orderkey = o.o_orderkey""",
    "purchase": """
select o_custkey as client_id, cast(date_trunc('month', o_orderdate) as date) as mon,
       max(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as target_1,
       max(case when o_orderpriority = '2-HIGH' then 1 else 0 end) as target_2,
       max(case when o_orderpriority = '3-MEDIUM' then 1 else 0 end) as target_3,
       max(case when o_orderpriority = '4-NOT SPECIFIED' then 1 else 0 end) as target_4,
       count(*) as trans_count,
       date_diff('day', cast(max(o_orderdate) as date), last_day(cast(max(o_orderdate) as date))) as diff_trans_date
from orders group by 1, 2""",
    "geo": """
select user_id as client_id, ts as event_time, cast(date_trunc('week', ts) as date) as mon, cast(ts as date) as day,
       substr(md5(props), 1, 1) as geohash_4, substr(md5(props), 1, 2) as geohash_5, substr(md5(props), 1, 3) as geohash_6
from events""",
    "dialog": """
select label as client_id, timestamp '2024-01-01' + to_hours(cast(vec_id * 6 as integer)) as event_time,
       cast(date_trunc('month', timestamp '2024-01-01' + to_hours(cast(vec_id * 6 as integer))) as date) as mon,
       list_transform(embedding, lambda x: cast(x as double) * (1 + vec_id % 7)) as embedding
from embeddings""",
    "scores": """
select o_orderkey as id, case when (o_totalprice > 250000) <> (o_orderkey % 5 = 0) then 1 else 0 end as y_true,
       least(floor(o_totalprice / 5000) / 100, 1.0) as y_score, o_orderpriority as model
from orders""",
    "feat": """
select l_orderkey, l_linenumber, l_quantity as f_qty, power(l_extendedprice / 1000, 3) as f_skew,
       case when l_discount = 0.0 then null else l_discount end as f_disc, cast(0 as double) as f_const,
       l_extendedprice as f_price, l_tax as f_tax, nullif(l_returnflag, 'N') as c_flag, l_linestatus as c_stat,
       cast(l_quantity + case when l_returnflag = 'R' then 10 else 0 end > 30 as int) as target
from lineitem""",
    "portfolio": "select md5(cast(c_custkey as varchar)) as client_id, cast(c_nationkey as bigint) as chat_id from customer",
    "shares": """
select client_id, max(mon) as mon, avg(target_1) as p1, avg(target_3) as p3, avg(target_4) as p4
from purchase group by client_id""",
    "predictions": """
select mon, md5(cast(client_id as varchar)) as client_id, product_id, 'product_' || product_id as name_product, prob,
       cast(prob > 0.25 as int) as pred
from (select mon, client_id, 1 as product_id, p1 as prob from shares
      union all select mon, client_id, 3, p3 from shares
      union all select mon, client_id, 4, p4 from shares)""",
    "positives": "select mon, client_id, product_id, name_product, prob from predictions where pred = 1",
    "client_features": """
select md5(cast(client_id as varchar)) as client_id, avg(trans_count) as trans_count,
       avg(diff_trans_date) as diff_trans_date, cast(count(*) as double) as months_active, avg(target_2) as share_product_2
from purchase group by purchase.client_id""",
    "contribs": """
select client_id, feature, value, w * (value - avg(value) over (partition by feature)) as contribution
from (select client_id, 'trans_count' as feature, trans_count as value, 1.5 as w from client_features
      union all select client_id, 'diff_trans_date', diff_trans_date, -0.1 from client_features
      union all select client_id, 'months_active', months_active, 0.25 from client_features
      union all select client_id, 'share_product_2', share_product_2, 2.0 from client_features)""",
    "reason_rows": """
select client_id, place,
       case when contribution > 0 then '↑' else '↓' end || ' ' || feature || ' = ' || cast(round(value, 4) as varchar) as reason,
       case when contribution > 0 then 'up' else 'down' end as direction, feature
from (select *, row_number() over (partition by client_id order by abs(contribution) desc, feature) as place from contribs)
where place <= 2""",
    "requests": """
select conv_id * 100 + turn as update_id, conv_id % 25 as chat_id,
       case u % 7 when 0 then null when 1 then text when 2 then text
            when 3 then text || ' ' || upper(md5(cast(u % 1500 as varchar)))
            when 4 then 'clientes ' || md5(cast(u % 1500 as varchar)) || ' y ' || md5(cast(u % 1000 + 7 as varchar))
            else text || ' 0123456789abcdef0' end as text,
       case u % 7 when 1 then '{"intents": ["razones", "recs", "razones", "otros"]}' when 2 then '{not json'
            when 3 then '{"intent": "razones", "client_ids": []}'
            when 4 then '{"intents": ["recs", "razones"], "client_ids": [" ' || upper(md5(cast(u % 1000 + 7 as varchar))) || '"]}'
            when 5 then '{"intents": "razones", "client_ids": ["' || md5(cast(u % 1500 as varchar)) || '"]}' end as reply_json
from (select *, conv_id * 100 + turn as u from conversations where role = 'user')""",
}
