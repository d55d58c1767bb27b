"""Contributions, reasons, recommendations, answers and the request stream (N, O, F4, F5)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientpulse.catalog.base import Query
from clientpulse.catalog.modelling import CATEGORIES, FEATURES, KEY, TEST_ROWS, chosen, dataset, trained
from clientpulse.functions.text import reply_intents
from clientpulse.operators.sampling import fraction_sample
from clientpulse.plans import master as M
from clientpulse.plans import models as ML
from clientpulse.plans import reason_store as RS
from clientpulse.plans import reasons as R
from clientpulse.plans import recommend as RC
from clientpulse.session import materialize, scratch_path
from clientpulse.sources import bindings as B
from clientpulse.streaming import requests as ST

# Fixed weights of the linear score the contribution queries explain.
WEIGHTS = {"trans_count": 1.5, "diff_trans_date": -0.1, "months_active": 0.25, "share_product_2": 2.0}


def positives(s, d):
    return RC.positive_predictions(B.predictions(s, d))


def client_contribs(s, d):
    return R.linear_contributions(B.client_features(s, d), ["client_id"], WEIGHTS)


def pair_contribs(s, d):
    """Contributions per client and product."""
    return positives(s, d).select("client_id", "product_id").join(client_contribs(s, d), "client_id")


def stored_reasons(s, d):
    return R.build_reasons(positives(s, d), pair_contribs(s, d))


def names(s, d):
    return B.predictions(s, d).select("product_id", "name_product").distinct()


def _answers(s, d, rows=None):
    return RC.answer(
        ST.usable(B.requests(s, d)) if rows is None else rows,
        positives(s, d),
        materialize(stored_reasons(s, d), "reasons"),
        B.portfolio(s, d),
        names(s, d),
    )


def _tree_rows(s, d, family):
    """Contributions of a tree model on the test months, with its own score to compare."""
    model, test_rows = trained(s, d, family)
    prepared = ML.prefix(model).transform(test_rows)
    classifier = model.stages[-1]
    scored = classifier.transform(prepared)
    return R.tree_contributions(scored, [*KEY, "rawPrediction", "probability"], classifier, ML.feature_names(model))


def _forest_contributions(s, d):
    rows = _tree_rows(s, d, "forest")
    total = F.aggregate("contribs", F.lit(0.0), lambda a, c: a + c["contribution"])
    return rows.select(
        *KEY, F.get(vector_to_array("probability"), F.lit(1)).alias("prob"), (F.col("base") + total).alias("explained")
    )


def _boosted_contributions(s, d):
    rows = _tree_rows(s, d, "boosted")
    total = F.aggregate("contribs", F.lit(0.0), lambda a, c: a + c["contribution"])
    return rows.select(
        *KEY, F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("margin"), (F.col("base") + total).alias("explained")
    )


def _lookup(s, d):
    sampled = R.build_reasons(positives(s, d), pair_contribs(s, d), fraction=0.05)
    return sampled.withColumn("reasons", F.array_join("reasons", "; "))


def _model_reasons(s, d):
    """Reasons of every product's own model for all clients it recommends the product to, at their newest test month."""
    models = {k: model for k, (model, _) in chosen(s, d).items()}
    rows = materialize(newest(test_master(s, d)), "newest")
    wanted = None
    for product, model in models.items():
        part = ML.score(rows, model, ML.THRESHOLDS[product]).filter("pred = 1").select("client_id", F.lit(product).alias("product_id"))
        wanted = part if wanted is None else wanted.unionByName(part)
    return R.top_reasons(R.explain(materialize(wanted, "wanted"), rows, models, KEY))


def test_master(s, d):
    """Features of the client-months of the test period."""
    return M.temporal_split(dataset(s, d))[1].drop("target")


def newest(rows):
    place = F.row_number().over(W.partitionBy("client_id").orderBy(F.desc("mon")))  # one row per client and month
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def _reason_facts(s, d):
    """Each explained pair, with whether it has two reasons of different features that the models know."""
    names = [*FEATURES, *CATEGORIES]
    known = F.array(*[F.lit(n) for c in names for n in (c, f"{c}_null")])
    feature = F.transform("reasons", lambda r: F.substring_index(F.substring(r, 3, 1000), " = ", 1))
    good = (F.size("reasons") == 2) & (F.size(F.array_intersect(feature, known)) == 2)
    return _model_reasons(s, d).agg(
        (F.count(F.lit(1)) - F.count_distinct("client_id", "product_id")).alias("repeated"), F.count_if(~good).alias("unknown")
    )


def _explained(family):
    """Whether base and contributions add up to the model's own score."""

    def build(s, d):
        rows = _forest_contributions(s, d) if family == "forest" else _boosted_contributions(s, d)
        score = "prob" if family == "forest" else "margin"
        return rows.select(*KEY, (F.abs(F.col(score) - F.col("explained")) < 1e-9).cast("int").alias("adds_up"))

    return build


def _kept_reasons(s, d):
    """A twentieth of the pairs asked for first, then all, then all again: reasons and the run that computed them."""
    store = RS.ReasonStore(s, scratch_path(s, "kept-reasons"), 1)
    pairs, contribs = positives(s, d), pair_contribs(s, d)
    store.complete(fraction_sample(pairs, ["client_id", "product_id"], 0.05), contribs)
    store.complete(pairs, contribs)
    store.compact()
    return store.complete(pairs, contribs).withColumn("reasons", F.array_join("reasons", "; "))


def _completed(s, d):
    pairs, contribs = positives(s, d), pair_contribs(s, d)
    sampled = materialize(R.build_reasons(pairs, contribs, fraction=0.05), "sampled")
    return R.complete_reasons(pairs, sampled, contribs).withColumn("reasons", F.array_join("reasons", "; "))


def streamed(s, d):
    """The requests as a stream of files, each delivered twice, answered once."""
    root = scratch_path(s, "stream")
    rows = B.requests(s, d)
    for part in (rows, rows):
        part.write.mode("append").parquet(f"{root}/in")
    predicted = materialize(B.predictions(s, d), "predictions")
    recommended = RC.positive_predictions(predicted)
    contribs = R.linear_contributions(materialize(B.client_features(s, d), "client-features"), ["client_id"], WEIGHTS)
    reasons = R.build_reasons(recommended, recommended.select("client_id", "product_id").join(contribs, "client_id"))
    query = ST.answer_stream(
        ST.read_requests(s, f"{root}/in"),
        f"{root}/out",
        f"{root}/checkpoint",
        recommended,
        materialize(reasons, "reasons"),
        B.portfolio(s, d),
        predicted.select("product_id", "name_product").distinct(),
    )
    query.awaitTermination()
    return s.read.parquet(f"{root}/out")


def _offsets(s, d):
    """Batches of the request source: every row is read once, none twice."""
    root = scratch_path(s, "source")
    B.requests(s, d).write.mode("overwrite").parquet(f"{root}/in")

    def drain():
        query = (
            ST.read_requests(s, f"{root}/in")
            .writeStream.format("parquet")
            .option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    drain()
    B.requests(s, d).withColumn("update_id", F.col("update_id") + 1000000).write.mode("append").parquet(f"{root}/in")
    drain()
    return s.read.parquet(f"{root}/out").select("update_id", "chat_id")


def _once(s, d):
    """The requests delivered newest half first, then all of them again in later batches."""
    root = scratch_path(s, "once")
    rows = ST.usable(B.requests(s, d))
    middle = rows.agg(F.avg(F.unix_micros("received_at"))).scalar()
    for part in (rows.filter(F.unix_micros("received_at") > middle), rows, rows):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")

    query = (
        ST.first_deliveries(ST.read_requests(s, f"{root}/in", files_per_trigger=1))
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return s.read.parquet(f"{root}/out").select("update_id", "chat_id")


REASON_TEXT = """(select client_id, string_agg(reason, '; ' order by place) as reasons,
    string_agg(substr(reason, 3) || case when direction = 'up' then ' (al alza)' else ' (a la baja)' end, '; ' order by place) as pretty,
    string_agg(chr(10) || '  • ' || reason, '' order by place) as bullets from reason_rows group by 1)"""
PERCENT = "cast(cast(round_even(prob * 100, 0) as int) as varchar) || '%'"
BLOCKS = f"""(select client_id, 'Cliente: ' || client_id || chr(10) || string_agg('- ' || name_product || ' — Prob ' || {PERCENT}, chr(10)
    order by prob desc, product_id) as block from positives group by 1)"""
WHY_BLOCKS = f"""(select p.client_id, 'Cliente: ' || p.client_id || chr(10) || string_agg('- ' || name_product || ' — Prob ' || {PERCENT} || bullets,
    chr(10) order by prob desc, product_id) as block from positives p join {REASON_TEXT} r on p.client_id = r.client_id group by 1)"""
PERSONAL = f"""(select p.client_id, 'Cliente ' || p.client_id || chr(10) || chr(10) || '{RC.PERSONAL_TITLE}' || chr(10) || chr(10) ||
    string_agg(name_product || ': Para este cliente se recomienda ' || name_product || ' por señales como: ' || pretty || '.', chr(10)
    order by prob desc, product_id) as block from positives p join {REASON_TEXT} r on p.client_id = r.client_id group by 1)"""
GLOBAL = """(select product_id, direction, feature, count(*) as n,
    row_number() over (partition by product_id, direction order by count(*) desc, feature) as place
  from positives p join reason_rows r on p.client_id = r.client_id group by 1, 2, 3)"""
SENTENCES = f"""(select p.product_id, name_product || ': ' || name_product || coalesce(
      ' se recomienda porque en tu cartera destacan al alza: ' || tops || '.',
      ' se recomienda por el patrón observado en tus clientes (sin suficientes señales específicas).') as sentence
    from (select distinct product_id, name_product from positives) p left join (select product_id, string_agg(feature, ', ' order by place) as tops
      from {GLOBAL} where direction = 'up' and place <= 3 group by 1) t on p.product_id = t.product_id)"""
GENERAL = f"""(select '{RC.GENERAL_TITLE}' || chr(10) || chr(10) || string_agg(sentence, chr(10) || chr(10) order by product_id) as body from {SENTENCES})"""
MESSAGES = f"""(select chat_id, part_no, '{RC.RECS_TITLE}' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) order by client_id) as body from (
    select f.chat_id, b.client_id, b.block, cast(floor((row_number() over (partition by f.chat_id order by b.client_id) - 1) / 50) as int) + 1 as part_no
    from {BLOCKS} b join portfolio f on b.client_id = f.client_id) group by 1, 2)"""
ASKED = """(select update_id, chat_id, list_sort(list_distinct(list_concat(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-f]{16,}'),
      case update_id % 7 when 4 then [md5(cast(update_id % 1000 + 7 as varchar))] when 5 then [md5(cast(update_id % 1500 as varchar))]
        else [] end))) as asked,
    case update_id % 7 when 1 then 'razones,recs' when 3 then 'razones' when 4 then 'recs,razones' when 5 then 'razones' else 'recs' end as intents
  from requests)"""
SCOPE = f"""(select a.update_id, a.chat_id, intents, coalesce(inside, '') as inside, coalesce(outside, '') as outside, outcome,
    case outcome when 'empty' then '{RC.NO_CLIENTS}' when 'fallback' then '{RC.ALL_OUTSIDE}'
      when 'subset' then '{RC.SOME_OUTSIDE[0]}' || outside || '{RC.SOME_OUTSIDE[1]}' end as notice
  from (select a.*, inside, outside, case when k.chat_id is null then 'empty' when len(asked) = 0 then 'whole'
          when inside is not null then 'subset' else 'fallback' end as outcome
        from {ASKED} a left join (select distinct chat_id from portfolio) k on a.chat_id = k.chat_id
        left join (select u.update_id, string_agg(u.client_id, ', ' order by u.client_id) filter (f.client_id is not null) as inside,
            string_agg(u.client_id, ', ' order by u.client_id) filter (f.client_id is null) as outside
          from (select update_id, chat_id, unnest(asked) as client_id from {ASKED}) u
          left join portfolio f on f.client_id = u.client_id and f.chat_id = u.chat_id group by 1) s on a.update_id = s.update_id) a)"""
# The same, read once by the answer query.
INSIDE = """(select update_id, chat_id, intents, client_id, row_number() over (partition by update_id order by client_id) as part_no
  from (select update_id, chat_id, intents, unnest(string_split(inside, ', ')) as client_id from scope where outcome = 'subset'))"""


def _per_client(section: int, intent: str, blocks: str, title: str, none: str) -> str:
    return f"""select i.update_id, i.chat_id, {section} as section, i.part_no, '{title}' || block as body from {INSIDE} i
        join {blocks} b on b.client_id = i.client_id where intents like '%{intent}%'
      union all select update_id, chat_id, {section}, 1, '{none}' from (select i.update_id, i.chat_id, count(block) as n from {INSIDE} i
        left join {blocks} b on b.client_id = i.client_id where intents like '%{intent}%' group by 1, 2) where n = 0"""


def answers_sql(usable: str) -> str:
    return f"""with scope as materialized (select s.* from {SCOPE} s join (select update_id from requests where {usable}) u on s.update_id = u.update_id)
      select update_id, chat_id, 0 as section, 1 as part_no, notice as body from scope where notice is not null
      union all select s.update_id, s.chat_id, 1, coalesce(part_no, 1), coalesce(body, '{RC.NO_RECS}') from scope s
        left join {MESSAGES} m on m.chat_id = s.chat_id where outcome in ('whole', 'fallback') and intents like '%recs%'
      union all select s.update_id, s.chat_id, 2, 1, body from scope s, {GENERAL} g
        where outcome in ('whole', 'fallback') and intents like '%razones%'
      union all {_per_client(1, 'recs', BLOCKS, RC.RECS_TITLE + chr(10) + chr(10), RC.NO_RECS)}
      union all {_per_client(2, 'razones', PERSONAL, '', RC.NO_PERSONAL)}"""


USABLE = "chat_id is not null and length(coalesce(text, '')) > 0"
SAMPLED = """cast('0x' || substr(md5(client_id || '|' || product_id || '|42'), 1, 12) as bigint) / 281474976710656.0 < 0.05"""
ANSWER_COLUMNS = "update_id:i chat_id:i section:i part_no:i body:s"

QUERIES = [
    Query(
        "n1_linear_contributions",
        "client_id:s feature:s value:f contribution:f",
        lambda s, d: client_contribs(s, d).select("client_id", F.inline("contribs")),
        "select client_id, feature, value, contribution from contribs",
    ),
    Query("n1_forest_contributions", "client_id:i mon:d prob:f explained:f", _forest_contributions),
    Query("n1_boosted_contributions", "client_id:i mon:d margin:f explained:f", _boosted_contributions),
    *[
        Query(f"n1_{f}_adds_up", "client_id:i mon:d adds_up:i", _explained(f), f"select client_id, mon, 1 as adds_up from {TEST_ROWS}")
        for f in ("forest", "boosted")
    ],
    Query(
        "n2_top_reasons",
        "client_id:s reasons:s",
        lambda s, d: R.top_reasons(client_contribs(s, d)).withColumn("reasons", F.array_join("reasons", "; ")),
        f"select client_id, reasons from {REASON_TEXT}",
    ),
    Query(
        "f4_top_k_per_row",
        "client_id:s place:i reason:s",
        lambda s, d: R.top_reasons(client_contribs(s, d)).select(
            "client_id", F.posexplode("reasons").alias("place", "reason")
        ),
        "select client_id, place - 1 as place, reason from reason_rows",
    ),
    Query(
        "n3_reason_lookup",
        "client_id:s product_id:i reasons:s",
        _lookup,
        f"""select p.client_id, product_id, reasons from (select * from positives where {SAMPLED}) p
            join {REASON_TEXT} r on p.client_id = r.client_id""",
    ),
    Query(
        "n3_model_reasons",
        "client_id:i mon:d product_id:i reasons:s",
        lambda s, d: _model_reasons(s, d).withColumn("reasons", F.array_join("reasons", "; ")),
    ),
    Query("n3_reason_facts", "repeated:i unknown:i", _reason_facts, "select 0 * count(*) as repeated, 0 * count(*) as unknown from purchase"),
    Query(
        "n4_kept_reasons",
        "client_id:s product_id:i reasons:s run:i",
        _kept_reasons,
        f"""select p.client_id, p.product_id, reasons, case when s.client_id is null then 2 else 1 end as run
            from positives p join {REASON_TEXT} r on p.client_id = r.client_id
            left join (select client_id, product_id from positives where {SAMPLED}) s on p.client_id = s.client_id and p.product_id = s.product_id""",
    ),
    Query(
        "n4_complete_reasons",
        "client_id:s product_id:i reasons:s",
        _completed,
        f"select p.client_id, product_id, reasons from positives p join {REASON_TEXT} r on p.client_id = r.client_id",
    ),
    Query(
        "n5_global_reasons",
        "product_id:i direction:s feature:s n:i",
        lambda s, d: R.global_reasons(stored_reasons(s, d)),
        f"select product_id, direction, feature, n from {GLOBAL}",
    ),
    Query(
        "f5_top_k_common",
        "product_id:i direction:s feature:s n:i place:i",
        lambda s, d: R.top_global(R.global_reasons(stored_reasons(s, d)), 3),
        f"select * from {GLOBAL} where place <= 3",
    ),
    Query(
        "n6_global_importance",
        "feature:s importance:f",
        lambda s, d: R.global_importance(client_contribs(s, d), 3),
        "select feature, avg(abs(contribution)) as importance from contribs group by 1 order by 2 desc limit 3",
    ),
    Query(
        "n7_recommendation_text",
        "client_id:s block:s",
        lambda s, d: RC.recommendation_blocks(positives(s, d)),
        f"select * from {BLOCKS}",
    ),
    Query(
        "n7_portfolio_messages",
        "chat_id:i part_no:i body:s",
        lambda s, d: RC.portfolio_messages(positives(s, d), B.portfolio(s, d)),
        f"select * from {MESSAGES}",
    ),
    Query(
        "n8_intents",
        "update_id:i intents:s",
        lambda s, d: B.requests(s, d).select("update_id", F.array_join(reply_intents("reply_json"), ",").alias("intents")),
        f"select update_id, intents from {ASKED}",
    ),
    Query(
        "n9_scope",
        "update_id:i chat_id:i intents:s inside:s outside:s outcome:s notice:s",
        lambda s, d: RC.resolve_scope(B.requests(s, d), B.portfolio(s, d)).withColumns(
            {
                "intents": F.array_join("intents", ","),
                "inside": F.array_join("inside", ", "),
                "outside": F.array_join("outside", ", "),
            }
        ),
        f"select * from {SCOPE}",
    ),
    Query(
        "n10_reason_text",
        "client_id:s block:s",
        lambda s, d: RC.reason_blocks(positives(s, d), stored_reasons(s, d)),
        f"select * from {WHY_BLOCKS}",
    ),
    Query(
        "n10_personal_text",
        "client_id:s block:s",
        lambda s, d: RC.personal_blocks(positives(s, d), stored_reasons(s, d)),
        f"select * from {PERSONAL}",
    ),
    Query(
        "n11_general_text",
        "product_id:i sentence:s",
        lambda s, d: RC.general_sentences(stored_reasons(s, d), names(s, d)),
        f"select * from {SENTENCES}",
    ),
    Query("n12_answers", ANSWER_COLUMNS, _answers, answers_sql(USABLE)),
    Query(
        "o1_request_source",
        "update_id:i chat_id:i",
        _offsets,
        "select update_id, chat_id from requests union all select update_id + 1000000, chat_id from requests",
    ),
    Query(
        "o2_request_filter",
        "update_id:i chat_id:i allowed:i",
        lambda s, d: (
            lambda yes, no: yes.withColumn("allowed", F.lit(1)).unionByName(no.withColumn("allowed", F.lit(0)))
        )(*ST.allowed(ST.usable(B.requests(s, d)), [1, 2, 3, 5, 8, 13])),
        f"select update_id, chat_id, cast(chat_id in (1, 2, 3, 5, 8, 13) as int) as allowed from requests where {USABLE}",
    ),
    Query("o3_once", "update_id:i chat_id:i", _once, f"select update_id, chat_id from requests where {USABLE}"),
    Query("o4_answer_stream", ANSWER_COLUMNS, streamed, answers_sql(USABLE)),
]
