"""Recommendation texts and answers to chat requests.

Texts are built per client (a handful of products) or per message of at most ``CLIENTS_PER_MESSAGE`` clients, never per
portfolio: one adviser may hold a third of all clients. A request's answer is a set of ordered message rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientpulse.functions.scalars import percent_text
from clientpulse.functions.text import ids_in_text, normal_id, reply_ids, reply_intents
from clientpulse.operators.ordered import ranked
from clientpulse.plans.reasons import UP, global_reasons, top_global
from clientpulse.session import materialize

CLIENTS_PER_MESSAGE = 50
# The wording of the messages.
RECS_TITLE = "Oportunidades — Resumen"
REASONS_TITLE = "Oportunidades — Con razones (SHAP)"
GENERAL_TITLE = "Oportunidades — Razones generales"
PERSONAL_TITLE = "Razones — Cliente específico"
NO_RECS = "No tengo recomendaciones para tu cartera en este corte."
NO_REASONS = "(razones SHAP se añadirán al conectar el modelo)"
NO_PERSONAL = "No hay razones disponibles para los clientes solicitados en este corte."
NO_CLIENTS = "No encuentro clientes asociados a tu usuario."
SOME_OUTSIDE = ("Algunos clientes no están en tu portafolio: ", ". Te muestro los que sí pertenecen a tu cartera.")
ALL_OUTSIDE = (
    "El/los clientes que proporcionas no se encuentran en tu portafolio; "
    "te comparto las recomendaciones para tus clientes."
)


def positive_predictions(predictions: DataFrame) -> DataFrame:
    """Recommended pairs; a date that does not parse becomes null."""
    return predictions.filter(F.col("pred") == 1).select(
        F.to_date(F.try_to_timestamp(F.col("mon").cast("string"))).alias("mon"),
        "client_id",
        "product_id",
        "name_product",
        "prob",
    )


def normalised(df: DataFrame) -> DataFrame:
    """Client ids trimmed and in lower case."""
    return df.withColumn("client_id", normal_id("client_id"))


def owners(portfolio: DataFrame) -> DataFrame:
    """Distinct ``client_id, chat_id`` with comparable ids."""
    return normalised(portfolio).select("client_id", F.col("chat_id").cast("long").alias("chat_id")).distinct()


def in_portfolio(positives: DataFrame, portfolio: DataFrame, chat_id: int | None = None) -> DataFrame:
    """Recommended pairs with the chat they belong to, or those of one chat."""
    mine = owners(portfolio)
    mine = mine if chat_id is None else mine.filter(F.col("chat_id") == chat_id)
    return normalised(positives).join(mine, "client_id")


def _lines(line: Column) -> Column:
    """Lines of a group by falling probability."""
    entries = F.collect_list(F.struct((-F.col("prob")).alias("p"), F.col("product_id"), line.alias("line")))
    return F.array_join(F.transform(F.sort_array(entries), lambda e: e["line"]), "\n")


def product_name() -> Column:
    return F.coalesce("name_product", F.concat(F.lit("Producto "), F.col("product_id").cast("string")))


def recommendation_blocks(positives: DataFrame) -> DataFrame:
    """``client_id, block``: the client's products with their probability; one short text per client."""
    line = F.concat(F.lit("- "), product_name(), F.lit(" — Prob "), percent_text("prob"))
    body = positives.groupBy("client_id").agg(_lines(line).alias("body"))
    return body.select("client_id", F.concat(F.lit("Cliente: "), "client_id", F.lit("\n"), "body").alias("block"))


def reason_blocks(positives: DataFrame, reasons: DataFrame) -> DataFrame:
    """``client_id, block``: as above with the first two reasons under each product."""
    known = positives.join(reasons, ["client_id", "product_id"], "left")
    listed = F.coalesce(F.slice("reasons", 1, 2), F.array(F.lit(NO_REASONS)))
    bullets = F.array_join(F.transform(listed, lambda r: F.concat(F.lit("\n  • "), r)), "")
    line = F.concat(F.lit("- "), product_name(), F.lit(" — Prob "), percent_text("prob"), bullets)
    body = known.groupBy("client_id").agg(_lines(line).alias("body"))
    return body.select("client_id", F.concat(F.lit("Cliente: "), "client_id", F.lit("\n"), "body").alias("block"))


def pretty_reasons(reasons: str | Column = "reasons") -> Column:
    """``feature = value (al alza)`` or ``(a la baja)``, joined by semicolons."""
    pretty = F.transform(
        reasons,
        lambda r: F.concat(
            F.trim(r.substr(F.lit(2), F.length(r))),
            F.when(r.startswith(UP), " (al alza)").otherwise(" (a la baja)"),
        ),
    )
    return F.array_join(pretty, "; ")


def personal_blocks(positives: DataFrame, reasons: DataFrame) -> DataFrame:
    """``client_id, block``: one template sentence per recommended product that has reasons."""
    known = positives.join(reasons, ["client_id", "product_id"]).filter(F.size("reasons") > 0)
    line = F.concat(
        product_name(),
        F.lit(": Para este cliente se recomienda "),
        product_name(),
        F.lit(" por señales como: "),
        pretty_reasons(),
        F.lit("."),
    )
    body = known.groupBy("client_id").agg(_lines(line).alias("body"))
    return body.select(
        "client_id",
        F.concat(F.lit("Cliente "), "client_id", F.lit(f"\n\n{PERSONAL_TITLE}\n\n"), "body").alias("block"),
    )


def general_sentences(reasons: DataFrame, names: DataFrame, k: int = 3) -> DataFrame:
    """``product_id, sentence``: which features most often speak for a product."""
    ups = top_global(global_reasons(reasons), k).filter(F.col("direction") == "up")
    # at most k rows per product
    listed = F.sort_array(F.collect_list(F.struct("place", "feature")))
    tops = ups.groupBy("product_id").agg(F.array_join(F.transform(listed, lambda t: t["feature"]), ", ").alias("tops"))
    named = reasons.select("product_id").distinct().join(names, "product_id", "left").join(tops, "product_id", "left")
    name = product_name()
    text = F.when(
        F.col("tops").isNotNull(),
        F.concat(name, F.lit(" se recomienda porque en tu cartera destacan al alza: "), "tops", F.lit(".")),
    ).otherwise(
        F.concat(
            name, F.lit(" se recomienda por el patrón observado en tus clientes (sin suficientes señales específicas).")
        )
    )
    return named.select("product_id", F.concat(name, F.lit(": "), text).alias("sentence"))


def general_text(reasons: DataFrame, names: DataFrame, k: int = 3) -> DataFrame:
    """One row with the general reasons of all products; as long as the product list."""
    rows = general_sentences(reasons, names, k)
    listed = F.sort_array(F.collect_list(F.struct("product_id", "sentence")))
    body = F.array_join(F.transform(listed, lambda s: s["sentence"]), "\n\n")
    return rows.agg(F.concat(F.lit(f"{GENERAL_TITLE}\n\n"), body).alias("body"))


def portfolio_messages(positives: DataFrame, portfolio: DataFrame, size: int = CLIENTS_PER_MESSAGE) -> DataFrame:
    """``chat_id, part_no, body``: each chat's whole portfolio in messages of ``size`` clients.

    Positions come from a range-partitioned rank, so a chat with very many clients is split like any other.
    """
    mine = owners(portfolio)
    theirs = normalised(positives).join(mine.select("client_id").distinct(), "client_id", "left_semi")
    blocks = recommendation_blocks(theirs).join(mine, "client_id")
    placed = ranked(blocks, ["chat_id"], ["client_id"], "place")
    paged = placed.withColumn("part_no", F.floor((F.col("place") - 1) / size).cast("int") + 1)
    listed = F.sort_array(F.collect_list(F.struct("client_id", "block")))
    body = F.array_join(F.transform(listed, lambda b: b["block"]), "\n\n")
    return paged.groupBy("chat_id", "part_no").agg(F.concat(F.lit(f"{RECS_TITLE}\n\n"), body).alias("body"))


def requested(requests: DataFrame) -> DataFrame:
    """Requests with parsed intents and the identifiers named in the text or the reply."""
    return requests.select(
        "update_id",
        F.col("chat_id").cast("long").alias("chat_id"),
        reply_intents("reply_json").alias("intents"),
        F.sort_array(F.array_union(ids_in_text("text"), reply_ids("reply_json"))).alias("asked"),
    )


def resolve_scope(requests: DataFrame, portfolio: DataFrame) -> DataFrame:
    """``update_id, chat_id, intents, inside, outside, outcome, notice`` for a whole table of requests.

    Outcomes: ``empty`` (chat without clients), ``whole`` (no client named), ``subset`` (some named clients belong to
    the chat), ``fallback`` (none does). Membership is tested on the portfolio itself.
    """
    asked = requested(requests)
    owned = owners(portfolio).withColumnRenamed("chat_id", "owner")
    chats = owned.select("owner").distinct().withColumn("known", F.lit(True))
    named = asked.select("update_id", "chat_id", F.explode("asked").alias("client_id")).distinct()
    tested = named.join(
        owned.withColumn("owns", F.lit(True)),
        (named.client_id == owned.client_id) & (named.chat_id == owned.owner),
        "left",
    ).select("update_id", named.client_id, F.coalesce("owns", F.lit(False)).alias("owns"))
    # lists are no longer than the ids of one request
    split = tested.groupBy("update_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("owns"), F.col("client_id")))).alias("inside"),
        F.sort_array(F.collect_list(F.when(~F.col("owns"), F.col("client_id")))).alias("outside"),
    )
    none = F.array().cast("array<string>")
    joined = (
        asked.join(split, "update_id", "left")
        .join(chats, F.col("chat_id") == F.col("owner"), "left")
        .withColumns({"inside": F.coalesce("inside", none), "outside": F.coalesce("outside", none)})
    )
    outcome = (
        F.when(F.col("known").isNull(), "empty")
        .when(F.size("asked") == 0, "whole")
        .when(F.size("inside") > 0, "subset")
        .otherwise("fallback")
    )
    before, after = SOME_OUTSIDE
    notice = (
        F.when(F.col("outcome") == "empty", NO_CLIENTS)
        .when(
            (F.col("outcome") == "subset") & (F.size("outside") > 0),
            F.concat(F.lit(before), F.array_join("outside", ", "), F.lit(after)),
        )
        .when(F.col("outcome") == "fallback", ALL_OUTSIDE)
    )
    scoped = joined.withColumn("outcome", outcome).withColumn("notice", notice)
    return scoped.select("update_id", "chat_id", "intents", "inside", "outside", "outcome", "notice")


def answer(
    requests: DataFrame, positives: DataFrame, reasons: DataFrame, portfolio: DataFrame, names: DataFrame
) -> DataFrame:
    """``update_id, chat_id, section, part_no, body``: the messages that answer each request, in order.

    Section 0 is the notice, 1 the recommendations, 2 the reasons. Every text is built once per client or chat and
    joined to the requests that need it.
    """
    scope = materialize(resolve_scope(requests, portfolio), "scope")
    positives, reasons = normalised(positives), normalised(reasons)
    ids = ["update_id", "chat_id"]
    whole, subset = F.col("outcome").isin("whole", "fallback"), F.col("outcome") == "subset"
    recs, why = F.array_contains("intents", "recs"), F.array_contains("intents", "razones")
    clients = scope.filter(subset).select(*ids, "intents", F.posexplode("inside").alias("i", "client_id"))
    # texts are only built for the chats and clients somebody asked about
    chats = owners(portfolio).join(scope.filter(whole & recs).select("chat_id").distinct(), "chat_id", "left_semi")
    wanted = positives.join(clients.select("client_id").distinct(), "client_id", "left_semi")

    notices = scope.filter(F.col("notice").isNotNull()).select(
        *ids, F.lit(0).alias("section"), F.lit(1).alias("part_no"), F.col("notice").alias("body")
    )
    # the texts are read once, each for all requests of its chat, so that equal ones lie together where answers are written
    asking = scope.filter(whole & recs).select(*ids)
    messages = portfolio_messages(positives, chats)
    section = F.lit(1).alias("section")
    chat_recs = messages.join(asking, "chat_id").select(*ids, section, "part_no", "body")
    no_recs = asking.join(messages.select("chat_id").distinct(), "chat_id", "left_anti").select(
        *ids, section, F.lit(1).alias("part_no"), F.lit(NO_RECS).alias("body")
    )
    chat_reasons = scope.filter(whole & why).select(
        *ids, F.lit(2).alias("section"), F.lit(1).alias("part_no"), general_text(reasons, names).scalar().alias("body")
    )

    def per_client(section: int, wanted: Column, blocks: DataFrame, title: str, none: str) -> DataFrame:
        found = clients.filter(wanted).join(blocks, "client_id", "left")
        some = found.filter(F.col("block").isNotNull()).select(
            *ids,
            F.lit(section).alias("section"),
            (F.col("i") + 1).alias("part_no"),
            F.concat(F.lit(title), "block").alias("body"),
        )
        nothing = found.groupBy(*ids).agg(F.count("block").alias("n")).filter(F.col("n") == 0)
        return some.unionByName(
            nothing.select(*ids, F.lit(section).alias("section"), F.lit(1).alias("part_no"), F.lit(none).alias("body"))
        )

    client_recs = per_client(1, recs, recommendation_blocks(wanted), f"{RECS_TITLE}\n\n", NO_RECS)
    client_reasons = per_client(2, why, personal_blocks(wanted, reasons), "", NO_PERSONAL)
    out = notices
    for part in (chat_recs, no_recs, chat_reasons, client_recs, client_reasons):
        out = out.unionByName(part)
    return out
