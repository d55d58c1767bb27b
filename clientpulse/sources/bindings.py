"""The driver's test tables shaped as the engine's input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The currency codes of the bound transaction table.
CURRENCIES = (1, 2, 3)
PRODUCTS = (1, 3, 4)


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trx(spark: SparkSession, sf: str) -> DataFrame:
    items, orders = raw(spark, sf, "lineitem"), raw(spark, sf, "orders")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderdate").alias("event_time"),
        F.col("o_orderpriority").alias("event_type"),
        F.col("o_orderstatus").alias("event_subtype"),
        F.nullif("l_linenumber", F.lit(7)).alias("currency"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_linestatus").alias("src_type11"),
        F.nullif("l_returnflag", F.lit("N")).alias("dst_type11"),
        F.col("l_linestatus").alias("dst_type12"),
    )


def purchase(spark: SparkSession, sf: str) -> DataFrame:
    # The order priorities that stand for the four products.
    priorities = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
    last = F.to_date(F.max("o_orderdate"))
    return (
        raw(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("client_id"), F.trunc("o_orderdate", "month").alias("mon"))
        .agg(
            *[
                F.max(F.when(F.col("o_orderpriority") == p, 1).otherwise(0)).alias(f"target_{k}")
                for k, p in enumerate(priorities, 1)
            ],
            F.count(F.lit(1)).alias("trans_count"),
            F.datediff(F.last_day(last), last).cast("long").alias("diff_trans_date"),
        )
    )


def geo(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.md5("props")
    return raw(spark, sf, "events").select(
        F.col("user_id").alias("client_id"),
        F.col("ts").alias("event_time"),
        *[F.substring(cell, 1, p - 3).alias(f"geohash_{p}") for p in (4, 5, 6)],
    )


def dialog(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf, "embeddings").select(
        F.col("label").alias("client_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(vec_id * 6 as int))").alias("event_time"),
        F.expr("transform(embedding, x -> cast(x as double) * (1 + vec_id % 7))").alias("embedding"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when((F.col("o_totalprice") > 250000) != (F.col("o_orderkey") % 5 == 0), 1).otherwise(0).alias("y_true"),
        F.least(F.floor(F.col("o_totalprice") / 5000) / 100, F.lit(1.0)).cast("double").alias("y_score"),
        F.col("o_orderpriority").alias("model"),
    )


def feat(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("f_qty"),
        F.pow(F.col("l_extendedprice") / 1000, F.lit(3)).alias("f_skew"),
        F.nullif("l_discount", F.lit(0.0)).alias("f_disc"),
        F.lit(0.0).alias("f_const"),
        F.col("l_extendedprice").alias("f_price"),
        F.col("l_tax").alias("f_tax"),
        F.nullif("l_returnflag", F.lit("N")).alias("c_flag"),
        F.col("l_linestatus").alias("c_stat"),
        (F.col("l_quantity") + F.when(F.col("l_returnflag") == "R", 10).otherwise(0) > 30).cast("int").alias("target"),
    )


def portfolio(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf, "customer").select(
        F.md5(F.col("c_custkey").cast("string")).alias("client_id"), F.col("c_nationkey").cast("long").alias("chat_id")
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per client and product; the score is the share of the client's months with that purchase."""
    shares = (
        purchase(spark, sf)
        .groupBy("client_id")
        .agg(F.max("mon").alias("mon"), *[F.avg(f"target_{k}").alias(str(k)) for k in PRODUCTS])
    )
    long = shares.unpivot(["client_id", "mon"], [str(k) for k in PRODUCTS], "product_id", "prob")
    return long.select(
        "mon",
        F.md5(F.col("client_id").cast("string")).alias("client_id"),
        F.col("product_id").cast("int").alias("product_id"),
        F.concat(F.lit("product_"), "product_id").alias("name_product"),
        "prob",
        (F.col("prob") > 0.25).cast("int").alias("pred"),
    )


def client_features(spark: SparkSession, sf: str) -> DataFrame:
    """One feature row per client, the input of the contribution operators."""
    return (
        purchase(spark, sf)
        .groupBy("client_id")
        .agg(
            F.avg("trans_count").alias("trans_count"),
            F.avg("diff_trans_date").alias("diff_trans_date"),
            F.count(F.lit(1)).cast("double").alias("months_active"),
            F.avg("target_2").alias("share_product_2"),
        )
        .withColumn("client_id", F.md5(F.col("client_id").cast("string")))
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as chat requests: some name clients, some come with a parsed reply, some of those are broken."""
    turns = raw(spark, sf, "conversations").filter(F.col("role") == "user")
    first, second = F.md5((F.col("u") % 1500).cast("string")), F.md5((F.col("u") % 1000 + 7).cast("string"))
    kind = F.col("u") % 7
    return turns.withColumn("u", F.col("conv_id") * 100 + F.col("turn")).select(
        F.col("u").alias("update_id"),
        (F.col("conv_id") % 25).alias("chat_id"),
        F.when(kind == 0, F.lit(None))
        .when(kind.isin(1, 2), F.col("text"))
        .when(kind == 3, F.concat("text", F.lit(" "), F.upper(first)))
        .when(kind == 4, F.concat_ws(" ", F.lit("clientes"), first, F.lit("y"), second))
        .otherwise(F.concat("text", F.lit(" 0123456789abcdef0")))
        .alias("text"),
        F.when(kind == 1, F.lit('{"intents": ["razones", "recs", "razones", "otros"]}'))
        .when(kind == 2, F.lit("{not json"))
        .when(kind == 3, F.lit('{"intent": "razones", "client_ids": []}'))
        .when(kind == 4, F.concat(F.lit('{"intents": ["recs", "razones"], "client_ids": [" '), F.upper(second), F.lit('"]}')))
        .when(kind == 5, F.concat(F.lit('{"intents": "razones", "client_ids": ["'), first, F.lit('"]}')))
        .alias("reply_json"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(u as decimal(18,6)))").alias("received_at"),
    )
