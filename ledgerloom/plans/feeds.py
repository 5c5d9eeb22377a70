"""The driver's tables as raw rows of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import remap
from ..sources.scratch import spread


def events_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as competing, out-of-order assertions; every 23rd row comes twice.

    Some rows turn the sign, repeat large round amounts on two days, move the date back by
    200 or 400 days, or share their time with others, so that every rule meets its case.
    """
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props"))
    k = F.get_json_object("props", "$.k").cast("long")
    i = F.col("event_id")
    action = F.when(F.col("event_type").isin("signup", "purchase"), "create").when(F.col("event_type") == "error", "delete").otherwise("update")
    out = e.withColumn("k", k).withColumn("act", action)
    text = lambda c: c.cast("string")
    value = F.when(i % 19 == 0, F.lit(10000) + i % 3 * 1000).when(i % 11 == 0, -F.col("value")).otherwise(F.col("value"))
    day = F.date_add(F.col("ts").cast("date"), (F.col("k") % 7).cast("int"))
    day = F.when(i % 19 == 0, F.date_add(F.lit("2024-01-02").cast("date"), (i % 2).cast("int"))).when(i % 58 == 0, F.date_add("ts", -400).cast("date")).when(i % 29 == 0, F.date_add("ts", -200).cast("date")).otherwise(day)
    said = F.when(i % 5 == 0, F.date_trunc("month", "ts")).otherwise(F.col("ts"))
    out = out.select(
        ((i * 7919) % 10007 * 1_000_000_000 + i * 2).alias("seq"), F.lit("feed").alias("origin"), text(F.col("user_id")).alias("user_id"),
        F.concat(F.lit("T"), text(F.col("k") % 20)).alias("transaction_id"), F.col("act").alias("action"),
        F.element_at(F.array(*map(F.lit, ("user_edit", "third_party", "bank_sync", "unknown"))), (i % 4 + 1).cast("int")).alias("source"),
        F.date_format(said, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("event_ts"),
        F.when((F.col("act") == "create") | ((F.col("act") == "update") & (i % 3 != 0)), text(value.cast("decimal(18,2)"))).alias("amount"),
        F.when(i % 10 == 0, "JPY").when(i % 10 == 1, "KWD").otherwise("USD").alias("currency"),
        F.when(~((F.col("act") == "update") & (i % 5 == 0)), text(day)).alias("date"),
        F.when(i % 4 != 0, F.concat(F.lit("M"), text(i % 5))).alias("merchant"), F.when(i % 4 != 0, F.concat(F.lit("C"), text(i % 3))).alias("category"),
        F.when(i % 13 == 0, F.concat(F.lit("T"), text((F.col("k") + 1) % 20))).alias("parent_transaction_id"), F.when(i % 17 == 0, "premium").alias("role"),
        F.concat(F.lit("e"), text(i)).alias("event_id"), F.when(i % 23 == 0, 2).otherwise(1).alias("copies"),
    )
    # A second copy arrives right after the first.
    twice = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return remap(twice.withColumn("seq", F.col("seq") + F.col("copy")).drop("copy", "copies"))


def orders_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as bank-sync creates."""
    o = spread(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return remap(o.select(
        F.col("o_orderkey").alias("seq"), F.lit("orders").alias("origin"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderkey").cast("string").alias("transaction_id"),
        F.lit("create").alias("action"), F.lit("bank_sync").alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("event_ts"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("USD").alias("currency"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("event_id"),
    ))
