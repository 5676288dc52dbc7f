"""The given tables under event-table roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clienttrace.functions.codes import SHORT, classify_code
from clienttrace.operators.events import rename_roles
from clienttrace.spec import EventSpec

CLICK_SPEC = EventSpec("user_id", "ts", "amount", "event_type", "code", ("event_id",))
ORDER_SPEC = EventSpec("o_custkey", "l_shipdate", "amount", "p_type", "code",
                       ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``: purchases and errors are negative amounts."""
    source = table(spark, sf_dir, "events")
    negative = F.col("event_type").isin("purchase", "error")
    return rename_roles(source.withColumns({
        "amount": F.when(negative, -F.col("value")).otherwise(F.col("value")),
        "code": 1 + (F.col("event_id") * 7919) % 9999}), CLICK_SPEC)


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with its customer and part type: returns are negative amounts."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    price = F.col("l_extendedprice")
    joined = (items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
              .join(parts, items["l_partkey"] == parts["p_partkey"]))
    return rename_roles(joined.withColumns({
        "amount": F.when(F.col("l_returnflag") == "R", -price).otherwise(price),
        "code": 1 + (F.col("l_partkey") * 7919) % 9999}), ORDER_SPEC)


def with_merchant(events: DataFrame, ranges=SHORT, **options) -> DataFrame:
    return events.withColumn("merchant", classify_code(F.col("code"), ranges, **options))


def click_labels(spark: SparkSession, sf_dir: str, classes: int = 2) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("customer_id")).distinct()
    return users.withColumn("target", (F.col("customer_id") % classes).cast("int"))


def customer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("target"))


def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("target"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("customer_id"), "embedding", F.col("label").alias("target"),
        (F.col("label") >= 5).cast("int").alias("binary_target"))
