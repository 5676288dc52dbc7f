"""Readers, writers and end-to-end flows over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clienttrace.operators import models, prompts, sampling
from clienttrace.plans import flows
from clienttrace.plans.answer_queries import md5_scorer
from clienttrace.plans.registry import num, query, sql_num
from clienttrace.plans.roles import click_labels, clicks, table, vectors, with_merchant
from clienttrace.plans.sqltext import VECTORS, hash_order
from clienttrace.session import shared_folder
from clienttrace.sources import events as src
from clienttrace.sources import results as res
from clienttrace.spec import EventSpec


@query("csv_events", f"""
SELECT user_id AS customer_id, event_type AS category, count(*) AS n, {sql_num('sum(value)', 2)} AS amount,
  (max(user_id) % 2)::int AS target FROM events GROUP BY user_id, event_type""")
def csv_events(spark, sf_dir):
    """The event table written as CSV and read back under an explicit schema."""
    folder = shared_folder(spark, "csv") + ".csv"
    table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type", "ts").write.option(
        "header", True).csv(folder)
    spec = EventSpec("user_id", "ts", "value", "event_type", tie_break=("event_id",))
    events = src.read_events(spark, folder, spec,
                             "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    labels = src.read_labels(spark, folder, "user_id", "user_id", "user_id bigint").distinct()
    return (events.groupBy("customer_id", "category")
            .agg(F.count(F.lit(1)).alias("n"), num(F.sum("amount"), 2).alias("amount"))
            .join(labels.select("customer_id", (F.col("target") % 2).alias("target")), "customer_id"))


@query("embeddings_round_trip", f"""
WITH {VECTORS}, sp AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {hash_order('customer_id')}, customer_id)
    <= round(0.1 * count(*) OVER (PARTITION BY target)) AS is_test FROM vec)
SELECT customer_id, target, len(embedding)::int AS dim, {sql_num('embedding[1]', 6)} AS first, 'test' AS split
FROM sp WHERE is_test""")
def embeddings_round_trip(spark, sf_dir):
    """Vectors written per (dataset, seed, split) and one split read back."""
    folder = shared_folder(spark, "embeddings")
    split = sampling.stratified_split(vectors(spark, sf_dir))
    res.write_embeddings(split, folder, "given")
    src.require_inputs(spark, {folder: "write_embeddings"}, {folder: ["embedding"]})
    back = res.read_embeddings(spark, folder, "given", 42, "test")
    return back.select("customer_id", "target", F.size("embedding").alias("dim"),
                       num(F.element_at("embedding", 1), 6).alias("first"), "split")


@query("predictions_round_trip", """
SELECT customer_id, target, pred_label, pred_prob, f FROM (SELECT vec_id AS customer_id, (label >= 5)::int AS target,
  label AS pred_label, round(embedding[1]::double, 6) + 0.0 AS pred_prob FROM embeddings), (VALUES ('csv'), ('parquet')) t(f)""")
def predictions_round_trip(spark, sf_dir):
    """Predictions written as CSV and as Parquet, both read back."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("customer_id"), (F.col("label") >= 5).cast("int").alias("target"),
        F.col("label").cast("int").alias("pred_label"),
        (F.round(F.element_at("embedding", 1).cast("double"), 6) + 0.0).alias("pred_prob"), "embedding")
    out = None
    for fmt in ("csv", "parquet"):
        folder = shared_folder(spark, "predictions")
        res.write_predictions(rows, folder, fmt)
        schema = "customer_id bigint, target int, pred_prob double, pred_label int"
        back = spark.read.schema(schema).option("header", True).format(fmt).load(folder).withColumn("f", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


@query("metrics_round_trip", f"""
SELECT event_type AS model, count(*) AS n, {sql_num('avg(value)', 4)} AS mean FROM events GROUP BY event_type""")
def metrics_round_trip(spark, sf_dir):
    """A metric table written as CSV and read back."""
    folder = shared_folder(spark, "metrics")
    res.write_metrics(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(
        F.count("*").alias("n"), num(F.avg("value"), 4).alias("mean")), folder)
    return spark.read.schema("model string, n bigint, mean double").option("header", True).csv(folder)


def _client_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).select("customer_id", "embedding")


@query("flow_embeddings")
def flow_embeddings(spark, sf_dir):
    return flows.evaluate_embeddings(
        clicks(spark, sf_dir), click_labels(spark, sf_dir), seeds=(42, 123))


@query("flow_enrichment_grid")
def flow_enrichment_grid(spark, sf_dir):
    return flows.enrichment_grid(
        with_merchant(clicks(spark, sf_dir)), click_labels(spark, sf_dir), _client_vectors(spark, sf_dir), md5_scorer,
        prompts.GENDER, "md5", "merchant")


@query("flow_response_transfer")
def flow_response_transfer(spark, sf_dir):
    """The teacher sees all components, the student the first half; five seeds."""
    rows = vectors(spark, sf_dir)
    own = rows.select("customer_id", F.slice("embedding", 1, 32).alias("embedding"), F.col("binary_target").alias("target"))
    return flows.response_transfer(own, models.TEACHER_SHARE["gender"], seeds=(42, 123, 456, 789, 1024),
                                   teacher_table=rows.select("customer_id", "embedding"))
