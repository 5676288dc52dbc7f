"""Writing vectors, predictions, metrics and result records; resuming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Allowed tags of a result record.
TASK_TYPES = ("binary", "multiclass", "regression")
QUESTIONS = ("RQ1", "RQ2-D1", "RQ2-D2", "RQ3")


def write_embeddings(df: DataFrame, path: str, dataset: str, seed: int = 42, mode: str = "append") -> None:
    """Vectors with ids and targets per split, in one folder per (dataset, seed, split)."""
    (df.withColumn("dataset", F.lit(dataset)).withColumn("seed", F.lit(seed))
     .select("customer_id", "target", F.col("embedding").cast("array<float>").alias("embedding"),
             "dataset", "seed", "split")
     .write.mode(mode).partitionBy("dataset", "seed", "split").parquet(path))


def read_embeddings(spark: SparkSession, path: str, dataset: str, seed: int = 42,
                    split: str | None = None) -> DataFrame:
    """Reads them back; only the folders asked for are scanned."""
    rows = spark.read.parquet(path).where((F.col("dataset") == dataset) & (F.col("seed") == seed))
    return rows.where(F.col("split") == split) if split else rows


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """``customer_id, target`` and the prediction columns present."""
    columns = [c for c in ("run_id", "customer_id", "target", "pred_prob", "pred_label", "pred_class", "status")
               if c in df.columns]
    writer = df.select(*columns).write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_metrics(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def result_record(metrics: DataFrame, task_type: Column | str, question: Column | str,
                  fields: Mapping[str, Column], config: Mapping[str, str] | None = None,
                  artifacts: Mapping[str, str] | None = None, seed: int = 42, runtime_seconds: float = 0.0,
                  notes: str = "") -> DataFrame:
    """Validated result rows from a table with a ``metrics MAP<STRING, DOUBLE>`` column.

    ``fields`` gives experiment_id, method and dataset. A wrong task or
    question tag or an empty metric map fails the job.
    """
    task = F.lit(task_type) if isinstance(task_type, str) else task_type
    tag = F.lit(question) if isinstance(question, str) else question

    def allowed(value: Column, names: Sequence[str], what: str) -> Column:
        problem = F.raise_error(F.concat(F.lit(f"{what} must be one of {list(names)}, got "), value))
        return F.when(value.isin(*names), value).otherwise(problem.cast("string"))

    def as_map(entries: Mapping[str, str] | None) -> Column:
        items = [F.lit(str(x)) for pair in (entries or {}).items() for x in pair]
        return F.create_map(*items).cast("map<string,string>")

    filled = F.when(F.size("metrics") > 0, F.col("metrics")).otherwise(
        F.raise_error(F.lit("metrics must have at least one entry")).cast("map<string,double>"))
    return metrics.select(
        *[c.alias(n) for n, c in fields.items()],
        allowed(tag, QUESTIONS, "rq").alias("rq"), allowed(task, TASK_TYPES, "task_type").alias("task_type"),
        filled.alias("metrics"), as_map(config).alias("config"), F.lit(seed).alias("seed"),
        F.lit(metrics.sparkSession.version).alias("spark_version"), F.lit(runtime_seconds).alias("runtime_seconds"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp_utc"),
        as_map(artifacts).alias("artifacts"), F.lit(notes).alias("notes"))


def write_result(records: DataFrame, path: str, mode: str = "append") -> None:
    records.write.mode(mode).json(path)


def resume_scoring(todo: DataFrame, done: DataFrame, key: Sequence[str] = ("run_id", "customer_id")) -> DataFrame:
    """Rows not scored yet, by key rather than by count."""
    return todo.join(done.select(*key), list(key), "left_anti")


def skip_completed_cells(grid: DataFrame, results: DataFrame, key: Sequence[str] = ("tag",)) -> DataFrame:
    return grid.join(results.select(*key), list(key), "left_anti")
