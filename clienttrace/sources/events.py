"""Reading event and label tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clienttrace.operators.events import rename_roles
from clienttrace.spec import EventSpec

# Columns of the bank data sets.
GENDER_EVENTS = "customer_id bigint, tr_datetime string, mcc_code int, tr_type int, amount double, term_id string"
GENDER_LABELS = "customer_id bigint, gender int"
CHURN_EVENTS = ("PERIOD string, cl_id bigint, MCC int, channel_type string, currency string, TRDATETIME string, "
                "amount double, trx_category string, target_flag int, target_sum double")
AGE_EVENTS = "client_id bigint, trans_date int, small_group int, amount_rur double"
AGE_LABELS = "client_id bigint, bins int"
GENDER_SPEC = EventSpec("customer_id", "time", "amount", "tr_type", "mcc_code", ("mcc_code", "tr_type", "amount"))
CHURN_SPEC = EventSpec("cl_id", "time", "amount", "trx_category", "MCC",
                       ("MCC", "channel_type", "currency", "trx_category", "amount"))
AGE_SPEC = EventSpec("client_id", "trans_date", "amount_rur", "small_group", "small_group", ("small_group", "amount_rur"))


class MissingInput(FileNotFoundError):
    """An input table that has to be made first."""


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, or CSV with a header (plain or ``.gz``) under an explicit schema.

    CSV columns are matched by header name, so files may have them in any
    order or lack optional ones.
    """
    if not path.endswith((".csv", ".csv.gz")):
        return spark.read.parquet(path)
    if schema is None:
        raise ValueError("CSV is read with an explicit schema")
    wanted = {f.name: f for f in T.StructType.fromDDL(schema).fields}
    header = spark.read.option("header", True).csv(path).columns
    present = T.StructType([wanted.get(c, T.StructField(c, T.StringType())) for c in header])
    rows = spark.read.schema(present).option("header", True).csv(path)
    return rows.select(*[c for c in wanted if c in header])


def read_events(spark: SparkSession, path: str, spec: EventSpec, schema: str | None = None,
                derived: Mapping[str, object] | None = None) -> DataFrame:
    """An event table under its roles.

    ``derived`` adds columns (such as a parsed time) before roles are given. A
    gzip file is one unsplittable part and is spread by client after reading.
    """
    rows = read_table(spark, path, schema)
    if derived:
        rows = rows.withColumns(dict(derived))
    events = rename_roles(rows, spec)
    return events.repartition("customer_id", *[c for c in ("time",) if c in events.columns]) \
        if path.endswith(".gz") else events


def read_labels(spark: SparkSession, path: str, id_col: str, target_col: str, schema: str | None = None) -> DataFrame:
    rows = read_table(spark, path, schema)
    return rows.select(F.col(id_col).cast("long").alias("customer_id"), F.col(target_col).cast("int").alias("target"))


def require_inputs(spark: SparkSession, inputs: Mapping[str, str],
                   columns: Mapping[str, list[str]] | None = None) -> None:
    """Fails early, naming the missing input and what makes it.

    Works on any file system Spark reaches. ``columns`` also checks that a
    Parquet input has the columns needed.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path, origin in inputs.items():
        location = jvm.org.apache.hadoop.fs.Path(path)
        if not location.getFileSystem(conf).exists(location):
            raise MissingInput(f"missing input: {path}; made by: {origin}")
        for column in (columns or {}).get(path, []):
            if column not in spark.read.parquet(path).columns:
                raise MissingInput(f"input {path} lacks column {column}; made by: {origin}")
