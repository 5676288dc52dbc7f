"""Role mapping, label joins, filters and defaults on event tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clienttrace.spec import EventSpec


def rename_roles(df: DataFrame, spec: EventSpec) -> DataFrame:
    """Source columns under their role names.

    Result columns: ``customer_id, time, amount``, then ``category`` and
    ``code`` where the source has them, ``tie`` (a struct of the tie-break
    columns, ordered field by field) and the extra columns.
    """
    columns = [F.col(spec.customer_id).alias("customer_id"), F.col(spec.time).alias("time"),
               F.col(spec.amount).cast("double").alias("amount")]
    if spec.category and spec.category in df.columns:
        columns.append(F.col(spec.category).alias("category"))
    if spec.code and spec.code in df.columns:
        columns.append(F.col(spec.code).alias("code"))
    if spec.tie_break:
        columns.append(F.struct(*spec.tie_break).alias("tie"))
    return df.select(*columns, *spec.extra)


def event_order(df: DataFrame) -> list[Column]:
    """Sort columns that order a client's events totally."""
    return [F.col("time")] + ([F.col("tie")] if "tie" in df.columns else [])


def time_kind(df: DataFrame) -> str:
    return "days" if df.schema["time"].dataType.simpleString() in ("double", "float", "int", "bigint") else "timestamp"


def keep_labelled(events: DataFrame, labels: DataFrame, key: str = "customer_id") -> DataFrame:
    return events.join(labels.select(key), key, "left_semi")


def attach_target(df: DataFrame, labels: DataFrame, key: str = "customer_id", target: str = "target") -> DataFrame:
    return df.join(labels.select(key, target), key)


def min_events(events: DataFrame, n: int, key: str = "customer_id") -> DataFrame:
    """Events of the clients that have at least ``n``."""
    busy = events.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    return events.join(busy, key, "left_semi")


def left_with_default(ids: DataFrame, derived: DataFrame, defaults: Mapping[str, object],
                      key: str = "customer_id") -> DataFrame:
    """One row per id; ids without a derived row get the defaults."""
    joined = ids.join(derived, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def missing_ids(left: DataFrame, right: DataFrame, key: str = "customer_id") -> DataFrame:
    return left.select(key).join(right.select(key), key, "left_anti")


def align_by_id(left: DataFrame, right: DataFrame, key: str = "customer_id",
                require_complete: bool = True) -> DataFrame:
    """Two sources of columns joined by client.

    With ``require_complete`` an id of ``left`` that ``right`` lacks fails the
    job when the result is computed; no extra pass over the data.
    """
    if not require_complete:
        return left.join(right, key)
    found = right.withColumn("_found", F.lit(True))
    complete = F.assert_true(F.col("_found").isNotNull(), F.concat(F.lit(f"missing {key}: "), F.col(key).cast("string")))
    return (left.join(found, key, "left")
            .where(complete.isNull())
            .drop("_found"))


def labels_from_flags(events: DataFrame, flag: str, key: str = "customer_id") -> DataFrame:
    """A client's label is the largest flag on its rows."""
    return events.groupBy(key).agg(F.max(flag).alias("target"))


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def distinct_classes(*tables: DataFrame, target: str = "target") -> DataFrame:
    """Classes of several tables; each is made distinct before the union."""
    parts = [t.select(target).distinct() for t in tables]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.distinct()
