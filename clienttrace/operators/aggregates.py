"""Per-client aggregates.

Everything that can be combined map side is; only exact medians and the
half-way trend need an order, and both go through ``ordered_rank``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clienttrace.functions.scalars import div_floor, pct_floor
from clienttrace.operators.events import time_kind
from clienttrace.operators.ranks import exact_median, join_groups
from clienttrace.operators.sequences import order_events
from clienttrace.session import written

FEATURES = ("n_tx", "mean_amt", "std_amt", "median_amt", "n_mcc")


def amount_size() -> Column:
    return F.abs(F.col("amount"))


def category_counts(events: DataFrame, category: str = "category") -> DataFrame:
    """``cnt`` and ``share`` of every category of a client."""
    counts = events.groupBy("customer_id", category).agg(F.count(F.lit(1)).alias("cnt"))
    whole = F.sum("cnt").over(Window.partitionBy("customer_id"))
    return counts.withColumn("share", F.col("cnt") / whole)


def event_columns(events: DataFrame) -> list[str]:
    """The columns events are ordered by."""
    return [c for c in ("time", "tie") if c in events.columns]


def kept(events: DataFrame, *names: str) -> DataFrame:
    """Clients, amounts and the named columns, written once for what reads them several times."""
    return written(events.select(*dict.fromkeys(["customer_id", "amount", *names])), "events")


def client_features(events: DataFrame, category: str = "category") -> DataFrame:
    """Count, mean, population std and exact median of |amount|, distinct categories.

    With the distinct count Spark combines the other measures per (client,
    category) before and after the first shuffle, so a hot client moves at
    most one row per category and task. Clients without any amount stay, with
    null amounts.
    """
    events = kept(events, category)
    stats = events.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_tx"), F.avg(amount_size()).alias("mean_amt"),
        F.stddev_pop(amount_size()).alias("std_amt"), F.count_distinct(category).alias("n_mcc"))
    medians = exact_median(events, ["customer_id"], amount_size(), "median_amt")
    return join_groups(stats, medians, ["customer_id"], "left").select("customer_id", *FEATURES)


def client_features_small(events: DataFrame, category: str = "category") -> DataFrame:
    """The three-column variant: count, mean |amount|, distinct categories."""
    return events.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_tx"), F.avg(amount_size()).alias("mean_amt"),
        F.count_distinct(category).alias("n_mcc"))


def activity_span(events: DataFrame, mode: str = "calendar", rate_floor: int = 0) -> DataFrame:
    """``days_span``, ``months`` and ``per_month`` of a client.

    ``calendar`` counts day boundaries between first and last event,
    ``elapsed`` whole days of elapsed time. ``rate_floor`` 1 keeps the monthly
    rate from showing 0.
    """
    span = events.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_tx"), F.min("time").alias("_first"), F.max("time").alias("_last"))
    return (span.withColumns(span_columns(F.col("n_tx"), F.col("_first"), F.col("_last"),
                                          time_kind(events), mode, rate_floor))
            .drop("_first", "_last"))


def span_columns(n: Column, first: Column, last: Column, kind: str, mode: str = "calendar",
                 rate_floor: int = 0) -> dict[str, Column]:
    if kind == "days":
        days = F.floor(last) - F.floor(first) if mode == "calendar" else F.floor(last - first)
    elif mode == "calendar":
        days = F.datediff(last.cast("date"), first.cast("date"))
    else:
        days = F.floor(F.timestamp_diff("SECOND", first, last) / 86400)
    days = days.cast("long")
    months = F.greatest(F.lit(1), div_floor(days, F.lit(30)))
    rate = div_floor(n, months)
    return {"days_span": days, "months": months,
            "per_month": F.greatest(F.lit(rate_floor), rate) if rate_floor else rate}


def hour_of(events: DataFrame) -> Column:
    """Hour 0-23 of a timestamp or of the fraction of a day number."""
    if time_kind(events) == "days":
        return F.floor((F.col("time") - F.floor("time")) * 24).cast("int")
    return F.hour("time")


def day_part_share(events: DataFrame, hour: Column | None = None) -> DataFrame:
    """Percent of events in [9, 18) and in [18, 23)."""
    h = hour_of(events) if hour is None else hour
    return events.groupBy("customer_id").agg(*day_share_columns(h))


def day_share_columns(h: Column) -> list[Column]:
    def share(low: int, high: int, name: str) -> Column:
        inside = F.coalesce(((h >= low) & (h < high)).cast("int"), F.lit(0))
        return (F.avg(inside) * 100).alias(name)
    return [share(9, 18, "daytime_pct"), share(18, 23, "evening_pct")]


def day_part_counts(events: DataFrame, hour: Column | None = None) -> DataFrame:
    """Events in the morning, afternoon, evening and night; null hours dropped."""
    h = hour_of(events) if hour is None else hour
    return events.groupBy("customer_id").agg(*day_count_columns(h))


def day_count_columns(h: Column) -> list[Column]:
    return [F.count_if((h >= 6) & (h < 12)).alias("morning"),
            F.count_if((h >= 12) & (h < 18)).alias("afternoon"),
            F.count_if((h >= 18) & (h < 23)).alias("evening"),
            F.count_if((h >= 23) | (h < 6)).alias("night")]


def money_flow(events: DataFrame) -> DataFrame:
    """Counts and totals spent and received; the ratio only if both are positive."""
    return events.groupBy("customer_id").agg(*flow_columns()).withColumn("spend_income_ratio", flow_ratio())


def flow_columns() -> list[Column]:
    a = F.col("amount")
    return [F.count_if(a < 0).alias("n_spend"),
            F.abs(F.sum(F.when(a < 0, a).otherwise(0.0))).alias("total_spend"),
            F.count_if(a > 0).alias("n_income"),
            F.sum(F.when(a > 0, a).otherwise(0.0)).alias("total_income")]


def flow_ratio() -> Column:
    both = (F.col("total_spend") > 0) & (F.col("total_income") > 0)
    return F.when(both, F.col("total_spend") / F.col("total_income"))


def size_bands(events: DataFrame, small: float = 500, large: float = 5000) -> DataFrame:
    """Whole percent of amounts below ``small`` and above ``large``."""
    counts = events.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"), *band_columns(small, large))
    return counts.select("customer_id", pct_floor(F.col("n_small"), F.col("_n")).alias("small_pct"),
                         pct_floor(F.col("n_large"), F.col("_n")).alias("large_pct"))


def band_columns(small: float, large: float) -> list[Column]:
    return [F.count_if(amount_size() < small).alias("n_small"), F.count_if(amount_size() > large).alias("n_large")]


def amount_range(events: DataFrame) -> DataFrame:
    return events.groupBy("customer_id").agg(F.min(amount_size()).alias("min_amt"), F.max(amount_size()).alias("max_amt"))


def category_diversity(events: DataFrame, category: str = "category", mode: str = "categories") -> DataFrame:
    """Distinct categories, or (``distinct_counts``) how many different counts they have."""
    counts = events.groupBy("customer_id", category).agg(F.count(F.lit(1)).alias("cnt"))
    value = F.count(category) if mode == "categories" else F.count_distinct("cnt")
    return counts.groupBy("customer_id").agg(value.alias("diversity"))


def top_categories(events: DataFrame, k: int = 6, category: str = "category") -> DataFrame:
    """The ``k`` most frequent categories of a client with rank, count and percent.

    Equal counts are ordered by category. A client has one row per category
    here, whatever its number of events.
    """
    w = Window.partitionBy("customer_id")
    return (category_counts(events, category)
            .withColumn("n_tx", F.sum("cnt").over(w))
            .withColumn("place", F.row_number().over(w.orderBy(F.col("cnt").desc(), F.col(category))))
            .where(F.col("place") <= k)
            .withColumn("pct", pct_floor(F.col("cnt"), F.col("n_tx")))
            .drop("share"))


def distinct_types(events: DataFrame, kind: str, k: int = 5) -> DataFrame:
    """Number of transaction types and the text of the most frequent ``k``."""
    counts = events.groupBy("customer_id", kind).agg(F.count(F.lit(1)).alias("cnt"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("c"), F.col(kind).alias("t"))))
    return (counts.where(F.col(kind).isNotNull())
            .groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_types"), ordered.alias("_types"))
            .select("customer_id", "n_types",
                    F.array_join(F.transform(F.slice("_types", 1, k), lambda x: F.concat(
                        F.lit("type_"), x["t"].cast("string"), F.lit(": "), (-x["c"]).cast("string"))), ", ")
                    .alias("top_types")))


def half_means(events: DataFrame) -> DataFrame:
    """Mean |amount| of a client's first ``n // 2`` events and of the rest."""
    ranked = order_events(events.select("customer_id", "amount", *event_columns(events)), "_no", "_n")
    early = F.col("_no") <= F.floor(F.col("_n") / 2)
    return ranked.groupBy("customer_id").agg(
        F.avg(F.when(early, amount_size())).alias("first_half"), F.avg(F.when(~early, amount_size())).alias("second_half"))


def trend_columns(mode: str = "ratio") -> dict[str, Column]:
    """``trend`` (and ``change``) of two half means, see ``half_trend``."""
    # The last bits of a mean depend on the order of addition; drop them so a
    # change of exactly 10 percent stays on one side.
    first, second = F.round("first_half", 6), F.round("second_half", 6)
    if mode == "ratio":
        high, low = F.round(first * 1.1, 6), F.round(first * 0.9, 6)
        return {"trend": F.when(second > high, "increasing").when(second < low, "decreasing").otherwise("stable")}
    relative = F.when(first > 0, F.round((second - first) / first, 9))
    change = F.when(F.abs(relative) > 0.1, relative)
    return {"change": change, "trend": F.when(change > 0, "increasing").when(change < 0, "declining")}


def half_trend(events: DataFrame, mode: str = "ratio") -> DataFrame:
    """Mean |amount| of the first ``n // 2`` events against the rest.

    ``ratio``: increasing above 1.1 times, decreasing below 0.9 times, else
    stable (one event: stable). ``change``: the relative change and its
    direction only beyond 10 percent, from a first half above 0.
    """
    return half_means(events).withColumns(trend_columns(mode))


def class_distribution(df: DataFrame, classes: Sequence[int], target: str = "target") -> DataFrame:
    """Rows per class; classes without rows count 0."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    listed = df.sparkSession.createDataFrame([(c,) for c in classes], f"{target} int")
    return (listed.join(counts, target, "left")
            .select(target, F.coalesce(F.col("_n"), F.lit(0)).alias("cnt")))


def positive_rate(labels: DataFrame, target: str = "target") -> DataFrame:
    return labels.agg(F.avg(F.col(target).cast("double")).alias("rate"), F.count(F.lit(1)).alias("clients"))


def text_length_stats(df: DataFrame, text: str = "text") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.length(text)).alias("avg_length"))
