"""Category encoding and ordered per-client sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clienttrace.functions.scalars import fill_category
from clienttrace.operators.events import event_order, time_kind
from clienttrace.operators.ranks import bucketed_rank, ordered_rank

#: Events of a client in one row of sequences.
CHUNK_EVENTS = 1_000_000


def category_codes(df: DataFrame, column: str, fill: str | int = "UNK") -> DataFrame:
    """``(value, index)``: distinct string values numbered from 1 in ascending order.

    0 stays free for padding. Only distinct values are ranked, in slices of
    equal two-character prefixes.
    """
    values = df.select(fill_category(F.col(column), fill).cast("string").alias("value")).distinct()
    return (bucketed_rank(values, [], F.substring("value", 1, 2), [F.col("value")], "_rank", "_size")
            .select("value", F.col("_rank").cast("int").alias("index")))


def encode_category(df: DataFrame, column: str, out: str | None = None, fill: str | int = "UNK",
                    codes: DataFrame | None = None) -> DataFrame:
    """Adds the 1-based index of a categorical column, fitted on all rows."""
    codes = category_codes(df, column, fill) if codes is None else codes
    keyed = df.withColumn("_value", fill_category(F.col(column), fill).cast("string"))
    return (keyed.join(codes.select(F.col("value").alias("_value"), F.col("index").alias(out or f"{column}_index")),
                       "_value")
            .drop("_value"))


def category_dimension(df: DataFrame, columns: Sequence[str], fill: str | int = "UNK") -> DataFrame:
    """``(column, dimension)``: distinct filled values + 2, in one pass."""
    filled = F.array(*[F.struct(F.lit(c).alias("column"),
                                fill_category(F.col(c), fill).cast("string").alias("value")) for c in columns])
    return (df.select(F.inline(filled)).distinct()
            .groupBy("column").agg((F.count(F.lit(1)) + 2).alias("dimension")))


def days_between(start: Column, end: Column, kind: str) -> Column:
    """Elapsed days with fraction, for timestamps or day numbers."""
    if kind == "days":
        return end.cast("double") - start.cast("double")
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(86400e6)


def order_events(events: DataFrame, rank: str = "event_no", size: str = "n_events") -> DataFrame:
    """Adds the 1-based position of each event of a client and the event count."""
    return ordered_rank(events, ["customer_id"], event_order(events), rank, size)


def event_time_since_first(events: DataFrame, out: str = "event_time") -> DataFrame:
    """Adds the days since the client's first event."""
    first = events.groupBy("customer_id").agg(F.min("time").alias("_first"))
    since = days_between(F.col("_first"), F.col("time"), time_kind(events))
    return events.join(first, "customer_id").withColumn(out, since.cast("float")).drop("_first")


def last_events(events: DataFrame, k: int) -> DataFrame:
    """The last ``k`` events of every client.

    Each task keeps its own last ``k`` per client before the shuffle, so a hot
    client never arrives whole.
    """
    latest = [c.desc() for c in event_order(events)]
    return (events.withColumn("_from_end", F.row_number().over(Window.partitionBy("customer_id").orderBy(*latest)))
            .where(F.col("_from_end") <= k).drop("_from_end"))


def build_sequences(events: DataFrame, arrays: Sequence[str], labels: DataFrame | None = None,
                    minimum: int = 1, chunk_events: int = CHUNK_EVENTS) -> DataFrame:
    """Client records: time-ordered parallel arrays of equal length.

    Result: ``customer_id, chunk, [target,] event_time`` (days since the first
    event) and one array per name in ``arrays``. A client with up to
    ``chunk_events`` events is one row (chunk 0); a longer history continues in
    further chunks, so no event is dropped and no row grows without bound.
    """
    if labels is not None:
        events = events.join(labels.select("customer_id"), "customer_id", "left_semi")
    kind = time_kind(events)
    order = [c for c in ("time", "tie") if c in events.columns]
    needed = dict.fromkeys(["customer_id", *order, *arrays])
    placed = order_events(events.select(*needed), "_no", "_n").where(F.col("_n") >= minimum)
    # Clients of several chunks are few: at most rows / chunk_events.
    starts = F.broadcast(placed.where((F.col("_no") == 1) & (F.col("_n") > chunk_events)).select(
        "customer_id", F.col("time").alias("_start")))
    records = (placed.groupBy("customer_id", F.floor((F.col("_no") - 1) / chunk_events).alias("chunk"))
               .agg(F.sort_array(F.collect_list(F.struct(*order, *arrays))).alias("_items"))
               .join(starts, "customer_id", "left")
               .select("customer_id", "chunk", F.coalesce("_start", F.col("_items")[0]["time"]).alias("_first"), "_items"))

    def column(name: str) -> Column:
        return F.transform("_items", lambda x: x[name]).alias(name)

    since = F.transform("_items", lambda x: days_between(F.col("_first"), x["time"], kind).cast("float"))
    records = records.select(
        "customer_id", "chunk", since.alias("event_time"), *[column(name) for name in arrays])
    if labels is not None:
        records = records.join(labels.select("customer_id", "target"), "customer_id")
    return records


def sample_slices(records: DataFrame, arrays: Sequence[str], split_count: int = 5, cnt_min: int = 15,
                  cnt_max: int = 75, seed: int = 42) -> DataFrame:
    """``split_count`` random contiguous sub-sequences per client.

    Length is drawn from [cnt_min, min(cnt_max, n)] and the start evenly from
    what then fits, both from md5 of (client, slice, seed). Clients with fewer
    than ``cnt_min`` events give their whole sequence. Positions are those of
    the whole history: a slice that lies across chunks is put together from
    them (at most ``cnt_max`` events).
    """
    keys = [c for c, kind in records.dtypes if not kind.startswith("array") and c != "chunk"]
    by_client = Window.partitionBy("customer_id")
    n, before = F.col("_n"), F.col("_before")
    placed = records.select(*keys, "chunk", *arrays).withColumns({
        "_here": F.size(arrays[0]), "_n": F.sum(F.size(arrays[0])).over(by_client),
        "_before": F.coalesce(F.sum(F.size(arrays[0])).over(
            by_client.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})

    def draw(purpose: str) -> Column:
        text = F.concat_ws("-", F.col("customer_id"), F.lit(0), F.col("slice_no"), F.lit(f"{purpose}-{seed}"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")

    low, high = F.least(F.lit(cnt_min), n), F.least(F.lit(cnt_max), n)
    first = F.greatest(F.col("slice_start"), before + 1)
    last = F.least(F.col("slice_start") + F.col("slice_length") - 1, before + F.col("_here"))
    pieces = (placed.withColumn("slice_no", F.explode(F.sequence(F.lit(1), F.lit(split_count))))
              .withColumn("slice_length", (low + draw("length") % (high - low + 1)).cast("int"))
              .withColumn("slice_start", (1 + draw("start") % (n - F.col("slice_length") + 1)).cast("int"))
              .withColumns({"_first": (first - before).cast("int"), "_last": (last - before).cast("int")})
              .where((F.col("_first") <= F.col("_last")) | (n == 0))
              .withColumns({a: F.slice(a, F.col("_first"), F.col("_last") - F.col("_first") + 1) for a in arrays}))
    parts = pieces.groupBy(*keys, "slice_no", "slice_length", "slice_start").agg(
        F.sort_array(F.collect_list(F.struct("chunk", *arrays))).alias("_parts"))
    return parts.withColumns({a: F.flatten(F.col("_parts")[a]) for a in arrays}).drop("_parts")
