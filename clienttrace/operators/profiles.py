"""Readable client profiles and event-history texts.

All profiles start from ``client_summary``: one row per (client, category),
combined map side, then merged to one row per client. Catalyst drops the
measures a profile does not print. Medians and trends, which need an order,
are joined on. A profile reads its events once, into a table of the columns it
needs, and works on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clienttrace.functions.scalars import (amount_direction, fmt0, fmt2, fmt_pct, fmt_signed_pct, pct_floor)
from clienttrace.operators.aggregates import (amount_size, band_columns, day_count_columns, day_share_columns,
                                              distinct_types, event_columns, flow_columns, flow_ratio, half_trend, hour_of,
                                              kept, span_columns)
from clienttrace.operators.events import event_order, left_with_default, time_kind
from clienttrace.operators.ranks import exact_median, join_groups
from clienttrace.operators.sequences import last_events

# Texts for clients without events.
NO_DATA = "No transaction data available."
NO_EVENTS = "No transactions."
NO_EVENTS_SHORT = "No txns."
UNKNOWN = "Unknown."


def client_summary(events: DataFrame, category: str = "category", hour: Column | None = None,
                   small: float = 500, large: float = 5000) -> DataFrame:
    """All measures the profiles print, one row per client.

    ``cats`` is the client's categories as ``STRUCT<c: -count, name>`` in
    printing order (most frequent first, ties by name).
    """
    h = hour_of(events) if hour is None else hour
    day_parts = day_count_columns(h)
    parts = events.groupBy("customer_id", category).agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount_size()).alias("sum_abs"),
        F.avg(amount_size()).alias("mean"), F.var_pop(amount_size()).alias("var"),
        F.min(amount_size()).alias("min_amt"), F.max(amount_size()).alias("max_amt"),
        F.min("time").alias("first"), F.max("time").alias("last"),
        F.count(h).alias("n_hours"), *day_parts,
        F.count_if((h >= 9) & (h < 18)).alias("daytime"),
        F.count_if((h >= 18) & (h < 23)).alias("late"),
        *flow_columns(), *band_columns(small, large))
    sums = ("n_hours", "morning", "afternoon", "evening", "night", "daytime", "late", "n_spend", "total_spend",
            "n_income", "total_income", "n_small", "n_large")
    named = F.when(F.col(category).isNotNull(), F.struct((-F.col("n")).alias("c"), F.col(category).alias("name")))
    merged = parts.groupBy("customer_id").agg(
        F.sum("n").alias("n_tx"),
        (F.sum("sum_abs") / F.sum("n")).alias("mean_amt"),
        F.sum(F.col("n") * F.col("var")).alias("_within"),
        F.collect_list(F.struct("n", "mean")).alias("_groups"),
        F.min("min_amt").alias("min_amt"), F.max("max_amt").alias("max_amt"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        *[F.sum(c).alias(c) for c in sums],
        F.sort_array(F.collect_list(named)).alias("cats"),
        F.count(category).alias("n_categories"))
    between = F.aggregate("_groups", F.lit(0.0),
                          lambda s, g: s + g["n"] * F.pow(g["mean"] - F.col("mean_amt"), F.lit(2.0)))
    return (merged.withColumn("std_amt", F.sqrt((F.col("_within") + between) / F.col("n_tx")))
            .withColumn("n_counts", F.size(F.array_distinct(F.transform("cats", lambda x: x["c"]))))
            .drop("_within", "_groups"))


def _text(*pieces: str | Column) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])


def _whole(name: str) -> Column:
    return F.col(name).cast("string")


def _top(k: int, form: str) -> Column:
    """The first ``k`` categories as text."""
    def item(x: Column) -> Column:
        count, name = (-x["c"]).cast("string"), x["name"].cast("string")
        if form == "floor":
            return _text(name, " (", count, " txns, ", pct_floor(-x["c"], F.col("n_tx")).cast("string"), "%)")
        if form == "rounded":
            return _text(name, " (", count, ", ", fmt_pct(-x["c"] / F.col("n_tx")), ")")
        if form == "cat":
            return _text("cat", name, " (", count, ")")
        if form == "cat_floor":
            return _text("cat", name, " (", count, " txns, ", pct_floor(-x["c"], F.col("n_tx")).cast("string"), "%)")
        if form == "pair":
            return _text("(", name, ", ", count, ")")
        return _text(name, " (", count, ")")
    return F.array_join(F.transform(F.slice("cats", 1, k), item), ", ")


def _with_span(summary: DataFrame, mode: str, rate_floor: int = 0) -> DataFrame:
    kind = "days" if summary.schema["first"].dataType.simpleString() in ("double", "float", "int", "bigint") else "ts"
    return summary.withColumns(span_columns(F.col("n_tx"), F.col("first"), F.col("last"), kind, mode, rate_floor))


def _read(events: DataFrame, category: str, hour: Column | None = None, *more: str) -> tuple[DataFrame, Column | None]:
    """The columns of a profile, read once, and the hour if it is not that of the time."""
    if hour is not None:
        events = events.withColumn("_hour", hour)
    names = [category, *event_columns(events), *more, *(["_hour"] if hour is not None else [])]
    return kept(events, *names), None if hour is None else F.col("_hour")


def _with_median(summary: DataFrame, events: DataFrame) -> DataFrame:
    medians = exact_median(events, ["customer_id"], amount_size(), "median_amt")
    return join_groups(summary, medians, ["customer_id"], "left")


# Fixed value: the line on a client's activity.
ACTIVITY = "- Transactions: %d over %d months (%d/month)\n"


def _activity() -> Column:
    return F.format_string(ACTIVITY, "n_tx", "months", "per_month")


def _share(part: str) -> Column:
    return fmt0(F.col(part) * 100 / F.col("n_tx"))


def client_profile(events: DataFrame, category: str = "category", hour: Column | None = None, k: int = 6) -> DataFrame:
    """Activity, spending, top categories and time pattern of a client."""
    events, hour = _read(events, category, hour)
    s = _with_median(_with_span(client_summary(events, category, hour), "calendar"), events)
    return s.select("customer_id", _text(
        "Client profile:\n", _activity(),
        "- Spending: avg ", fmt0(F.col("mean_amt")), " RUB, median ", fmt0(F.col("median_amt")),
        ", max ", fmt0(F.col("max_amt")), "\n",
        "- Top categories: ", _top(k, "floor"), "\n",
        "- Time pattern: ", _share("daytime"), "% daytime, ", _share("late"), "% evening").alias("profile"))


def churn_profile(events: DataFrame, category: str = "category", k: int = 6) -> DataFrame:
    """Activity, spending, top categories and the trend of the second half."""
    events, _ = _read(events, category)
    s = _with_median(_with_span(client_summary(events, category), "elapsed"), events)
    s = s.join(half_trend(events, "ratio").select("customer_id", "trend"), "customer_id")
    return s.select("customer_id", _text(
        "Client profile:\n", _activity(),
        "- Spending: avg ", fmt0(F.col("mean_amt")), " RUB, median ", fmt0(F.col("median_amt")), "\n",
        "- Top categories: ", _top(k, "floor"), "\n",
        "- Activity trend: ", F.col("trend")).alias("profile"))


def age_short_profile(events: DataFrame) -> DataFrame:
    events = kept(events)
    s = events.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_tx"), F.avg(amount_size()).alias("mean_amt"))
    s = _with_median(s, events)
    return s.select("customer_id", _text(
        "Client profile:\n- Transactions: ", _whole("n_tx"), "\n",
        "- Spending: avg ", fmt0(F.col("mean_amt")), " RUB, median ", fmt0(F.col("median_amt"))).alias("profile"))


def brief_profile(events: DataFrame, category: str = "category", k: int = 6) -> DataFrame:
    """One line: count, average and top categories."""
    s = client_summary(events, category)
    return s.select("customer_id", _text(
        "Client with ", _whole("n_tx"), " txns. Avg amount: ", fmt0(F.col("mean_amt")),
        ". Categories: ", _top(k, "plain"), ".").alias("profile"))


def brief_age_profile(events: DataFrame, category: str = "category", k: int = 6, diversity: str = "categories") -> DataFrame:
    """One line with median and diversity, see ``category_diversity`` for its modes."""
    events, _ = _read(events, category)
    s = _with_median(client_summary(events, category), events)
    n = _whole("n_categories" if diversity == "categories" else "n_counts")
    return s.select("customer_id", _text(
        "Client with ", _whole("n_tx"), " transactions across ", n, " categories. Avg amount: ",
        fmt0(F.col("mean_amt")), ", median: ", fmt0(F.col("median_amt")),
        ". Categories: ", _top(k, "plain"), ".").alias("profile"))


def age_profile(events: DataFrame, group: str = "category", k: int = 6, diversity: str = "categories",
                compact: bool = False) -> DataFrame:
    """Activity, spending, size bands, diversity and top group ids."""
    events, _ = _read(events, group)
    s = _with_median(_with_span(client_summary(events, group), "calendar", rate_floor=1), events)
    n = _whole("n_categories" if diversity == "categories" else "n_counts")
    small = pct_floor(F.col("n_small"), F.col("n_tx")).cast("string")
    large = pct_floor(F.col("n_large"), F.col("n_tx")).cast("string")
    money = (fmt0(F.col("mean_amt")), fmt0(F.col("median_amt")), fmt0(F.col("max_amt")))
    if compact:
        return s.select("customer_id", _text(
            "Client (", _whole("n_tx"), " txns, ", _whole("months"), "m, ", _whole("per_month"), "/mo):\n",
            "Avg: ", money[0], " RUB, median: ", money[1], ", max: ", money[2], "\n",
            "Size: ", small, "% small (<500), ", large, "% large (>5000)\n",
            "Diversity: ", n, " categories. Top: ", _top(k, "cat_floor")).alias("profile"))
    return s.select("customer_id", _text(
        "Client profile:\n", _activity(),
        "- Spending: avg ", money[0], " RUB, median ", money[1], ", max ", money[2], "\n",
        "- Transaction size: ", small, "% small (<500 RUB), ", large, "% large (>5000 RUB)\n",
        "- Category diversity: ", n, " unique categories\n",
        "- Top categories: ", _top(k, "cat")).alias("profile"))


def rich_profile(events: DataFrame, category: str = "category", kind: str | None = None, k: int = 8,
                 hour: Column | None = None) -> DataFrame:
    """The long profile in sentences; sentences without a value are left out."""
    events, hour = _read(events, category, hour, *([kind] if kind else []))
    s = _with_median(client_summary(events, category, hour), events)
    s = s.join(half_trend(events, "change").select("customer_id", "change", "trend"), "customer_id")
    s = s.withColumn("ratio", flow_ratio())
    types = F.lit(None).cast("string")
    if kind:
        s = s.join(distinct_types(events, kind), "customer_id", "left")
        types = _text("Uses ", _whole("n_types"), " transaction types. Top: ", F.col("top_types"), ".")
    return s.select("customer_id", F.concat_ws(
        " ",
        _text("Bank client with ", _whole("n_tx"), " transactions across ", _whole("n_categories"),
              " merchant categories."),
        _text("Amount stats: mean=", fmt0(F.col("mean_amt")), ", median=", fmt0(F.col("median_amt")),
              ", std=", fmt0(F.col("std_amt")), ", min=", fmt0(F.col("min_amt")), ", max=", fmt0(F.col("max_amt")), "."),
        _text("Top categories: ", _top(k, "rounded"), "."),
        F.when(F.col("n_hours") > 0, _text(
            "Time of day: morning=", _whole("morning"), ", afternoon=", _whole("afternoon"),
            ", evening=", _whole("evening"), ", night=", _whole("night"), ".")),
        F.when(F.col("trend").isNotNull(), _text(
            "Spending trend: ", F.col("trend"), " (", fmt_signed_pct(F.col("change")), ").")),
        _text("Financial flow: ", _whole("n_spend"), " spending txns (total: ", fmt0(F.col("total_spend")), "), ",
              _whole("n_income"), " income txns (total: ", fmt0(F.col("total_income")), ")."),
        F.when(F.col("ratio").isNotNull(), _text("Spend-to-income ratio: ", fmt2(F.col("ratio")), ".")),
        types).alias("profile"))


def flow_profile(events: DataFrame, category: str = "category", k: int = 6, diversity: str = "categories") -> DataFrame:
    """The shorter sentence profile with money flow."""
    events, _ = _read(events, category)
    s = _with_median(client_summary(events, category), events)
    n = _whole("n_categories" if diversity == "categories" else "n_counts")
    return s.select("customer_id", _text(
        "Bank client with ", _whole("n_tx"), " transactions across ", n, " categories. ",
        "Average amount: ", fmt0(F.col("mean_amt")), ", median: ", fmt0(F.col("median_amt")), ". ",
        "Top categories: ", _top(k, "plain"), ". ",
        "Spending: ", _whole("n_spend"), " txns (total ", fmt0(F.col("total_spend")), "), ",
        "Income: ", _whole("n_income"), " txns (total ", fmt0(F.col("total_income")), ").").alias("profile"))


def top5_profile(events: DataFrame, group: str = "category", k: int = 5) -> DataFrame:
    """Count, spending and the raw top groups as ``(group, count)`` pairs."""
    events, _ = _read(events, group)
    s = _with_median(client_summary(events, group), events)
    return s.select("customer_id", _text(
        "Transactions: ", _whole("n_tx"), "\n",
        "Spending: avg ", fmt0(F.col("mean_amt")), " RUB, median ", fmt0(F.col("median_amt")),
        ", max ", fmt0(F.col("max_amt")), "\n",
        "Top 5 categories: [", _top(k, "pair"), "]").alias("profile"))


# Header of the history text by style ({n} = number of lines).
HISTORY_HEADERS = {
    "bank": "Bank client transaction history ({n} transactions):",
    "client": "Client transaction history ({n} transactions):",
    "short": "Client ({n} txns):",
}


def history_text(events: DataFrame, k: int = 50, date_style: str = "date", header: str = "bank",
                 category: str = "category") -> DataFrame:
    """The last ``k`` events in time order, one line each, raw amounts.

    ``date_style``: ``date`` prints ``yyyy-MM-dd``, ``day`` prints ``Day d``
    (day number, or days since 1970 for timestamps).
    """
    if date_style == "date":
        when = F.date_format("time", "yyyy-MM-dd")
    elif time_kind(events) == "days":
        when = _text("Day ", F.floor("time").cast("string"))
    else:
        when = _text("Day ", F.datediff(F.col("time").cast("date"), F.lit("1970-01-01").cast("date")).cast("string"))
    line = _text(when, ": ", amount_direction(F.col("amount")), " ", fmt0(amount_size()), " at ",
                 F.coalesce(F.col(category), F.lit("Other")))
    order = event_order(events)
    last = last_events(events, k).select("customer_id", F.struct(*order, line.alias("line")).alias("_item"))
    before, after = HISTORY_HEADERS[header].split("{n}")
    lines = last.groupBy("customer_id").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    return lines.select("customer_id", F.concat(
        F.lit(before), F.size("_items").cast("string"), F.lit(after + "\n"),
        F.array_join(F.transform("_items", lambda x: x["line"]), "\n")).alias("history"))


def complete_texts(ids: DataFrame, texts: DataFrame, default: str = NO_DATA, column: str = "profile") -> DataFrame:
    """A text for every id; the default for clients without events."""
    return left_with_default(ids, texts, {column: default})


__all__ = [n for n in dir() if n.endswith("_profile")] + ["client_summary", "history_text", "complete_texts",
                                                          "day_share_columns"]
