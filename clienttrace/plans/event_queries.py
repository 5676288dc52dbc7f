"""Scalars, filters, joins, aggregates, sequences and sampling over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clienttrace.functions import scalars as sc
from clienttrace.functions.codes import CANONICAL, FULL, SHORT, classify_code, range_lookup
from clienttrace.operators import aggregates as ag
from clienttrace.operators import events as ev
from clienttrace.operators import profiles, sampling, sequences
from clienttrace.plans.registry import num, query, sql_num
from clienttrace.plans.roles import (click_labels, clicks, customer_labels, segment_labels, shipments, table, vectors,
                                     with_merchant)
from clienttrace.plans.sqltext import CLICK_ORDER, CLICKS, SHIP_ORDER, SHIPMENTS, hash_order, merchant

_LABELS = "lab AS (SELECT c_custkey AS customer_id, (c_mktsegment = 'BUILDING')::int AS target FROM customer)"
_SEGMENTS = "seg AS (SELECT c_custkey AS customer_id, c_mktsegment AS target FROM customer)"


# --- scalar functions -------------------------------------------------------

@query("amount_scalars", f"""
WITH {CLICKS} SELECT event_id, {sql_num('sign(amount) * ln(1 + abs(amount))', 6)} AS log_amount,
  CASE WHEN amount < 0 THEN 'spent' ELSE 'received' END AS direction,
  printf('%.0f', abs(amount)) AS shown, {sql_num('greatest(0.05, least(0.95, value_share))', 6)} AS clipped,
  (value_share >= 0.5)::int AS label, (value_share > 0.5)::int AS strict_label,
  floor(abs(amount))::bigint * 100 // greatest(code, 1) AS pct
FROM (SELECT *, (abs(amount) % 1) AS value_share FROM ev)""")
def amount_scalars(spark, sf_dir):
    a = F.col("amount")
    share = F.abs(a) % 1
    return clicks(spark, sf_dir).select(
        F.col("tie.event_id").alias("event_id"), num(sc.signed_log1p(a), 6).alias("log_amount"),
        sc.amount_direction(a).alias("direction"), sc.fmt0(F.abs(a)).alias("shown"),
        num(sc.clip(share, 0.05, 0.95), 6).alias("clipped"), sc.threshold_label(share).alias("label"),
        sc.threshold_label(share, strict=True).alias("strict_label"),
        sc.pct_floor(F.floor(F.abs(a)), F.col("code")).alias("pct"))


@query("time_scalars", """
SELECT event_id, round(day + clock / 86400.0 + 1e-9, 6) AS day_float,
  day AS day, h AS hour, CASE WHEN event_id % 5 = 0 THEN NULL ELSE h END AS clock_hour,
  strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS bank_time
FROM (SELECT event_id, ts, datediff('day', DATE '2024-01-01', ts::date) AS day,
   CASE WHEN event_id % 5 = 0 THEN 12 ELSE hour(ts) END AS h,
   CASE WHEN event_id % 5 = 0 THEN 0 ELSE hour(ts) * 3600 + minute(ts) * 60 + second(ts) END AS clock
 FROM events) q""")
def time_scalars(spark, sf_dir):
    source = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    # Every fifth stamp comes without a clock part, as some sources write them.
    text = F.concat_ws(" ", day.cast("string"),
                       F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "HH:mm:ss")))
    bank = F.upper(F.date_format("ts", "ddMMMyy:HH:mm:ss"))
    parsed = source.select("event_id", text.alias("text"), bank.alias("bank"))
    return parsed.select(
        "event_id", num(sc.parse_day_time(F.col("text")), 6).alias("day_float"),
        sc.parse_day_hour(F.col("text"))["day"].alias("day"), sc.parse_day_hour(F.col("text"))["hour"].alias("hour"),
        sc.extract_hour(F.col("text")).alias("clock_hour"),
        F.date_format(sc.parse_bank_ts(F.col("bank")), "yyyy-MM-dd HH:mm:ss").alias("bank_time"))


@query("merchant_categories", f"""
WITH {SHIPMENTS} SELECT canonical, complete, short, count(*) AS n FROM (
  SELECT {merchant(CANONICAL)} AS canonical, {merchant(FULL)} AS complete, {merchant(SHORT)} AS short FROM ev)
GROUP BY ALL""")
def merchant_categories(spark, sf_dir):
    code = F.col("code")
    return shipments(spark, sf_dir).groupBy(
        classify_code(code, CANONICAL).alias("canonical"),
        classify_code(code, FULL, not_a_number="Unknown").alias("complete"),
        classify_code(code, SHORT).alias("short")).agg(F.count(F.lit(1)).alias("n"))


@query("range_lookup", f"""
WITH {CLICKS} SELECT event_id, {merchant(CANONICAL)} AS merchant FROM ev""")
def merchant_range_lookup(spark, sf_dir):
    ranges = spark.createDataFrame(list(CANONICAL), "low int, high int, name string")
    return (range_lookup(clicks(spark, sf_dir), "code", ranges, "merchant")
            .select(F.col("tie.event_id").alias("event_id"), "merchant"))


@query("filled_categories", """
SELECT kind, code, sum(amount)::bigint AS amount, label, count(*) AS n FROM (
  SELECT coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'UNK') AS kind,
    coalesce(CASE WHEN event_id % 3 > 0 THEN event_id % 7 END, 0) AS code,
    coalesce(try_cast(CASE WHEN event_id % 4 = 0 THEN event_type ELSE event_id::varchar END AS double), 0) AS amount,
    CASE user_id % 4 WHEN 0 THEN 'young (under 25)' WHEN 1 THEN 'adult (25-35)'
      WHEN 2 THEN 'middle-aged (35-55)' ELSE 'senior (over 55)' END AS label FROM events)
GROUP BY kind, code, label""")
def filled_categories(spark, sf_dir):
    from clienttrace.operators.prompts import AGE_LABELS
    e = table(spark, sf_dir, "events")
    mixed = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return (e.select(
        sc.fill_category(F.when(F.col("event_type") != "view", F.col("event_type"))).alias("kind"),
        sc.fill_category(F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 7), 0).alias("code"),
        sc.to_amount(mixed).alias("amount"),
        sc.case_label(F.col("user_id") % 4, AGE_LABELS).alias("label"))
        .groupBy("kind", "code", "label")
        .agg(F.sum("amount").cast("long").alias("amount"), F.count(F.lit(1)).alias("n")))


# --- filters and joins ------------------------------------------------------

@query("keep_labelled", f"""
WITH {SHIPMENTS} SELECT customer_id, count(*) AS n FROM ev
WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY customer_id""")
def keep_labelled(spark, sf_dir):
    labelled = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("customer_id"))
    return (ev.keep_labelled(shipments(spark, sf_dir), labelled)
            .groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")))


@query("attach_target", f"""
WITH {SHIPMENTS}, {_LABELS} SELECT customer_id, target, count(*) AS n FROM ev JOIN lab USING (customer_id)
GROUP BY customer_id, target""")
def attach_target(spark, sf_dir):
    counts = shipments(spark, sf_dir).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return ev.attach_target(counts, customer_labels(spark, sf_dir))


@query("min_events", f"""
WITH {SHIPMENTS} SELECT customer_id, count(*) AS n FROM ev GROUP BY customer_id HAVING count(*) >= 25""")
def min_events(spark, sf_dir):
    return (ev.min_events(shipments(spark, sf_dir), 25)
            .groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")))


@query("default_fill", """
SELECT c_custkey AS customer_id, coalesce(n, 0) AS n,
  CASE WHEN n IS NULL THEN 'No transaction data available.' ELSE 'Client with ' || n || ' orders' END AS profile,
  CASE WHEN n IS NULL THEN 0.5 ELSE 1.0 END AS pred
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'
  GROUP BY o_custkey) ON c_custkey = o_custkey""")
def default_fill(spark, sf_dir):
    urgent = (table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
              .groupBy(F.col("o_custkey").alias("customer_id")).agg(F.count(F.lit(1)).alias("n"))
              .withColumns({"profile": F.concat(F.lit("Client with "), F.col("n").cast("string"), F.lit(" orders")),
                            "pred": F.lit(1.0)}))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    return ev.left_with_default(ids, urgent, {"n": 0, "profile": profiles.NO_DATA, "pred": 0.5})


@query("missing_ids", """
SELECT c_custkey AS customer_id FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def missing_ids(spark, sf_dir):
    urgent = (table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
              .select(F.col("o_custkey").alias("customer_id")))
    return ev.missing_ids(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id")), urgent)


@query("align_by_id", """
SELECT o_custkey AS customer_id, count(*) AS n, any_value(c_mktsegment) AS segment
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey""")
def align_by_id(spark, sf_dir):
    counts = (table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer_id"))
              .agg(F.count(F.lit(1)).alias("n")))
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"),
                                                       F.col("c_mktsegment").alias("segment"))
    return ev.align_by_id(counts, segments)


@query("labels_from_flags", """
SELECT user_id AS customer_id, max((event_type = 'error' AND value > 100)::int) AS target FROM events
GROUP BY user_id""")
def labels_from_flags(spark, sf_dir):
    flagged = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("customer_id"),
        ((F.col("event_type") == "error") & (F.col("value") > 100)).cast("int").alias("flag"))
    return ev.labels_from_flags(flagged, "flag")


@query("union_splits", """
SELECT split, count(*) AS n, count(DISTINCT o_orderpriority) AS classes FROM (
  SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'test' END AS split FROM orders) GROUP BY split""")
def union_splits(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    both = ev.union_splits(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                     F.count_distinct("o_orderpriority").alias("classes"))


@query("distinct_classes", """
SELECT DISTINCT target FROM (SELECT label AS target FROM embeddings UNION ALL SELECT n_nationkey FROM nation)""")
def distinct_classes(spark, sf_dir):
    return ev.distinct_classes(vectors(spark, sf_dir).select("target"),
                               table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("target")))


# --- aggregates -------------------------------------------------------------

@query("client_features", f"""
WITH {SHIPMENTS} SELECT customer_id, count(*) AS n_tx, {sql_num('avg(abs(amount))')} AS mean_amt,
  {sql_num('stddev_pop(abs(amount))', 3)} AS std_amt, {sql_num('median(abs(amount))')} AS median_amt,
  count(DISTINCT category) AS n_mcc FROM ev GROUP BY customer_id""")
def client_features(spark, sf_dir):
    f = ag.client_features(shipments(spark, sf_dir))
    return f.select("customer_id", "n_tx", num("mean_amt").alias("mean_amt"), num("std_amt", 3).alias("std_amt"),
                    num("median_amt").alias("median_amt"), "n_mcc")


@query("client_features_small", f"""
WITH {SHIPMENTS} SELECT customer_id, count(*) AS n_tx, {sql_num('avg(abs(amount))')} AS mean_amt,
  count(DISTINCT code) AS n_mcc FROM ev GROUP BY customer_id""")
def client_features_small(spark, sf_dir):
    f = ag.client_features_small(shipments(spark, sf_dir), "code")
    return f.select("customer_id", "n_tx", num("mean_amt").alias("mean_amt"), "n_mcc")


@query("category_counts", f"""
WITH {SHIPMENTS} SELECT customer_id, category, count(*) AS cnt,
  {sql_num('count(*) / sum(count(*)) OVER (PARTITION BY customer_id)', 6)} AS share
FROM ev GROUP BY customer_id, category""")
def category_counts(spark, sf_dir):
    return ag.category_counts(shipments(spark, sf_dir)).withColumn("share", num("share", 6))


@query("top_categories", f"""
WITH {SHIPMENTS} SELECT customer_id, category, cnt, n_tx, place, cnt * 100 // n_tx AS pct FROM (
  SELECT customer_id, {merchant(CANONICAL)} AS category, count(*) AS cnt,
    sum(count(*)) OVER (PARTITION BY customer_id) AS n_tx,
    row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, {merchant(CANONICAL)}) AS place
  FROM ev GROUP BY customer_id, {merchant(CANONICAL)}) WHERE place <= 6""")
def top_categories(spark, sf_dir):
    events = with_merchant(shipments(spark, sf_dir), CANONICAL)
    return ag.top_categories(events, 6, "merchant").withColumnRenamed("merchant", "category")


@query("activity_span", f"""
WITH {CLICKS}, s AS (SELECT customer_id, count(*) AS n, datediff('day', min(time), max(time)) AS span,
   (epoch_us(max(time)) - epoch_us(min(time))) // 86400000000 AS elapsed FROM ev GROUP BY customer_id)
SELECT customer_id, n AS n_tx, span AS days_span, greatest(1, span // 30) AS months,
  n // greatest(1, span // 30) AS per_month, elapsed AS elapsed_days, greatest(1, elapsed // 30) AS elapsed_months
FROM s""")
def activity_span(spark, sf_dir):
    events = clicks(spark, sf_dir)
    elapsed = ag.activity_span(events, "elapsed").select(
        "customer_id", F.col("days_span").alias("elapsed_days"), F.col("months").alias("elapsed_months"))
    return ag.activity_span(events).join(elapsed, "customer_id")


@query("day_parts", f"""
WITH {CLICKS}, h AS (SELECT customer_id, hour(time) AS h FROM ev)
SELECT customer_id, {sql_num('count(*) FILTER (h >= 9 AND h < 18) * 100 / count(*)')} AS daytime_pct,
  {sql_num('count(*) FILTER (h >= 18 AND h < 23) * 100 / count(*)')} AS evening_pct,
  count(*) FILTER (h >= 6 AND h < 12) AS morning, count(*) FILTER (h >= 12 AND h < 18) AS afternoon,
  count(*) FILTER (h >= 18 AND h < 23) AS evening, count(*) FILTER (h >= 23 OR h < 6) AS night
FROM h GROUP BY customer_id""")
def day_parts(spark, sf_dir):
    events = clicks(spark, sf_dir)
    shares = ag.day_part_share(events)
    return (shares.withColumns({c: num(c) for c in ("daytime_pct", "evening_pct")})
            .join(ag.day_part_counts(events), "customer_id"))


@query("money_flow", f"""
WITH {SHIPMENTS}, f AS (SELECT customer_id, count(*) FILTER (amount < 0) AS n_spend,
    abs(coalesce(sum(amount) FILTER (amount < 0), 0)) AS s, count(*) FILTER (amount > 0) AS n_income,
    coalesce(sum(amount) FILTER (amount > 0), 0) AS i FROM ev GROUP BY customer_id)
SELECT customer_id, n_spend, {sql_num('s')} AS total_spend, n_income, {sql_num('i')} AS total_income,
  CASE WHEN s > 0 AND i > 0 THEN {sql_num('s / i')} END AS spend_income_ratio FROM f""")
def money_flow(spark, sf_dir):
    f = ag.money_flow(shipments(spark, sf_dir))
    return f.withColumns({c: num(c) for c in ("total_spend", "total_income", "spend_income_ratio")})


@query("size_bands", f"""
WITH {SHIPMENTS} SELECT customer_id, count(*) FILTER (abs(amount) < 10000) * 100 // count(*) AS small_pct,
  count(*) FILTER (abs(amount) > 50000) * 100 // count(*) AS large_pct FROM ev GROUP BY customer_id""")
def size_bands(spark, sf_dir):
    return ag.size_bands(shipments(spark, sf_dir), 10000, 50000)


@query("amount_range", f"""
WITH {SHIPMENTS} SELECT customer_id, min(abs(amount)) AS min_amt, max(abs(amount)) AS max_amt FROM ev
GROUP BY customer_id""")
def amount_range(spark, sf_dir):
    return ag.amount_range(shipments(spark, sf_dir))


@query("diversity_modes", f"""
WITH {SHIPMENTS}, cc AS (SELECT customer_id, category, count(*) AS cnt FROM ev GROUP BY customer_id, category)
SELECT customer_id, count(*) AS categories, count(DISTINCT cnt) AS different_counts FROM cc GROUP BY customer_id""")
def diversity_modes(spark, sf_dir):
    events = shipments(spark, sf_dir)
    counts = ag.category_diversity(events, mode="distinct_counts").withColumnRenamed("diversity", "different_counts")
    return ag.category_diversity(events).withColumnRenamed("diversity", "categories").join(counts, "customer_id")


@query("distinct_types", f"""
WITH {CLICKS} SELECT customer_id, count(*) AS n_types,
  string_agg('type_' || category || ': ' || k, ', ' ORDER BY k DESC, category) FILTER (place <= 5) AS top_types
FROM (SELECT customer_id, category, count(*) AS k,
   row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, category) AS place
  FROM ev GROUP BY customer_id, category) GROUP BY customer_id""")
def distinct_types(spark, sf_dir):
    return ag.distinct_types(clicks(spark, sf_dir), "category")


@query("half_trend", f"""
WITH {SHIPMENTS}, r AS (SELECT customer_id, abs(amount) AS a,
    row_number() OVER (PARTITION BY customer_id ORDER BY {SHIP_ORDER}) AS rn,
    count(*) OVER (PARTITION BY customer_id) AS n FROM ev),
h AS (SELECT customer_id, round(avg(a) FILTER (rn <= n // 2), 6) AS f, round(avg(a) FILTER (rn > n // 2), 6) AS s
      FROM r GROUP BY customer_id)
SELECT customer_id, CASE WHEN s > round(f * 1.1, 6) THEN 'increasing' WHEN s < round(f * 0.9, 6) THEN 'decreasing'
    ELSE 'stable' END AS trend,
  CASE WHEN f > 0 AND abs(round((s - f) / f, 9)) > 0.1 THEN {sql_num('round((s - f) / f, 9)', 6)} END AS change,
  CASE WHEN f > 0 AND abs(round((s - f) / f, 9)) > 0.1 THEN CASE WHEN s > f THEN 'increasing' ELSE 'declining' END
    END AS direction FROM h""")
def half_trend(spark, sf_dir):
    """Both readings of the same two means."""
    change = ag.trend_columns("change")
    return ag.half_means(shipments(spark, sf_dir)).select(
        "customer_id", ag.trend_columns()["trend"].alias("trend"), num(change["change"], 6).alias("change"),
        change["trend"].alias("direction"))


@query("class_distribution", """
SELECT t.target, count(label) AS cnt FROM (SELECT unnest(range(0, 12))::int AS target) t
LEFT JOIN embeddings ON label = t.target GROUP BY t.target""")
def class_distribution(spark, sf_dir):
    return ag.class_distribution(vectors(spark, sf_dir), range(12))


@query("positive_rate", f"WITH {_LABELS} SELECT {sql_num('avg(target)', 6)} AS rate, count(*) AS clients FROM lab")
def positive_rate(spark, sf_dir):
    return ag.positive_rate(customer_labels(spark, sf_dir)).withColumn("rate", num("rate", 6))


@query("text_length", f"""
SELECT source, lang, count(*) AS n, {sql_num('avg(length(text))')} AS avg_length FROM documents GROUP BY source, lang""")
def text_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), num(F.avg(F.length("text"))).alias("avg_length"))


@query("history_length", f"""
WITH {CLICKS}, o AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY {CLICK_ORDER}) AS rn,
    count(*) OVER (PARTITION BY customer_id) AS n FROM ev),
t AS (SELECT customer_id, 'Client (' || count(*) || ' txns):' || chr(10) || string_agg(strftime(time, '%Y-%m-%d')
    || ': ' || CASE WHEN amount < 0 THEN 'spent' ELSE 'received' END || ' ' || printf('%.0f', abs(amount))
    || ' at ' || category, chr(10) ORDER BY rn) AS history FROM o WHERE rn > n - 20 GROUP BY customer_id)
SELECT count(*) AS n, {sql_num('avg(length(history))')} AS avg_length FROM t""")
def history_length(spark, sf_dir):
    texts = profiles.history_text(clicks(spark, sf_dir), 20, "date", "short")
    return ag.text_length_stats(texts, "history").withColumn("avg_length", num("avg_length"))


# --- sequences --------------------------------------------------------------

@query("category_encoding", f"""
WITH {SHIPMENTS} SELECT value, (row_number() OVER (ORDER BY value))::int AS index
FROM (SELECT DISTINCT code::varchar AS value FROM ev)""")
def category_encoding(spark, sf_dir):
    return sequences.category_codes(shipments(spark, sf_dir), "code")


@query("category_dimensions", f"""
WITH {SHIPMENTS} SELECT 'category' AS "column", count(DISTINCT category) + 2 AS dimension FROM ev
UNION ALL SELECT 'code', count(DISTINCT code) + 2 FROM ev""")
def category_dimensions(spark, sf_dir):
    return sequences.category_dimension(shipments(spark, sf_dir), ["category", "code"])


@query("event_order", f"""
WITH {SHIPMENTS} SELECT customer_id, l_orderkey, l_partkey, l_suppkey, l_linenumber,
  row_number() OVER (PARTITION BY customer_id ORDER BY {SHIP_ORDER}) AS event_no,
  count(*) OVER (PARTITION BY customer_id) AS n_events FROM ev""")
def event_order(spark, sf_dir):
    return sequences.order_events(shipments(spark, sf_dir)).select(
        "customer_id", "tie.l_orderkey", "tie.l_partkey", "tie.l_suppkey", "tie.l_linenumber", "event_no", "n_events")


@query("time_since_first", f"""
WITH {CLICKS} SELECT event_id, {sql_num('''((epoch_us(time)
  - min(epoch_us(time)) OVER (PARTITION BY customer_id)) / 86400000000.0)::float''', 3)} AS event_time FROM ev""")
def time_since_first(spark, sf_dir):
    return sequences.event_time_since_first(clicks(spark, sf_dir)).select(
        F.col("tie.event_id").alias("event_id"), num("event_time", 3).alias("event_time"))


@query("last_events", f"""
WITH {SHIPMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY {SHIP_ORDER}) AS rn,
    count(*) OVER (PARTITION BY customer_id) AS n FROM ev)
SELECT customer_id, l_orderkey, l_partkey, amount FROM r WHERE rn > n - 30""")
def last_events(spark, sf_dir):
    return sequences.last_events(shipments(spark, sf_dir), 30).select(
        "customer_id", "tie.l_orderkey", "tie.l_partkey", "amount")


_JOINED = "string_agg({x}, ',' ORDER BY {o})"


@query("event_sequences", f"""
WITH {SHIPMENTS}, {_LABELS}, codes AS (
  SELECT value, row_number() OVER (ORDER BY value) AS idx FROM (SELECT DISTINCT category AS value FROM ev)),
e AS (SELECT ev.*, idx, datediff('day', min(time) OVER (PARTITION BY customer_id), time) AS since,
    count(*) OVER (PARTITION BY customer_id) AS n FROM ev JOIN codes ON category = value)
SELECT customer_id, target, count(*)::int AS n_events,
  {_JOINED.format(x='since', o=SHIP_ORDER)} AS event_times,
  {_JOINED.format(x="printf('%.4f', sign(amount) * ln(1 + abs(amount)))", o=SHIP_ORDER)} AS amounts,
  {_JOINED.format(x='idx', o=SHIP_ORDER)} AS categories
FROM e JOIN lab USING (customer_id) WHERE n >= 15 GROUP BY customer_id, target""")
def event_sequences(spark, sf_dir):
    events = shipments(spark, sf_dir).withColumn("log_amount", sc.signed_log1p(F.col("amount")))
    encoded = sequences.encode_category(events, "category")
    records = sequences.build_sequences(encoded, ["log_amount", "category_index"], customer_labels(spark, sf_dir), 15)

    def text(name, item):
        return F.array_join(F.transform(name, item), ",")
    return records.select(
        "customer_id", "target", F.size("event_time").alias("n_events"),
        text("event_time", lambda x: x.cast("int").cast("string")).alias("event_times"),
        text("log_amount", lambda x: x.cast("decimal(12,4)").cast("string")).alias("amounts"),
        text("category_index", lambda x: x.cast("string")).alias("categories"))


def _draw(purpose: str) -> str:
    return f"('0x' || substr(md5(concat_ws('-', customer_id, 0, k, '{purpose}-42')), 1, 8))::bigint"


@query("sequence_slices", f"""
WITH {CLICKS}, s AS (SELECT customer_id, list(amount ORDER BY {CLICK_ORDER}) AS a, count(*) AS n FROM ev
  GROUP BY customer_id),
l AS (SELECT *, least(15, n) + {_draw('length')} % (least(75, n) - least(15, n) + 1) AS len
  FROM s, (SELECT unnest(range(1, 6))::int AS k)),
t AS (SELECT *, 1 + {_draw('start')} % (n - len + 1) AS st FROM l)
SELECT customer_id, k AS slice_no, len::int AS slice_length, st::int AS slice_start,
  array_to_string(list_transform(a[st:st + len - 1], lambda x: printf('%.2f', x)), ',') AS amounts FROM t""")
def sequence_slices(spark, sf_dir):
    records = sequences.build_sequences(clicks(spark, sf_dir), ["amount"])
    slices = sequences.sample_slices(records, ["amount", "event_time"])
    return slices.select("customer_id", "slice_no", "slice_length", "slice_start", F.array_join(
        F.transform("amount", lambda x: x.cast("decimal(12,2)").cast("string")), ",").alias("amounts"))


# --- sampling ---------------------------------------------------------------

def _ranked(source: str, group: str = "target", seed: int = 42, key: str = "customer_id") -> str:
    by = f"PARTITION BY {group}" if group else ""
    return (f"SELECT *, row_number() OVER ({by} ORDER BY {hash_order(key, seed)}, {key}) AS rn, "
            f"count(*) OVER ({by}) AS n FROM {source}")


@query("stratified_split", f"""
WITH {_SEGMENTS}, r AS ({_ranked('seg')})
SELECT customer_id, target, CASE WHEN rn <= round(0.1 * n) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(segment_labels(spark, sf_dir))


@query("three_way_split", f"""
WITH {_SEGMENTS}, r AS ({_ranked('seg')}), tr AS (SELECT customer_id, target FROM r WHERE rn > round(0.1 * n)),
v AS ({_ranked('tr')})
SELECT customer_id, target, CASE WHEN rn <= round(0.1 * n) THEN 'validation' ELSE 'train' END AS split FROM v
UNION ALL SELECT customer_id, target, 'test' FROM r WHERE rn <= round(0.1 * n)""")
def three_way_split(spark, sf_dir):
    return sampling.train_validation_test(segment_labels(spark, sf_dir))


@query("kfold", f"""
WITH {_SEGMENTS}, r AS ({_ranked('seg')}) SELECT customer_id, target, ((rn - 1) % 5)::int AS fold FROM r""")
def kfold(spark, sf_dir):
    return sampling.stratified_kfold(segment_labels(spark, sf_dir))


@query("sample_n", f"""
WITH {_SEGMENTS} SELECT customer_id, target FROM seg ORDER BY {hash_order('customer_id')}, customer_id LIMIT 300""")
def sample_n(spark, sf_dir):
    return sampling.sample_n(segment_labels(spark, sf_dir), 300)


@query("stratified_sample", f"""
WITH {_SEGMENTS}, r AS ({_ranked('seg')}), q AS (
  SELECT target, whole + (row_number() OVER (ORDER BY share - whole DESC, target) <= least(200, total) - sum(whole)
    OVER ())::int AS quota FROM (
    SELECT target, least(200, total) * n / total AS share, floor(least(200, total) * n / total)::int AS whole, total
    FROM (SELECT target, count(*) AS n, sum(count(*)) OVER () AS total FROM seg GROUP BY target)))
SELECT customer_id, target FROM r JOIN q USING (target) WHERE rn <= quota""")
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample_n(segment_labels(spark, sf_dir), n=200)


@query("equal_per_class", f"""
WITH {_SEGMENTS}, r AS ({_ranked('seg')}) SELECT customer_id, target FROM r
WHERE rn <= 203 // (SELECT count(DISTINCT target) FROM seg)""")
def equal_per_class(spark, sf_dir):
    return sampling.equal_per_class(segment_labels(spark, sf_dir), n=203)


@query("random_demos", f"""
WITH {_SEGMENTS}, sp AS ({_ranked('seg')}),
base AS (SELECT customer_id, target FROM sp WHERE rn > round(0.1 * n)),
q AS (SELECT customer_id AS query_id FROM sp WHERE rn <= round(0.1 * n)),
b AS ({_ranked('base')}), sz AS (SELECT target, count(*) AS n FROM base GROUP BY target),
w AS (SELECT query_id, target, n, ('0x' || substr({hash_order("query_id || '-' || target")}, 1, 8))::bigint % n AS st
  FROM q, sz),
d AS (SELECT query_id, w.target, customer_id FROM w, (SELECT unnest([0, 1]) AS step)
  JOIN b ON b.target = w.target AND b.rn = (st + step) % w.n + 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id
    ORDER BY {hash_order("query_id || '-' || customer_id")}, customer_id) AS position, customer_id, target FROM d""")
def random_demos(spark, sf_dir):
    split = sampling.stratified_split(segment_labels(spark, sf_dir))
    return sampling.random_demos(split.where("split = 'test'"), split.where("split = 'train'"), 2)


@query("batches", f"""
WITH {_SEGMENTS}, r AS ({_ranked('seg', '')}) SELECT customer_id, (rn - 1) // 64 AS batch_id FROM r""")
def batches(spark, sf_dir):
    return sampling.assign_batches(segment_labels(spark, sf_dir), 64).select("customer_id", "batch_id")


@query("first_n", "SELECT customer_id FROM (SELECT user_id AS customer_id FROM events GROUP BY 1) ORDER BY 1 LIMIT 100")
def first_n(spark, sf_dir):
    return sampling.first_n(click_labels(spark, sf_dir), 100, "customer_id").select("customer_id")

