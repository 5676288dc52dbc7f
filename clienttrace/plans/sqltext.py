"""Shared pieces of the SQL counterparts."""

from __future__ import annotations

from clienttrace.functions.codes import Ranges

CLICKS = """ev AS (
  SELECT user_id AS customer_id, ts AS time, event_id,
         CASE WHEN event_type IN ('purchase', 'error') THEN -value ELSE value END AS amount,
         event_type AS category, 1 + (event_id * 7919) % 9999 AS code
  FROM events)"""
CLICK_ORDER = "time, event_id"

SHIPMENTS = """ev AS (
  SELECT o_custkey AS customer_id, l_shipdate AS time,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS amount,
         p_type AS category, 1 + (l_partkey * 7919) % 9999 AS code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
SHIP_ORDER = "time, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

VECTORS = """vec AS (
  SELECT vec_id AS customer_id, embedding, label AS target, (label >= 5)::int AS binary_target
  FROM embeddings)"""


def merchant(ranges: Ranges, default: str = "Other", code: str = "code") -> str:
    whens = " ".join(f"WHEN {code} >= {a} AND {code} < {b} THEN '{n}'" for a, b, n in ranges)
    return f"CASE {whens} ELSE '{default}' END"


def f0(x: str) -> str:
    return f"printf('%.0f', round({x}, 6))"


def hash_order(key: str, seed: int = 42) -> str:
    return f"md5(({key})::varchar || '-{seed}')"


def stats(category: str, order: str, hour: str = "hour(time)") -> str:
    """CTEs ``c`` (events with category ``cat``), ``st``, ``cc`` and ``tr`` (halves)."""
    return f"""
c AS (SELECT *, abs(amount) AS a, {category} AS cat, {hour} AS h,
        row_number() OVER (PARTITION BY customer_id ORDER BY {order}) AS rn,
        count(*) OVER (PARTITION BY customer_id) AS cn FROM ev),
st AS (SELECT customer_id, count(*) AS n, avg(a) AS mean, median(a) AS med, stddev_pop(a) AS sd,
        min(a) AS mn, max(a) AS mx,
        datediff('day', min(time), max(time)) AS span,
        (epoch_us(max(time)) - epoch_us(min(time))) // 86400000000 AS elapsed,
        count(*) FILTER (h >= 9 AND h < 18) AS daytime, count(*) FILTER (h >= 18 AND h < 23) AS late,
        count(*) FILTER (h >= 6 AND h < 12) AS morning, count(*) FILTER (h >= 12 AND h < 18) AS afternoon,
        count(*) FILTER (h >= 23 OR h < 6) AS night,
        count(*) FILTER (amount < 0) AS n_spend, count(*) FILTER (amount > 0) AS n_income,
        abs(coalesce(sum(amount) FILTER (amount < 0), 0)) AS spend,
        coalesce(sum(amount) FILTER (amount > 0), 0) AS income,
        count(*) FILTER (a < 500) AS n_small, count(*) FILTER (a > 5000) AS n_large
      FROM c GROUP BY customer_id),
cc AS (SELECT customer_id, cat, count(*) AS cnt,
        row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, cat) AS place
      FROM c GROUP BY customer_id, cat),
dv AS (SELECT customer_id, count(*) AS cats, count(DISTINCT cnt) AS counts FROM cc GROUP BY customer_id),
tr AS (SELECT customer_id, round(avg(a) FILTER (rn <= cn // 2), 6) AS f,
        round(avg(a) FILTER (rn > cn // 2), 6) AS s FROM c GROUP BY customer_id)"""


def top(k: int, item: str) -> str:
    """CTE ``tp`` with the text of the ``k`` most frequent categories."""
    return f"""
tp AS (SELECT customer_id, string_agg({item}, ', ' ORDER BY place) AS top
      FROM cc JOIN st USING (customer_id) WHERE place <= {k} GROUP BY customer_id)"""
