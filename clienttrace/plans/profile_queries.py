"""Profiles and history texts."""

from __future__ import annotations

from clienttrace.functions.codes import CANONICAL, CHURN, CORE, FULL, SHORT
from clienttrace.operators import profiles as p
from clienttrace.plans.registry import query
from clienttrace.plans.roles import clicks, shipments, with_merchant
from clienttrace.plans.sqltext import (CLICK_ORDER, CLICKS, SHIP_ORDER, SHIPMENTS, f0, merchant, stats, top)

_FLOOR = "cat || ' (' || cnt || ' txns, ' || (cnt * 100 // n) || '%)'"
_PLAIN = "cat || ' (' || cnt || ')'"
_MONTHS = "greatest(1, span // 30)"
_SHORT_CODES = merchant(SHORT)


@query("client_profile", f"""
WITH {SHIPMENTS}, {stats(_SHORT_CODES, SHIP_ORDER)}, {top(6, _FLOOR)}
SELECT customer_id, 'Client profile:' || chr(10)
  || '- Transactions: ' || n || ' over ' || {_MONTHS} || ' months (' || (n // {_MONTHS}) || '/month)' || chr(10)
  || '- Spending: avg ' || {f0('mean')} || ' RUB, median ' || {f0('med')} || ', max ' || {f0('mx')} || chr(10)
  || '- Top categories: ' || top || chr(10)
  || '- Time pattern: ' || {f0('daytime * 100 / n')} || '% daytime, ' || {f0('late * 100 / n')} || '% evening'
  AS profile
FROM st JOIN tp USING (customer_id)""")
def client_profile(spark, sf_dir):
    return p.client_profile(with_merchant(shipments(spark, sf_dir)), "merchant")


@query("click_profile", f"""
WITH {CLICKS}, {stats('category', CLICK_ORDER)}, {top(6, _FLOOR)}
SELECT customer_id, 'Client profile:' || chr(10)
  || '- Transactions: ' || n || ' over ' || {_MONTHS} || ' months (' || (n // {_MONTHS}) || '/month)' || chr(10)
  || '- Spending: avg ' || {f0('mean')} || ' RUB, median ' || {f0('med')} || ', max ' || {f0('mx')} || chr(10)
  || '- Top categories: ' || top || chr(10)
  || '- Time pattern: ' || {f0('daytime * 100 / n')} || '% daytime, ' || {f0('late * 100 / n')} || '% evening'
  AS profile
FROM st JOIN tp USING (customer_id)""")
def click_profile(spark, sf_dir):
    return p.client_profile(clicks(spark, sf_dir), "category")


@query("churn_profile", f"""
WITH {SHIPMENTS}, {stats(_SHORT_CODES, SHIP_ORDER)}, {top(6, _FLOOR)}
SELECT customer_id, 'Client profile:' || chr(10)
  || '- Transactions: ' || n || ' over ' || greatest(1, elapsed // 30) || ' months ('
  || (n // greatest(1, elapsed // 30)) || '/month)' || chr(10)
  || '- Spending: avg ' || {f0('mean')} || ' RUB, median ' || {f0('med')} || chr(10)
  || '- Top categories: ' || top || chr(10)
  || '- Activity trend: ' || CASE WHEN s > round(f * 1.1, 6) THEN 'increasing'
       WHEN s < round(f * 0.9, 6) THEN 'decreasing' ELSE 'stable' END AS profile
FROM st JOIN tp USING (customer_id) JOIN tr USING (customer_id)""")
def churn_profile(spark, sf_dir):
    return p.churn_profile(with_merchant(shipments(spark, sf_dir)), "merchant")


@query("age_short_profile", f"""
WITH {SHIPMENTS}, {stats('category', SHIP_ORDER)}
SELECT customer_id, 'Client profile:' || chr(10) || '- Transactions: ' || n || chr(10)
  || '- Spending: avg ' || {f0('mean')} || ' RUB, median ' || {f0('med')} AS profile FROM st""")
def age_short_profile(spark, sf_dir):
    return p.age_short_profile(shipments(spark, sf_dir))


@query("brief_profile", f"""
WITH {SHIPMENTS}, {stats(_SHORT_CODES, SHIP_ORDER)}, {top(6, _PLAIN)}
SELECT customer_id, 'Client with ' || n || ' txns. Avg amount: ' || {f0('mean')} || '. Categories: ' || top || '.'
  AS profile FROM st JOIN tp USING (customer_id)""")
def brief_profile(spark, sf_dir):
    return p.brief_profile(with_merchant(shipments(spark, sf_dir)), "merchant")


@query("brief_age_profile", f"""
WITH {CLICKS}, {stats(_SHORT_CODES, CLICK_ORDER)}, {top(6, _PLAIN)}
SELECT customer_id, 'Client with ' || n || ' transactions across ' || counts || ' categories. Avg amount: '
  || {f0('mean')} || ', median: ' || {f0('med')} || '. Categories: ' || top || '.' AS profile
FROM st JOIN tp USING (customer_id) JOIN dv USING (customer_id)""")
def brief_age_profile(spark, sf_dir):
    return p.brief_age_profile(with_merchant(clicks(spark, sf_dir)), "merchant", diversity="distinct_counts")


@query("age_profile", f"""
WITH {CLICKS}, {stats('code', CLICK_ORDER)}, {top(6, "'cat' || cat || ' (' || cnt || ')'")}
SELECT customer_id, 'Client profile:' || chr(10)
  || '- Transactions: ' || n || ' over ' || {_MONTHS} || ' months (' || greatest(1, n // {_MONTHS}) || '/month)'
  || chr(10) || '- Spending: avg ' || {f0('mean')} || ' RUB, median ' || {f0('med')} || ', max ' || {f0('mx')}
  || chr(10) || '- Transaction size: ' || (n_small * 100 // n) || '% small (<500 RUB), ' || (n_large * 100 // n)
  || '% large (>5000 RUB)' || chr(10)
  || '- Category diversity: ' || cats || ' unique categories' || chr(10)
  || '- Top categories: ' || top AS profile
FROM st JOIN tp USING (customer_id) JOIN dv USING (customer_id)""")
def age_profile(spark, sf_dir):
    return p.age_profile(clicks(spark, sf_dir), "code")


@query("age_compact_profile", f"""
WITH {SHIPMENTS}, {stats('code', SHIP_ORDER)},
{top(6, "'cat' || cat || ' (' || cnt || ' txns, ' || (cnt * 100 // n) || '%)'")}
SELECT customer_id, 'Client (' || n || ' txns, ' || {_MONTHS} || 'm, ' || greatest(1, n // {_MONTHS}) || '/mo):'
  || chr(10) || 'Avg: ' || {f0('mean')} || ' RUB, median: ' || {f0('med')} || ', max: ' || {f0('mx')}
  || chr(10) || 'Size: ' || (n_small * 100 // n) || '% small (<500), ' || (n_large * 100 // n)
  || '% large (>5000)' || chr(10)
  || 'Diversity: ' || counts || ' categories. Top: ' || top AS profile
FROM st JOIN tp USING (customer_id) JOIN dv USING (customer_id)""")
def age_compact_profile(spark, sf_dir):
    return p.age_profile(shipments(spark, sf_dir), "code", diversity="distinct_counts", compact=True)


_RATIO = "round((s - f) / f, 9)"


@query("rich_profile", f"""
WITH {CLICKS}, {stats(merchant(FULL), CLICK_ORDER)},
{top(8, "cat || ' (' || cnt || ', ' || printf('%.0f', round(cnt / n * 100, 6)) || '%)'")},
ty AS (SELECT customer_id, count(*) AS types,
         string_agg('type_' || category || ': ' || k, ', ' ORDER BY k DESC, category) FILTER (tplace <= 5) AS toptypes
       FROM (SELECT customer_id, category, count(*) AS k,
               row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, category) AS tplace
             FROM ev GROUP BY customer_id, category) GROUP BY customer_id)
SELECT customer_id, concat_ws(' ',
  'Bank client with ' || n || ' transactions across ' || cats || ' merchant categories.',
  'Amount stats: mean=' || {f0('mean')} || ', median=' || {f0('med')} || ', std=' || {f0('sd')}
    || ', min=' || {f0('mn')} || ', max=' || {f0('mx')} || '.',
  'Top categories: ' || top || '.',
  'Time of day: morning=' || morning || ', afternoon=' || afternoon || ', evening=' || late || ', night=' || night
    || '.',
  CASE WHEN f > 0 AND abs({_RATIO}) > 0.1 THEN 'Spending trend: '
    || CASE WHEN s > f THEN 'increasing (+' ELSE 'declining (' END || {f0(f'{_RATIO} * 100')} || '%).' END,
  'Financial flow: ' || n_spend || ' spending txns (total: ' || {f0('spend')} || '), '
    || n_income || ' income txns (total: ' || {f0('income')} || ').',
  CASE WHEN spend > 0 AND income > 0 THEN 'Spend-to-income ratio: ' || printf('%.2f', round(spend / income, 6))
    || '.' END,
  'Uses ' || types || ' transaction types. Top: ' || toptypes || '.') AS profile
FROM st JOIN tp USING (customer_id) JOIN dv USING (customer_id) JOIN tr USING (customer_id)
  JOIN ty USING (customer_id)""")
def rich_profile(spark, sf_dir):
    events = with_merchant(clicks(spark, sf_dir), FULL, not_a_number="Unknown")
    return p.rich_profile(events, "merchant", "category")


@query("flow_profile", f"""
WITH {SHIPMENTS}, {stats(merchant(CHURN), SHIP_ORDER)}, {top(6, _PLAIN)}
SELECT customer_id, 'Bank client with ' || n || ' transactions across ' || cats || ' categories. Average amount: '
  || {f0('mean')} || ', median: ' || {f0('med')} || '. Top categories: ' || top || '. Spending: '
  || n_spend || ' txns (total ' || {f0('spend')} || '), Income: ' || n_income || ' txns (total '
  || {f0('income')} || ').' AS profile
FROM st JOIN tp USING (customer_id) JOIN dv USING (customer_id)""")
def flow_profile(spark, sf_dir):
    return p.flow_profile(with_merchant(shipments(spark, sf_dir), CHURN), "merchant")


@query("top5_profile", f"""
WITH {CLICKS}, {stats('code', CLICK_ORDER)}, {top(5, "'(' || cat || ', ' || cnt || ')'")}
SELECT customer_id, 'Transactions: ' || n || chr(10) || 'Spending: avg ' || {f0('mean')} || ' RUB, median '
  || {f0('med')} || ', max ' || {f0('mx')} || chr(10) || 'Top 5 categories: [' || top || ']' AS profile
FROM st JOIN tp USING (customer_id)""")
def top5_profile(spark, sf_dir):
    return p.top5_profile(clicks(spark, sf_dir), "code")


def _history_sql(source: str, order: str, codes: str, k: int, head: str, tail: str, when: str) -> str:
    return f"""
WITH {source}, o AS (
  SELECT *, {codes} AS cat, row_number() OVER (PARTITION BY customer_id ORDER BY {order}) AS rn,
    count(*) OVER (PARTITION BY customer_id) AS n FROM ev)
SELECT customer_id, '{head}' || count(*) || '{tail}' || chr(10) || string_agg({when} || ': '
  || CASE WHEN amount < 0 THEN 'spent' ELSE 'received' END || ' ' || {f0('abs(amount)')} || ' at ' || cat,
  chr(10) ORDER BY rn) AS history
FROM o WHERE rn > n - {k} GROUP BY customer_id"""


_DATE = "strftime(time, '%Y-%m-%d')"
_DAY = "'Day ' || datediff('day', DATE '1970-01-01', time::date)"


@query("history_text", _history_sql(SHIPMENTS, SHIP_ORDER, merchant(CORE), 50,
                                    "Bank client transaction history (", " transactions):", _DATE))
def history_text(spark, sf_dir):
    return p.history_text(with_merchant(shipments(spark, sf_dir), CORE), 50, "date", "bank", "merchant")


@query("history_text_short", _history_sql(CLICKS, CLICK_ORDER, merchant(CANONICAL), 30,
                                          "Client (", " txns):", _DAY))
def history_text_short(spark, sf_dir):
    return p.history_text(with_merchant(clicks(spark, sf_dir), CANONICAL), 30, "day", "short", "merchant")
