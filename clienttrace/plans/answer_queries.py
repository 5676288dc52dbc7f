"""Prompts, answers, cost and resuming over the given tables.

No scored answers are among the tables, so answers are written from the event
rows by one SQL expression that both engines evaluate.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from clienttrace.functions import answers as an
from clienttrace.functions.vectors import argmax_class
from clienttrace.operators import aggregates, evidence, knn, profiles, prompts, sampling, scoring
from clienttrace.operators import vectors as vec
from clienttrace.plans.registry import num, query, sql_num
from clienttrace.plans.roles import click_labels, clicks, table, vectors, with_merchant
from clienttrace.plans.sqltext import CLICK_ORDER, CLICKS, VECTORS, f0, hash_order, merchant, stats, top
from clienttrace.functions.codes import SHORT
from clienttrace.sources.results import result_record, resume_scoring, skip_completed_cells

# --- answers written from event rows ----------------------------------------

_WORD = "CASE WHEN event_id * 31 % 5 < 2 THEN 'male' ELSE 'female' END"
_NUMBER = "cast(10 + event_id * 37 % 90 AS string)"
_CONTENT = """CASE event_id % 14
  WHEN 0 THEN concat('{"label": "', w, '", "confidence": 0.', n, '}')
  WHEN 1 THEN concat('{"label": "', upper(w), '", "confidence": 1.', n, '}')
  WHEN 2 THEN concat('Sure: {"label": "', w, '", "confidence": 0.', n, '} done')
  WHEN 3 THEN concat('I would say ', w)
  WHEN 4 THEN concat('{"label": "', w, '"}')
  WHEN 5 THEN concat('<think>male? female?</think>  ', w, ' with ', n, '% confidence')
  WHEN 6 THEN concat('male or female: ', n, ' %')
  WHEN 7 THEN 'female or male'
  WHEN 8 THEN ''
  WHEN 9 THEN concat('{"label": ', n, ', "confidence": 0.5}')
  WHEN 10 THEN concat('{"label": "', w, '", "confidence": "high"} ')
  WHEN 11 THEN concat('Female clients spend more, so ', w, '.')
  WHEN 12 THEN props
  ELSE concat('  ', upper(w), ' ') END"""
_REASONING = """CASE event_id % 6
  WHEN 0 THEN concat('Thinking it over. Answer: ', w)
  WHEN 1 THEN concat('Many small shops and few large amounts; the client looks ', w)
  WHEN 2 THEN concat(w, ' clients spend at many places and pay with different cards every single week of a year')
  WHEN 4 THEN ''
  WHEN 5 THEN 'no idea' END"""
_ANSWERS = f"""an AS (SELECT event_id, {_CONTENT} AS content, {_REASONING} AS reasoning
  FROM (SELECT *, {_WORD} AS w, {_NUMBER} AS n FROM events))"""


def _answers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumns({"w": F.expr(_WORD), "n": F.expr(_NUMBER)})
    return rows.select("event_id", F.expr(_CONTENT).alias("content"), F.expr(_REASONING).alias("reasoning"))


def _json_sql(text: str) -> str:
    sure = f"""CASE WHEN json_extract_string({text}, '$.confidence') IS NULL THEN 0.85
      ELSE greatest(0.05, least(0.95, try_cast(json_extract_string({text}, '$.confidence') AS double))) END"""
    cast = f"try_cast(json_extract_string({text}, '$.confidence') AS double)"
    return f"""CASE WHEN json_valid({text}) AND json_type({text}, '$.label') = 'VARCHAR'
      AND (json_extract_string({text}, '$.confidence') IS NULL OR {cast} IS NOT NULL)
    THEN CASE WHEN lower(json_extract_string({text}, '$.label')) = 'male' THEN {sure} ELSE 1 - ({sure}) END END"""


_LAST = r"regexp_extract({t}, '(?s).*\b(male|female)\b', 1)"


@query("parse_json", f"""
WITH {_ANSWERS}, x AS (SELECT *, content || ' ' || coalesce(reasoning, '') AS combined FROM an),
y AS (SELECT *, regexp_extract(combined, '(\\{{[^{{}}]*"label"[^{{}}]*\\}})', 1) AS inner_json,
   {_LAST.format(t='lower(combined)')} AS said,
   lower(regexp_extract(content, '"label"\\s*:\\s*"(\\w+)"', 1)) AS quoted FROM x)
SELECT event_id, {sql_num(f'''coalesce({_json_sql('content')}, {_json_sql('inner_json')},
  CASE said WHEN 'male' THEN 0.85 WHEN 'female' THEN 0.15 END, 0.5)''', 6)} AS prob,
  {sql_num(f'''coalesce({_json_sql('content')}, CASE quoted WHEN 'male' THEN 0.85 WHEN '' THEN NULL ELSE 0.15 END,
  0.5)''', 6)} AS prob_label FROM y""")
def parse_json(spark, sf_dir):
    c, r = F.col("content"), F.col("reasoning")
    return _answers(spark, sf_dir).select(
        "event_id", num(an.parse_json_answer(c, r, "male", "female"), 6).alias("prob"),
        num(an.parse_json_answer(c, r, "male", "female", "label"), 6).alias("prob_label"))


_TEXT = r"""t AS (SELECT event_id, regexp_replace(regexp_replace(lower(content), '(?s)^.*</think>', ''),
     '^\s+|\s+$', '', 'g') AS t FROM an),
s AS (SELECT event_id, t, regexp_matches(t, '\bmale\b') AS p, regexp_matches(t, '\bfemale\b') AS n,
   regexp_extract(t, '(?s).*\b(male|female)\b', 1) = 'male' AS last_pos,
   try_cast(nullif(regexp_extract(t, '(\d{1,3})\s*%', 1), '') AS int) AS pct FROM t),
c AS (SELECT *, greatest(0.05, least(0.95, pct / 100.0)) AS conf FROM s)"""


@query("parse_text", f"""
WITH {_ANSWERS}, {_TEXT}
SELECT event_id, {sql_num('''CASE WHEN pct IS NOT NULL THEN
    CASE WHEN p AND NOT n THEN conf WHEN n AND NOT p THEN 1 - conf WHEN p AND n THEN
      CASE WHEN last_pos THEN conf ELSE 1 - conf END ELSE 0.5 END
  WHEN p AND NOT n THEN 0.85 WHEN n AND NOT p THEN 0.15 WHEN p AND n THEN CASE WHEN last_pos THEN 0.7 ELSE 0.3 END
  ELSE 0.5 END''', 6)} AS prob,
  {sql_num('''CASE WHEN p AND NOT n THEN 0.85 WHEN n AND NOT p THEN 0.15
   WHEN p AND n THEN CASE WHEN last_pos THEN 0.7 ELSE 0.3 END ELSE 0.5 END''', 6)} AS prob_plain,
  {sql_num('''CASE WHEN contains(t, 'male') AND contains(t, 'female') THEN CASE WHEN
      length(t) - instr(reverse(t), 'elam') > length(t) - instr(reverse(t), 'elamef') - 2 THEN 0.7 ELSE 0.3 END
   WHEN contains(t, 'male') THEN 0.85 ELSE 0.5 END''', 6)} AS prob_substring FROM c""")
def parse_text(spark, sf_dir):
    c = F.col("content")
    return _answers(spark, sf_dir).select(
        "event_id", num(an.parse_text_answer(c, "male", "female"), 6).alias("prob"),
        num(an.parse_text_answer(c, "male", "female", percent=False), 6).alias("prob_plain"),
        num(an.parse_text_answer(c, "male", "female", percent=False, legacy_substring=True), 6)
        .alias("prob_substring"))


@query("parse_reasoning", rf"""
WITH {_ANSWERS}, b AS (SELECT event_id, trim(content) = '' AND length(coalesce(reasoning, '')) > 0 AS blank, content,
   lower(coalesce(reasoning, '')) AS r FROM an),
a AS (SELECT *, substr(trim(split_part(r, 'answer:', -1)), 1, 20) AS after FROM b)
SELECT event_id, CASE WHEN NOT blank THEN content ELSE coalesce(
   CASE WHEN contains(r, 'answer:') THEN CASE WHEN regexp_matches(after, '\bmale\b') THEN 'male'
     WHEN regexp_matches(after, '\bfemale\b') THEN 'female' END END,
   nullif({_LAST.format(t='right(r, 50)')}, ''), nullif({_LAST.format(t='r')}, ''), '') END AS answer,
  CASE WHEN NOT blank THEN content ELSE coalesce(
   CASE WHEN contains(r, 'answer:') THEN CASE WHEN regexp_matches(after, '\bmale\b') THEN 'male'
     WHEN regexp_matches(after, '\bfemale\b') THEN 'female' END END,
   nullif({_LAST.format(t='right(r, 50)')}, ''), '') END AS answer_tail FROM a""")
def parse_reasoning(spark, sf_dir):
    c, r = F.col("content"), F.col("reasoning")
    return _answers(spark, sf_dir).select(
        "event_id", an.recover_from_reasoning(c, r, "male", "female").alias("answer"),
        an.recover_from_reasoning(c, r, "male", "female", search_whole=False).alias("answer_tail"))


_RAW = """concat('{"choices": [{"message": {"content": "', w, '", "reasoning": null}, ',
  CASE WHEN event_id % 4 = 0 THEN '"logprobs": null' ELSE concat(
    '"logprobs": {"content": [{"top_logprobs": [{"token": " Male", "logprob": -', cast(event_id % 9 AS string), '.', n,
    '}, {"token": "fem", "logprob": -', cast(event_id * 7 % 8 AS string), '.5}, {"token": "ma", "logprob": -3.25}, ',
    '{"token": "other", "logprob": -0.1}]}]}') END,
  '}], "usage": {"prompt_tokens": ', n, ', "completion_tokens": 7}}')"""
_RESPONSES = f"""rs AS (SELECT event_id, {_RAW} AS raw FROM (SELECT *, {_WORD} AS w, {_NUMBER} AS n FROM events))"""


@query("token_probability", f"""
WITH {_RESPONSES}, tk AS (SELECT event_id, unnest(from_json(json_extract(raw,
    '$.choices[0].logprobs.content[0].top_logprobs'), '[{{"token":"VARCHAR","logprob":"DOUBLE"}}]')) AS t FROM rs),
s AS (SELECT event_id, sum(exp(t.logprob)) FILTER (lower(trim(t.token)) IN ('male', 'ma')) AS p,
   sum(exp(t.logprob)) FILTER (lower(trim(t.token)) = 'fem') AS n FROM tk GROUP BY event_id)
SELECT event_id, {sql_num('CASE WHEN p + n > 0.01 THEN p / (p + n) END', 6)} AS token_prob,
  {sql_num('''coalesce(CASE WHEN p + n > 0.01 THEN p / (p + n) END,
   CASE json_extract_string(raw, '$.choices[0].message.content') WHEN 'male' THEN 0.85 ELSE 0.15 END)''', 6)} AS prob,
  json_extract(raw, '$.usage.prompt_tokens')::bigint AS prompt_tokens
FROM rs LEFT JOIN s USING (event_id)""")
def token_probability(spark, sf_dir):
    raw = F.expr(_RAW)
    rows = (table(spark, sf_dir, "events").withColumns({"w": F.expr(_WORD), "n": F.expr(_NUMBER)})
            .select("event_id", raw.alias("raw")))
    parts = an.response_parts(F.col("raw"))
    return rows.select(
        "event_id", num(an.token_probability(parts["top_logprobs"], "male", "female"), 6).alias("token_prob"),
        num(an.answer_probability(F.col("raw"), "male", "female"), 6).alias("prob"),
        parts["prompt_tokens"].alias("prompt_tokens"))


@query("class_probability", f"""
WITH x AS (SELECT vec_id, i, (i - 1) % 4 AS cls, embedding[i]::double * 5 AS s FROM embeddings,
   (SELECT unnest(range(1, 65))::int AS i)),
p AS (SELECT vec_id, i, cls, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS p,
   exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS b FROM x),
c AS (SELECT vec_id, cls, sum(p) AS p FROM p GROUP BY ALL)
SELECT vec_id, string_agg(printf('%.5f', round(p, 8)), ',' ORDER BY cls) AS probs,
  arg_min(cls, (-p, cls))::int AS predicted, any_value(l.lp) AS logit_prob
FROM c JOIN (SELECT vec_id, {sql_num('sum(b) FILTER (i <= 32)', 6)} AS lp FROM p GROUP BY vec_id) l
USING (vec_id) GROUP BY vec_id""")
def class_probability(spark, sf_dir):
    def scaled(start, n):
        return F.transform(F.slice("embedding", start, n), lambda x: x.cast("double") * 5)
    scores = F.transform(scaled(1, 64), lambda x, i: F.struct((i % 4).alias("cls"), x.alias("score")))
    probs = an.class_probability(scores, 4)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array_join(F.transform(probs, lambda p: F.call_function(
            "format_number", F.round(p, 8), F.lit("0.00000"))), ",").alias("probs"),
        argmax_class(probs).alias("predicted"),
        num(an.logit_probability(scaled(1, 32), scaled(33, 32)), 6).alias("logit_prob"))


_CLASS_TEXT = """CASE event_id % 7 WHEN 0 THEN concat('{"label": ', cast(event_id % 5 AS string), '}')
  WHEN 1 THEN concat('the "label": ', cast(event_id % 6 AS string), ' fits')
  WHEN 2 THEN concat('class 1 or ', cast(event_id % 10 AS string)) WHEN 3 THEN 'none'
  WHEN 4 THEN concat('{"label": "', cast(event_id % 4 AS string), '", "confidence": 0.8}')
  WHEN 5 THEN '' ELSE concat('9 then 2, 8 and ', cast(value AS string)) END"""


@query("parse_class", rf"""
WITH t AS (SELECT event_id, {_CLASS_TEXT} AS c FROM events)
SELECT event_id, coalesce(CASE WHEN json_valid(c) THEN try_cast(json_extract_string(c, '$.label') AS int) END,
  try_cast(nullif(regexp_extract(c, '"label"\s*:\s*(\d)', 1), '') AS int),
  try_cast(nullif(right(regexp_replace(c, '[^0-3]', '', 'g'), 1), '') AS int), -1) AS cls FROM t""")
def parse_class(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", an.parse_class_answer(F.expr(_CLASS_TEXT)).alias("cls"))


# --- cost, budget, resuming -------------------------------------------------

_MODELS = list(scoring.PRICES) + ["unlisted"]
_CALLS = """event_type AS run_id, event_id AS seq, user_id % 6 AS model_no,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE 100 + event_id % 900 END AS prompt_tokens,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 1 + event_id % 50 END AS completion_tokens"""
_COSTS = f"""co AS (SELECT *, (coalesce(prompt_tokens, 500) * [0.10, 0.0, 0.10, 0.10, 0.30, 1.0][model_no + 1]
    + coalesce(completion_tokens, 5) * [0.15, 0.0, 0.30, 0.30, 0.90, 3.0][model_no + 1]) / 1000000 AS cost
  FROM (SELECT {_CALLS} FROM events))"""


def _calls(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(*[p.strip() for p in _split_columns(_CALLS)])
    names = F.array(*[F.lit(m) for m in _MODELS])
    return scoring.call_cost(rows.withColumn("model", F.element_at(names, (F.col("model_no") + 1).cast("int"))))


def _split_columns(text: str) -> list[str]:
    return text.replace("\n", " ").split(",")


@query("budget", f"""
WITH {_COSTS}, r AS (SELECT run_id, seq, cost, sum(cost) OVER (PARTITION BY run_id ORDER BY seq) AS spent FROM co)
SELECT run_id, seq, {sql_num('cost', 8)} AS cost, {sql_num('spent', 6)} AS spent,
  round(spent - cost, 9) <= 0.05 AS sent FROM r""")
def budget(spark, sf_dir):
    result = scoring.apply_budget(_calls(spark, sf_dir), 0.05)
    return result.select("run_id", "seq", num("cost", 8).alias("cost"), num("spent", 6).alias("spent"), "sent")


@query("usage_summary", f"""
WITH {_COSTS} SELECT run_id, {sql_num('sum(cost)', 6)} AS total_cost, count(*) AS calls,
  {sql_num('count(*) / greatest(max(seq) - min(seq), 0.1)', 6)} AS calls_per_second,
  {sql_num('sum(coalesce(prompt_tokens, 500) * 0.2 + coalesce(completion_tokens, 50) * 0.4) / 1000000', 6)} AS flat
FROM co GROUP BY run_id""")
def usage_summary(spark, sf_dir):
    calls = _calls(spark, sf_dir).withColumn("flat", scoring.flat_cost())
    flat = calls.groupBy("run_id").agg(num(F.sum("flat"), 6).alias("flat"))
    usage = scoring.usage_summary(calls, started="seq")
    return usage.select("run_id", num("total_cost", 6).alias("total_cost"), "calls",
                        num("calls_per_second", 6).alias("calls_per_second")).join(flat, "run_id")


@query("resume", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax > 0.05)""")
def resume(spark, sf_dir):
    todo = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    done = table(spark, sf_dir, "lineitem").where("l_tax > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return resume_scoring(todo, done, ["o_orderkey"])


@query("skip_completed_cells", """
WITH g AS (SELECT r_name AS model, s AS strategy, e AS enrichment, r_name || '_' || s || '_' || e AS tag FROM region,
   (SELECT unnest(['zero_shot', 'few_shot', 'cot']) AS s), (SELECT unnest(['none', 'shap', 'knn', 'both']) AS e))
SELECT * FROM g WHERE tag NOT IN (SELECT r_name || '_' || CASE n_nationkey % 2 WHEN 0 THEN 'cot_knn' ELSE
   'zero_shot_none' END FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0)""")
def skip_cells(spark, sf_dir):
    regions = table(spark, sf_dir, "region")
    cells = prompts.prompt_grid(spark, ["cell"]).drop("model", "tag")
    grid = prompts.spread_over_grid(regions.select(F.col("r_name").alias("model")), cells)
    grid = grid.withColumn("tag", F.concat_ws("_", "model", "strategy", "enrichment"))
    done = (table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0")
            .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.concat_ws("_", "r_name", F.when(F.col("n_nationkey") % 2 == 0, "cot_knn")
                                .otherwise("zero_shot_none")).alias("tag")))
    return skip_completed_cells(grid, done)


@query("result_record", f"""
SELECT n_name AS experiment_id, CASE n_regionkey % 2 WHEN 0 THEN 'binary' ELSE 'multiclass' END AS task_type,
  'RQ1' AS rq, {sql_num('avg(c_acctbal)')} AS accuracy, count(*)::double AS n_test, 42 AS seed
FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_regionkey""")
def result_records(spark, sf_dir):
    runs = (table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"),
                                                  F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("n_name", "n_regionkey").agg(F.avg("c_acctbal").alias("a"), F.count(F.lit(1)).alias("n"))
            .withColumn("metrics", F.create_map(F.lit("accuracy"), num("a"), F.lit("n_test"), F.col("n").cast("double"))))
    task = F.when(F.col("n_regionkey") % 2 == 0, "binary").otherwise("multiclass")
    records = result_record(runs, task, "RQ1", {"experiment_id": F.col("n_name"), "method": F.lit("mean"),
                                                "dataset": F.lit("customer")}, {"k": "10"})
    return records.select("experiment_id", "task_type", "rq", F.col("metrics")["accuracy"].alias("accuracy"),
                          F.col("metrics")["n_test"].alias("n_test"), "seed")


# --- evidence and prompts ---------------------------------------------------

# Weights of the linear model explained here.
_W = {"n_tx": 0.02, "mean_amt": -0.01, "std_amt": 0.004, "median_amt": 0.03, "n_mcc": 0.5}
_FEATURES = """ft AS (SELECT customer_id, count(*)::double AS n_tx, avg(abs(amount)) AS mean_amt,
   stddev_pop(abs(amount)) AS std_amt, median(abs(amount)) AS median_amt, count(DISTINCT category)::double AS n_mcc
  FROM ev GROUP BY customer_id),
ph AS (SELECT customer_id, unnest(range(0, 5))::int AS i, unnest(['n_tx', 'mean_amt', 'std_amt', 'median_amt', 'n_mcc'])
    AS feature, unnest([n_tx, mean_amt, std_amt, median_amt, n_mcc]) AS value,
   unnest([0.02 * (n_tx - (SELECT avg(n_tx) FROM ft)), -0.01 * (mean_amt - (SELECT avg(mean_amt) FROM ft)),
     0.004 * (std_amt - (SELECT avg(std_amt) FROM ft)), 0.03 * (median_amt - (SELECT avg(median_amt) FROM ft)),
     0.5 * (n_mcc - (SELECT avg(n_mcc) FROM ft))]) AS phi FROM ft)"""


def _attributions(spark, sf_dir):
    features = aggregates.client_features(clicks(spark, sf_dir))
    return evidence.linear_attribution(features, _W, features)


@query("linear_attribution", f"""
WITH {CLICKS}, {_FEATURES} SELECT customer_id, feature, {sql_num('value')} AS value, {sql_num('phi', 6)} AS phi
FROM ph""")
def linear_attribution(spark, sf_dir):
    rows = _attributions(spark, sf_dir).select("customer_id", F.inline("attributions"))
    return rows.select("customer_id", "feature", num("value").alias("value"), num("phi", 6).alias("phi"))


@query("top_factors", f"""
WITH {CLICKS}, {_FEATURES}, r AS (SELECT *, row_number() OVER (PARTITION BY customer_id
   ORDER BY -abs(round(phi, 9)), i) AS place FROM ph)
SELECT customer_id, string_agg(feature, ';' ORDER BY place) AS factors FROM r WHERE place <= 3 GROUP BY customer_id""")
def top_factors(spark, sf_dir):
    return _attributions(spark, sf_dir).select("customer_id", F.array_join(F.transform(
        evidence.top_factors(F.col("attributions"), 3), lambda x: x["feature"]), ";").alias("factors"))


# A probability and neighbour votes made from the id.
_SIGNALS = """sg AS (SELECT customer_id, (customer_id * 7919 % 997) / 996.0::double AS prob,
   (customer_id * 31 % 11)::int AS pos, 10 - (customer_id * 31 % 11)::int AS neg FROM ft)"""
_FACTORS = f"""fa AS (SELECT customer_id,
   string_agg(feature || '=' || {f0('value')} || ' (' || CASE WHEN phi > 0 THEN 'supports male)' ELSE 'against male)'
     END, '; ' ORDER BY place) AS factors,
   string_agg(feature || ' (' || CASE WHEN phi > 0 THEN 'increases' ELSE 'decreases' END || ', impact='
     || printf('%.3f', round(abs(phi), 6)) || ')', '; ' ORDER BY place) AS impacts
  FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY -abs(round(phi, 9)), i) AS place FROM ph)
  WHERE place <= 3 GROUP BY customer_id)"""
_YES = "CASE WHEN prob > 0.5 THEN 'male' ELSE 'female' END"
_SURE = f"{f0('CASE WHEN prob > 0.5 THEN prob ELSE 1 - prob END * 100')} || '%'"
_SHAP = (f"(chr(10) || 'ML model: predicts ' || {_YES} || ' (' || {_SURE} || ' confidence).' || chr(10) "
         "|| 'Key factors: ' || factors || '.' || chr(10))")
_VOTES = "pos || ' male, ' || neg || ' female'"
_MAJORITY = "CASE WHEN pos > neg THEN 'male' ELSE 'female' END"
_KNN = f"(chr(10) || 'Similar clients: ' || {_VOTES} || ' (majority: ' || {_MAJORITY} || ').' || chr(10))"


def _signals(spark, sf_dir):
    c = F.col("customer_id")
    pos = (c * 31 % 11).cast("int")
    return _attributions(spark, sf_dir).select(
        "customer_id", ((c * 7919 % 997) / F.lit(996.0)).alias("prob"), pos.alias("pos"), (10 - pos).alias("neg"),
        (pos > 5).cast("int").alias("majority"), evidence.top_factors(F.col("attributions"), 3).alias("factors"))


def _votes():
    return F.col("pos"), F.col("neg"), F.col("majority")


def _evidence(kind, **options):
    return evidence.evidence_text(kind, "male", "female", F.col("prob"), F.col("factors"), _votes(), **options)


@query("evidence_text", f"""
WITH {CLICKS}, {_FEATURES}, {_SIGNALS}, {_FACTORS}
SELECT customer_id, {_SHAP} AS shap, {_KNN} AS knn, {_SHAP} || {_KNN} AS both,
  chr(10) || 'ML model: ' || {_YES} || ' (' || {_SURE} || '). Factors: ' || factors || '.' || chr(10)
   || 'Similar clients: ' || {_VOTES} || '.' || chr(10) AS compact,
  'ML model: predicts ' || CASE WHEN prob >= 0.5 THEN 'male' ELSE 'female' END || ' ('
   || {f0('CASE WHEN prob >= 0.5 THEN prob ELSE 1 - prob END * 100')} || '% confidence).' AS prediction,
  'XGBoost predicts ''' || {_YES} || ''' (' || {f0('prob * 100')} || '% male confidence). Key factors: ' || impacts
   || '.' AS sentence,
  'Similar clients (top-10 nearest by transaction patterns): ' || {_VOTES} || ' (majority: ' || {_MAJORITY} || ').'
   AS neighbours, chr(10) || 'Similar clients: ' || {_VOTES} || '.' AS counts,
  'ML predicts ''' || CASE WHEN prob > 0.5 THEN 'churn' ELSE 'stay' END || ''' (' || {f0('prob * 100')}
   || '% churn prob). Key: ' || replace(impacts, 'impact=', '') || '.' AS churn_sentence
FROM sg JOIN fa USING (customer_id)""")
def evidence_texts(spark, sf_dir):
    return _signals(spark, sf_dir).select(
        "customer_id", _evidence("shap").alias("shap"), _evidence("knn").alias("knn"), _evidence("both").alias("both"),
        _evidence("both", joint="compact").alias("compact"), _evidence("prediction").alias("prediction"),
        evidence.impact_sentence(F.col("prob"), F.col("factors"), "male", "female").alias("sentence"),
        evidence.knn_sentence(_votes(), "male", "female").alias("neighbours"), _evidence("counts").alias("counts"),
        evidence.churn_sentence(F.col("prob"), F.col("factors")).alias("churn_sentence"))


_AGE_NAME = """CASE {c} WHEN 0 THEN 'young (under 25)' WHEN 1 THEN 'adult (25-35)' WHEN 2 THEN 'middle-aged (35-55)'
  ELSE 'senior (over 55)' END"""
_AGE_FACTORS = f"""af AS (SELECT customer_id, string_agg(feature || '=' || {f0('value')} || ' ('
     || CASE WHEN phi > 0 THEN 'high' ELSE 'low' END || ' → ' || {_AGE_NAME.format(c='customer_id % 4')} || ')',
     '; ' ORDER BY place) AS factors,
   string_agg(feature || ' (' || printf('%.3f', round(abs(phi), 6)) || ')', '; ' ORDER BY place) AS sizes
  FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY -abs(round(phi, 9)), i) AS place FROM ph)
  WHERE place <= 3 GROUP BY customer_id),
ct AS (SELECT customer_id, (customer_id % 5)::int AS a, (customer_id % 3)::int AS b, (customer_id % 2)::int AS c,
   (10 - customer_id % 5 - customer_id % 3 - customer_id % 2)::int AS d FROM ft)"""


@query("class_evidence", f"""
WITH {CLICKS}, {_FEATURES}, {_AGE_FACTORS}, x AS (SELECT *, 'young=' || a || ', adult=' || b || ', middle=' || c
   || ', senior=' || d AS near, greatest(a, b, c, d) AS m FROM ct JOIN af USING (customer_id)),
y AS (SELECT *, CASE m WHEN a THEN 0 WHEN b THEN 1 WHEN c THEN 2 ELSE 3 END AS top FROM x)
SELECT customer_id, 'ML model analysis:' || chr(10) || 'XGBoost predicts: ' || {_AGE_NAME.format(c='customer_id % 4')}
   || '.' || chr(10) || 'Key factors: ' || factors || '.' AS shap,
  'Similar clients analysis:' || chr(10) || 'Among 10 most similar clients: ' || near || '.' || chr(10)
   || 'Most common age group: ' || {_AGE_NAME.format(c='top')} || ' (' || (m * 10) || '% of neighbors).' AS knn,
  'Evidence 1 - ML model:' || chr(10) || 'XGBoost predicts: ' || {_AGE_NAME.format(c='customer_id % 4')} || '.'
   || chr(10) || 'Key factors: ' || factors || '.' || chr(10) || chr(10) || 'Evidence 2 - Similar clients:' || chr(10)
   || 'Among 10 similar clients: ' || near || '.' || chr(10) || 'Majority: ' || {_AGE_NAME.format(c='top')} || '.'
   AS both, 'ML predicts ''' || {_AGE_NAME.format(c='customer_id % 4')} || '''. Key factors: ' || sizes || '.'
   AS sentence FROM y""")
def class_evidence(spark, sf_dir):
    c = F.col("customer_id")
    rows = _signals(spark, sf_dir).withColumns({
        "cls": (c % 4).cast("int"),
        "counts": F.array(c % 5, c % 3, c % 2, 10 - c % 5 - c % 3 - c % 2)})

    def text(kind):
        return evidence.class_evidence(kind, prompts.AGE_LABELS, prompts.AGE_SHORT, F.col("cls"), F.col("factors"),
                                       F.col("counts")).alias(kind)
    return rows.select("customer_id", text("shap"), text("knn"), text("both"), evidence.class_sentence(
        F.col("cls"), F.col("factors"), prompts.AGE_LABELS).alias("sentence"))


_BRIEF = f"""{stats(merchant(SHORT), CLICK_ORDER)},
{top(6, "cat || ' (' || cnt || ')'")},
pf AS (SELECT customer_id, 'Client with ' || n || ' txns. Avg amount: ' || {f0('mean')} || '. Categories: ' || top || '.'
   AS profile FROM st JOIN tp USING (customer_id))"""


def _brief(spark, sf_dir):
    return profiles.brief_profile(with_merchant(clicks(spark, sf_dir)), "merchant")


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BLOCK = """bl AS (SELECT string_agg('Example ' || (2 - y) || ':' || chr(10) || profile || chr(10) || 'Answer: '
   || CASE y WHEN 1 THEN 'male' ELSE 'female' END || chr(10) || chr(10), '' ORDER BY y DESC) AS block
  FROM (SELECT y, arg_min(profile, customer_id) AS profile FROM (SELECT *, customer_id % 2 AS y FROM pf) GROUP BY y))"""
_ASK = ("chr(10) || chr(10) || 'Respond with ONLY one word: male or female. Write your answer after ''ANSWER:'''")


def _few_shot(spark, sf_dir, profile_table):
    labelled = profile_table.join(click_labels(spark, sf_dir), "customer_id")
    first = sampling.first_per_class(labelled, "customer_id", keep=["profile"])
    return prompts.few_shot_block(first.select(
        (2 - F.col("target")).alias("position"), "profile",
        F.when(F.col("target") == 1, "male").otherwise("female").alias("label")))


@query("messages", f"""
WITH {CLICKS}, {_FEATURES}, {_SIGNALS}, {_FACTORS}, {_BRIEF}, {_BLOCK},
g AS (SELECT unnest(['zero_shot', 'few_shot', 'cot']) AS strategy),
h AS (SELECT unnest(['none', 'shap', 'knn', 'both']) AS enrichment),
x AS (SELECT customer_id, strategy, enrichment, profile, block, CASE enrichment WHEN 'none' THEN ''
    WHEN 'shap' THEN {_SHAP} WHEN 'knn' THEN {_KNN} ELSE {_SHAP} || {_KNN} END AS evidence
  FROM pf JOIN sg USING (customer_id) JOIN fa USING (customer_id), g, h, bl)
SELECT customer_id, strategy, enrichment,
  {_quote(prompts.GENDER.expert)} || CASE enrichment WHEN 'none' THEN '' ELSE {_quote(prompts.WITH_ANALYSIS)} END
    AS system,
  CASE strategy WHEN 'few_shot' THEN block || 'Now predict:' || chr(10) || profile || evidence || {_ASK}
   WHEN 'cot' THEN profile || evidence || chr(10) || 'Analyze the transaction patterns step by step, then give your '
     || 'final prediction: male or female.' ELSE profile || evidence || {_ASK} END AS user_text FROM x""")
def messages(spark, sf_dir):
    brief = _brief(spark, sf_dir)
    block = _few_shot(spark, sf_dir, brief).scalar()
    rows = brief.join(_signals(spark, sf_dir), "customer_id").withColumn("block", block)
    grid = prompts.prompt_grid(spark, ["m"]).drop("model", "tag")
    cells = prompts.spread_over_grid(rows, grid)
    kind = F.col("enrichment")
    text = (F.when(kind == "shap", _evidence("shap")).when(kind == "knn", _evidence("knn"))
            .when(kind == "both", _evidence("both")).otherwise(""))
    made = cells.withColumn("evidence", text).withColumn("messages", prompts.build_messages(
        prompts.GENDER, F.col("strategy"), F.col("evidence"), F.col("profile"), F.col("block")))
    return made.select("customer_id", "strategy", "enrichment", F.col("messages")[0]["content"].alias("system"),
                       F.col("messages")[1]["content"].alias("user_text"))


@query("message_forms", f"""
WITH {CLICKS}, {_FEATURES}, {_SIGNALS}, {_FACTORS}, {_BRIEF}, {_BLOCK}
SELECT customer_id,
  'Profile:' || chr(10) || profile || {_KNN} || chr(10) || 'Predict.' AS matrix_user,
  'You are a bank analyst predicting client gender (male or female). You have ML analysis. Answer: male or female.'
    AS matrix_system,
  profile || chr(10) || chr(10) || 'Classify this client. Output JSON: '
    || '{{"label": "male" or "female", "confidence": 0-1}}' AS json_user,
  profile || chr(10) || chr(10) || 'ML model: predicts ' || CASE WHEN prob >= 0.5 THEN 'male' ELSE 'female' END || ' ('
    || {f0('CASE WHEN prob >= 0.5 THEN prob ELSE 1 - prob END * 100')} || '% confidence).' || chr(10) || chr(10)
    || 'Classify. Output JSON: {{"reasoning": "analysis", "label": "male" or "female", "confidence": 0-1}}'
    AS prediction_user,
  profile || chr(10) || 'Similar clients (top-10 nearest by transaction patterns): ' || {_VOTES} || ' (majority: '
    || {_MAJORITY} || ').' || chr(10) || chr(10) || 'Based on the transaction profile and the similar clients above, '
    || 'predict the customer''s gender. Answer with exactly one word: male or female.' AS ladder_user,
  'Customer transaction profile:' || chr(10) || profile || chr(10) || chr(10) || 'Machine learning analysis:' || chr(10)
    || 'XGBoost predicts ''' || {_YES} || ''' (' || {f0('prob * 100')} || '% male confidence). Key factors: '
    || impacts || '.' || chr(10) || chr(10) || 'Predict the customer''s gender.' AS enriched_user,
  'Examples:' || chr(10) || 'x' || chr(10) || 'Now predict:' || chr(10) || profile AS churn_few_shot
FROM pf JOIN sg USING (customer_id) JOIN fa USING (customer_id)""")
def message_forms(spark, sf_dir):
    rows = _brief(spark, sf_dir).join(_signals(spark, sf_dir), "customer_id")
    p, g = F.col("profile"), prompts.GENDER
    matrix = prompts.matrix_messages(g, F.lit("zero_shot"), _evidence("knn"), p)
    impact = evidence.impact_sentence(F.col("prob"), F.col("factors"), "male", "female")
    return rows.select(
        "customer_id", matrix[1]["content"].alias("matrix_user"), matrix[0]["content"].alias("matrix_system"),
        prompts.json_messages(g, p)[1]["content"].alias("json_user"),
        prompts.prediction_messages(g, p, _evidence("prediction"))[1]["content"].alias("prediction_user"),
        prompts.ladder_messages(g, p, evidence.knn_sentence(_votes(), "male", "female"))[1]["content"]
        .alias("ladder_user"),
        prompts.profile_messages("gender", "shap_enriched", p, impact)[1]["content"].alias("enriched_user"),
        prompts.profile_messages("churn", "few_shot", p, examples=F.lit("\nx"))[1]["content"].alias("churn_few_shot"))


@query("prompt_grid", """
SELECT c_custkey AS customer_id, m AS model, s AS strategy, e AS enrichment, m || '_' || s || '_' || e AS tag
FROM customer, (SELECT unnest(['small', 'large']) AS m), (SELECT unnest(['zero_shot', 'few_shot', 'cot']) AS s),
  (SELECT unnest(['none', 'shap', 'knn', 'both']) AS e)""")
def prompt_grid(spark, sf_dir):
    clients = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    return prompts.spread_over_grid(clients, prompts.prompt_grid(spark, ["small", "large"]))


_COT = """concat_ws(' ', 'Client has ' || coalesce(nullif(regexp_extract(profile, 'Transactions:\\s*(\\d+)', 1), '')::bigint,
   0) || ' transactions with average amount ' || avg_amount || ' RUB.', 'Top spending categories: '
   || substr(tops, 1, 100) || '.',
  CASE WHEN contains(tops, 'Retail') OR contains(tops, 'Clothing')
    THEN 'High retail/clothing spending is a characteristic pattern.' END,
  CASE WHEN contains(tops, 'Transportation') THEN 'Significant transportation spending observed.' END,
  CASE WHEN avg_amount > 3000 THEN 'Higher-than-average ticket size suggests premium behavior.' END,
  'Based on these patterns, classification: ' || label || '.')"""
_FULL = f"""{stats(merchant(SHORT), CLICK_ORDER)},
{top(6, "cat || ' (' || cnt || ' txns, ' || (cnt * 100 // n) || '%)'")},
pf AS (SELECT customer_id, 'Client profile:' || chr(10) || '- Transactions: ' || n || ' over ' || greatest(1, span // 30)
   || ' months (' || (n // greatest(1, span // 30)) || '/month)' || chr(10) || '- Spending: avg ' || {f0('mean')}
   || ' RUB, median ' || {f0('med')} || ', max ' || {f0('mx')} || chr(10) || '- Top categories: ' || top || chr(10)
   || '- Time pattern: ' || {f0('daytime * 100 / n')} || '% daytime, ' || {f0('late * 100 / n')} || '% evening'
   AS profile FROM st JOIN tp USING (customer_id)),
pq AS (SELECT *, CASE customer_id % 2 WHEN 1 THEN 'male' ELSE 'female' END AS label,
   coalesce(nullif(regexp_extract(profile, 'avg\\s*(\\d+)', 1), '')::bigint, 0) AS avg_amount,
   regexp_extract(profile, 'Top categories:\\s*([^\\n]+)', 1) AS tops FROM pf)"""


def _labelled_profiles(spark, sf_dir):
    full = profiles.client_profile(with_merchant(clicks(spark, sf_dir)), "merchant")
    return full.withColumn("label", F.when(F.col("customer_id") % 2 == 1, "male").otherwise("female"))


@query("cot_reasoning", f"WITH {CLICKS}, {_FULL} SELECT customer_id, {_COT} AS reasoning FROM pq")
def cot_reasoning(spark, sf_dir):
    return _labelled_profiles(spark, sf_dir).select(
        "customer_id", prompts.cot_reasoning(F.col("profile"), F.col("label")).alias("reasoning"))


def _ranked(source: str, group: str, seed: int = 42, key: str = "customer_id") -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {hash_order(key, seed)}, {key}) AS rn, "
            f"count(*) OVER (PARTITION BY {group}) AS n FROM {source}")


@query("demo_messages", f"""
WITH {CLICKS}, {_FULL}, lb AS (SELECT customer_id, customer_id % 2 AS target FROM pf), sp AS ({_ranked('lb', 'target')}),
base AS (SELECT customer_id, target FROM sp WHERE rn > round(0.1 * n)),
q AS (SELECT customer_id AS query_id FROM sp WHERE rn <= round(0.1 * n)),
b AS ({_ranked('base', 'target')}), sz AS (SELECT target, count(*) AS n FROM base GROUP BY target),
w AS (SELECT query_id, target, n, ('0x' || substr({hash_order("query_id || '-' || target")}, 1, 8))::bigint % n AS st
  FROM q, sz),
d AS (SELECT query_id, customer_id, {hash_order("query_id || '-' || customer_id")} AS o
  FROM w JOIN b ON b.target = w.target AND b.rn = st + 1)
SELECT query_id, string_agg('user:' || profile || chr(10) || 'Classify this client.|assistant:{{"reasoning": "'
   || {_COT} || '", "label": "' || label || '", "confidence": 0.9}}', '|' ORDER BY o, customer_id) AS turns
FROM d JOIN pq USING (customer_id) GROUP BY query_id""")
def demo_messages(spark, sf_dir):
    split = sampling.stratified_split(click_labels(spark, sf_dir))
    demos = sampling.random_demos(split.where("split = 'test'"), split.where("split = 'train'"), 1)
    turns = prompts.demo_messages(demos.join(_labelled_profiles(spark, sf_dir), "customer_id"), cot=True)
    return turns.select("query_id", F.array_join(F.transform(
        "demos", lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("turns"))


@query("nearest_demo_messages", f"""
WITH {VECTORS}, {CLICKS}, {_FULL},
cl AS (SELECT pq.* REPLACE (CASE binary_target WHEN 1 THEN 'male' ELSE 'female' END AS label), binary_target AS target,
  embedding FROM pq JOIN vec USING (customer_id)),
sp AS (SELECT *, rn <= round(0.1 * n) AS is_test FROM ({_ranked('cl', 'target')})),
x AS (SELECT customer_id, is_test, unnest(embedding)::double AS v, unnest(range(1, 65)) AS d FROM sp),
m AS (SELECT d, max(abs(v)) AS top FROM x WHERE NOT is_test GROUP BY d),
s AS (SELECT customer_id, list(CASE WHEN m.top > 0 THEN v / m.top ELSE v END ORDER BY d) AS e FROM x JOIN m USING (d) GROUP BY ALL),
d AS (SELECT q.customer_id AS query_id, b.customer_id, b.target, round(1 - list_cosine_similarity(sq.e, sb.e), 9) AS distance
  FROM sp q JOIN sp b ON q.is_test AND NOT b.is_test JOIN s sq ON sq.customer_id = q.customer_id
  JOIN s sb ON sb.customer_id = b.customer_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, customer_id) AS place,
  row_number() OVER (PARTITION BY query_id, target ORDER BY distance, customer_id) AS own,
  {hash_order("query_id || '-' || customer_id")} AS o FROM d),
v AS (SELECT query_id, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target <> 1) AS neg FROM nn WHERE place <= 10
  GROUP BY query_id),
t AS (SELECT query_id, string_agg('user:' || profile || chr(10) || 'Classify this client.|assistant:{{"reasoning": "'
   || {_COT} || '", "label": "' || label || '", "confidence": 0.9}}', '|' ORDER BY o, customer_id) AS turns
  FROM nn JOIN cl USING (customer_id) WHERE own <= 2 GROUP BY query_id)
SELECT query_id, 'system:{prompts.GENDER.expert}|' || turns || '|user:' || profile || chr(10) || 'Similar clients: '
   || {_VOTES} || '.' || chr(10) || chr(10) || 'Classify this client. Output JSON: {{"reasoning": "analysis (≤80 words)", '
   || '"label": "male" or "female", "confidence": 0-1}}' AS messages
FROM t JOIN v USING (query_id) JOIN cl ON cl.customer_id = query_id""")
def nearest_demo_messages(spark, sf_dir):
    """Reasoned demonstrations nearest to the client, of both classes, and the votes of its neighbours."""
    known = _labelled_profiles(spark, sf_dir).select("customer_id", "profile")
    clients = vectors(spark, sf_dir).select("customer_id", "embedding", F.col("binary_target").alias("target")).join(
        known, "customer_id").withColumn("label", F.when(F.col("target") == 1, "male").otherwise("female"))
    split = sampling.stratified_split(clients)
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    demos = knn.nearest_demos(test, train, 2).drop("target")
    turns = prompts.demo_messages(demos.join(train, "customer_id"), cot=True)
    near = knn.knn_join(vec.max_abs_scale(train, test), vec.max_abs_scale(train, train), 10)
    votes = evidence.knn_vote_binary(near, train)
    counts = evidence.evidence_text("counts", "male", "female", votes=_votes())
    asked = test.withColumnRenamed("customer_id", "query_id").join(votes, "query_id").join(turns, "query_id")
    messages = prompts.demo_strategy_messages(prompts.GENDER, "few_shot_cot_knn", F.col("profile"), counts, F.col("demos"))
    return asked.select("query_id", F.array_join(F.transform(
        messages, lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("messages"))


@query("few_shot_block", f"WITH {CLICKS}, {_BRIEF}, {_BLOCK} SELECT block FROM bl")
def few_shot_block(spark, sf_dir):
    return _few_shot(spark, sf_dir, _brief(spark, sf_dir))


@query("first_per_class", """
SELECT label AS target, min(vec_id) AS customer_id FROM embeddings GROUP BY label""")
def first_per_class(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("customer_id"), F.col("label").alias("target"))
    return sampling.first_per_class(rows, "customer_id")


@query("extreme_examples", """
WITH p AS (SELECT user_id AS customer_id, max(value) AS prob FROM events GROUP BY user_id)
SELECT 'highest' AS "end", arg_min(customer_id, (-prob, customer_id)) AS customer_id FROM p
UNION ALL SELECT 'lowest', arg_min(customer_id, (prob, customer_id)) FROM p""")
def extreme_examples(spark, sf_dir):
    preds = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("customer_id")).agg(
        F.max("value").alias("pred_prob"))
    return sampling.extreme_examples(preds)


def md5_scorer(chats: list[list[dict[str, str]]]) -> list[str]:
    """A stand-in model: label and confidence from the md5 of the question."""
    out = []
    for chat in chats:
        number = int(hashlib.md5(chat[-1]["content"].encode()).hexdigest()[:8], 16)
        answer = {"label": "male" if number % 2 else "female", "confidence": (50 + number % 50) / 100}
        out.append(json.dumps({"choices": [{"message": {"content": json.dumps(answer), "reasoning": None}}],
                               "usage": {"prompt_tokens": 100 + number % 400, "completion_tokens": 12}}))
    return out


@query("score_prompts", f"""
WITH {CLICKS}, {_BRIEF}, h AS (SELECT customer_id, ('0x' || substr(md5(profile || chr(10) || chr(10)
   || 'Classify this client. Output JSON: {{"label": "male" or "female", "confidence": 0-1}}'), 1, 8))::bigint AS x
  FROM pf)
SELECT customer_id, 'ok' AS status, 1 AS attempts, 100 + x % 400 AS prompt_tokens, {sql_num(
   'CASE x % 2 WHEN 1 THEN least(0.95, (50 + x % 50) / 100) ELSE 1 - least(0.95, (50 + x % 50) / 100) END', 6)} AS prob
FROM h""")
def score_prompts(spark, sf_dir):
    asked = _brief(spark, sf_dir).withColumn("messages", prompts.json_messages(prompts.GENDER, F.col("profile")))
    raw = scoring.score_prompts(asked, md5_scorer, ["customer_id"])
    parts = an.response_parts(F.col("response"))
    prob = an.parse_json_answer(parts["content"], parts["reasoning"], "male", "female")
    return raw.select("customer_id", "status", "attempts", parts["prompt_tokens"].alias("prompt_tokens"),
                      num(prob, 6).alias("prob"))
