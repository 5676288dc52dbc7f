"""Vectors, neighbours, metrics and losses over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clienttrace.functions import vectors as fv
from clienttrace.operators import evidence, knn, metrics, sampling
from clienttrace.operators import vectors as vec
from clienttrace.plans.registry import num, query, sql_num
from clienttrace.plans.roles import table, vectors
from clienttrace.plans.sqltext import VECTORS, hash_order

_SPLIT = f"""sp AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {hash_order('customer_id')}, customer_id)
    <= round(0.1 * count(*) OVER (PARTITION BY target)) AS is_test FROM vec)"""


def _text(column, digits: int = 4):
    """An array of doubles as text with fixed decimals."""
    pattern = F.lit("0." + "0" * digits)
    return F.array_join(F.transform(column, lambda x: F.call_function(
        "format_number", F.round(x.cast("double"), digits + 3) + 0.0, pattern)), ",")


def _sql_text(value: str, order: str, digits: int = 4) -> str:
    return f"string_agg(printf('%.{digits}f', round({value}, {digits + 3}) + 0.0), ',' ORDER BY {order})"


def _split(spark, sf_dir):
    rows = sampling.stratified_split(vectors(spark, sf_dir))
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


# --- vectors ----------------------------------------------------------------

_DIMS = "x AS (SELECT customer_id, is_test, target, unnest(embedding)::double AS v, unnest(range(1, 65)) AS d FROM sp)"


@query("max_abs_scale", f"""
WITH {VECTORS}, {_SPLIT}, {_DIMS}, m AS (SELECT d, max(abs(v)) AS top FROM x WHERE NOT is_test GROUP BY d)
SELECT customer_id, {_sql_text('CASE WHEN top > 0 THEN v / top ELSE v END', 'd')} AS scaled
FROM x JOIN m USING (d) WHERE is_test GROUP BY customer_id""")
def max_abs_scale(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return vec.max_abs_scale(train, test).select("customer_id", _text("embedding").alias("scaled"))


@query("standardize", f"""
WITH {VECTORS}, {_SPLIT}, {_DIMS}, m AS (SELECT d, avg(v) AS mean, stddev_pop(v) AS std FROM x WHERE NOT is_test
  GROUP BY d)
SELECT customer_id, {_sql_text('(v - mean) / CASE WHEN std > 0 THEN std ELSE 1 END', 'd')} AS scaled
FROM x JOIN m USING (d) WHERE is_test GROUP BY customer_id""")
def standardize(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return vec.standardize(train, test).select("customer_id", _text("embedding").alias("scaled"))


@query("concat_vectors", """
WITH x AS (SELECT vec_id AS customer_id, unnest(list_concat(embedding::double[], embedding::double[])) AS v,
  unnest(range(1, 129)) AS d FROM embeddings)
SELECT customer_id, count(*)::int AS n, string_agg(printf('%.4f', round(v, 7) + 0.0), ',' ORDER BY d) AS joined
FROM x GROUP BY customer_id""")
def concat_vectors(spark, sf_dir):
    both = vec.concat_vectors(vectors(spark, sf_dir), "embedding", "embedding")
    return both.select("customer_id", F.size("joined").alias("n"), _text("joined").alias("joined"))


@query("unit_vectors", f"""
WITH {VECTORS}, x AS (SELECT customer_id, unnest(embedding)::double AS v, unnest(range(1, 65)) AS d FROM vec),
n AS (SELECT customer_id, sqrt(sum(v * v)) AS norm, max(v) AS top FROM x GROUP BY customer_id),
z AS (SELECT customer_id, top + ln(sum(exp(v - top))) AS lse FROM x JOIN n USING (customer_id)
  GROUP BY customer_id, top)
SELECT customer_id, {_sql_text('v / norm', 'd')} AS unit, {_sql_text('exp(v - lse)', 'd', 6)} AS probs,
  {_sql_text('v - lse', 'd')} AS log_probs, {_sql_text('1 / (1 + exp(-v))', 'd')} AS sigmoids,
  (arg_min(d, (-v, d)) - 1)::int AS top_index
FROM x JOIN n USING (customer_id) JOIN z USING (customer_id) GROUP BY customer_id""")
def unit_vectors(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    return vectors(spark, sf_dir).select(
        "customer_id", _text(fv.l2_normalize(e)).alias("unit"), _text(fv.softmax(e), 6).alias("probs"),
        _text(fv.log_softmax(e)).alias("log_probs"), _text(F.transform(e, fv.sigmoid)).alias("sigmoids"),
        fv.argmax_class(e).alias("top_index"))


@query("cosine_similarity", f"""
WITH {VECTORS}, c AS (SELECT target, min(customer_id) AS first_id FROM vec GROUP BY target)
SELECT v.customer_id, {sql_num('list_cosine_similarity(v.embedding::double[], f.embedding::double[])', 6)} AS cosine
FROM vec v JOIN c USING (target) JOIN vec f ON f.customer_id = c.first_id""")
def cosine_similarity(spark, sf_dir):
    v = vectors(spark, sf_dir)
    first = v.groupBy("target").agg(F.min_by("embedding", "customer_id").alias("first"))
    return v.join(first, "target").select(
        "customer_id", num(fv.cosine_similarity(F.col("embedding"), F.col("first")), 6).alias("cosine"))


@query("masked_pool", f"""
WITH t AS (SELECT label, vec_id // 8 AS token, (vec_id % 8)::int AS layer, (vec_id // 8) % 5 <> 0 AS keep, embedding
  FROM embeddings),
m AS (SELECT label, max(layer) AS top FROM t GROUP BY label),
x AS (SELECT label, token, layer, unnest(embedding)::double AS v, unnest(range(1, 65)) AS d FROM t
  WHERE keep),
k AS (SELECT label, token, d, avg(v) AS v FROM x JOIN m USING (label) WHERE layer > top - 4 GROUP BY ALL),
p AS (SELECT label, d, avg(v) AS v FROM k GROUP BY ALL)
SELECT label, {_sql_text('v', 'd')} AS pooled FROM p GROUP BY label""")
def masked_pool(spark, sf_dir):
    tokens = table(spark, sf_dir, "embeddings").select(
        "label", F.floor(F.col("vec_id") / 8).alias("token"), (F.col("vec_id") % 8).alias("layer"),
        (F.floor(F.col("vec_id") / 8) % 5 != 0).cast("int").alias("mask"), "embedding")
    pooled = vec.masked_mean_pool(tokens, "label", "layer", "token", "embedding", "mask", 4)
    return pooled.select("label", _text("embedding").alias("pooled"))


# --- neighbours -------------------------------------------------------------

def _knn_sql(partition: str = "") -> str:
    return f"""d AS (SELECT q.customer_id AS query_id, b.customer_id AS base_id, b.target AS label,
    b.binary_target AS y,
    round(1 - list_cosine_similarity(q.embedding::double[], b.embedding::double[]), 9) AS distance
  FROM sp q JOIN sp b ON q.is_test AND NOT b.is_test),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id{partition} ORDER BY distance, base_id) AS place FROM d)"""


@query("knn_join", f"""
WITH {VECTORS}, {_SPLIT}, {_knn_sql()}
SELECT query_id, base_id, place, {sql_num('distance', 6)} AS distance FROM nn WHERE place <= 10""")
def knn_join(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return knn.knn_join(test, train, 10).withColumn("distance", num("distance", 6))


@query("knn_per_class", f"""
WITH {VECTORS}, {_SPLIT}, {_knn_sql(', label')}
SELECT query_id, base_id, label, place, {sql_num('distance', 6)} AS distance FROM nn WHERE place <= 2""")
def knn_per_class(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return knn.knn_join_per_class(test, train, 2).withColumn("distance", num("distance", 6))


@query("knn_join_pruned", f"""
WITH {VECTORS}, {_SPLIT}, {_knn_sql()}
SELECT query_id, base_id, place, {sql_num('distance', 6)} AS distance FROM nn WHERE place <= 10""")
def knn_join_pruned(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return knn.knn_join(test, train, 10, pivots=24).withColumn("distance", num("distance", 6))


@query("knn_per_class_pruned", f"""
WITH {VECTORS}, {_SPLIT}, {_knn_sql(', label')}
SELECT query_id, base_id, label, place, {sql_num('distance', 6)} AS distance FROM nn WHERE place <= 2""")
def knn_per_class_pruned(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return knn.knn_join_per_class(test, train, 2, pivots=24).withColumn("distance", num("distance", 6))


@query("knn_vote_binary", f"""
WITH {VECTORS}, {_SPLIT}, {_knn_sql()}
SELECT query_id, sum(y)::bigint AS pos, 10 - sum(y)::bigint AS neg, (sum(y) > 5)::int AS majority
FROM nn WHERE place <= 10 GROUP BY query_id""")
def knn_vote_binary(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return evidence.knn_vote_binary(knn.knn_join(test, train, 10), train, "binary_target")


@query("knn_vote_multi", f"""
WITH {VECTORS}, {_SPLIT}, {_knn_sql()},
c AS (SELECT query_id, label, count(*) AS n FROM nn WHERE place <= 10 GROUP BY ALL),
al AS (SELECT * FROM (SELECT DISTINCT query_id FROM c), (SELECT unnest(range(0, 10))::int AS label)),
g AS (SELECT query_id, label, coalesce(n, 0) AS n FROM al LEFT JOIN c USING (query_id, label))
SELECT query_id, string_agg(n, ',' ORDER BY label) AS counts, arg_min(label, (-n, label)) AS top_class,
  {sql_num('max(n) / 10')} AS share FROM g GROUP BY query_id""")
def knn_vote_multi(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    votes = evidence.knn_vote_multiclass(knn.knn_join(test, train, 10), train, 10)
    return votes.select("query_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"),
                        "top_class", num("share").alias("share"))


# --- metrics over a score made from the ids ---------------------------------

_PREDS = """pr AS (SELECT c_custkey AS customer_id, (c_mktsegment = 'BUILDING')::int AS target,
   (c_nationkey % 4)::int AS model, (c_custkey * 7919 % 251) / 250.0::double AS score,
   (c_custkey * 31 % 5)::int AS cls, (c_custkey * 17 % 6)::int - 1 AS pred_cls FROM customer)"""


def _preds(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("customer_id"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("target"),
        (F.col("c_nationkey") % 4).cast("int").alias("model"), ((k * 7919 % 251) / F.lit(250.0)).alias("score"),
        (k * 31 % 5).cast("int").alias("cls"), ((k * 17 % 6).cast("int") - 1).alias("pred_cls"))


_RANKS = """rk AS (SELECT model, target, rank() OVER (PARTITION BY model ORDER BY score)
  + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM pr),
au AS (SELECT model, (sum(r) FILTER (target = 1) - count(*) FILTER (target = 1) * (count(*) FILTER (target = 1) + 1)
  / 2.0) / (count(*) FILTER (target = 1) * count(*) FILTER (target = 0)) AS auc FROM rk GROUP BY model)"""


@query("roc_auc", f"WITH {_PREDS}, {_RANKS} SELECT model, {sql_num('auc', 6)} AS roc_auc FROM au")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_preds(spark, sf_dir), ["model"]).withColumn("roc_auc", num("roc_auc", 6))


@query("accuracy_f1", f"""
WITH {_PREDS}, b AS (SELECT model, {sql_num('avg((target = (score >= 0.5)::int)::int)', 6)} AS accuracy,
  {sql_num('2 * count(*) FILTER (target = 1 AND score >= 0.5) / (count(*) FILTER (target = 1) + count(*) FILTER (score >= 0.5))', 6)} AS f1,
  {sql_num('avg((cls = pred_cls)::int) FILTER (pred_cls >= 0)', 6)} AS valid_accuracy,
  {sql_num('count(*) FILTER (pred_cls >= 0) / count(*)', 6)} AS valid_share FROM pr GROUP BY model),
k AS (SELECT model, cls AS c, (cls = pred_cls)::int AS tp, 1 AS y, 0 AS p FROM pr WHERE pred_cls >= 0
  UNION ALL SELECT model, pred_cls, 0, 0, 1 FROM pr WHERE pred_cls >= 0),
f AS (SELECT model, c, 2.0 * sum(tp) / (sum(y) + sum(p)) AS f1 FROM k GROUP BY model, c)
SELECT b.*, f1_macro FROM b JOIN (SELECT model, {sql_num('avg(f1)', 6)} AS f1_macro FROM f GROUP BY model)
USING (model)""")
def accuracy_f1(spark, sf_dir):
    preds = _preds(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    valid = F.col("pred_cls") >= 0
    tables = [metrics.accuracy(preds, ["model"]), metrics.f1_binary(preds, ["model"]),
              metrics.accuracy(preds, ["model"], "cls", "pred_cls", valid)
              .withColumnRenamed("accuracy", "valid_accuracy"),
              metrics.valid_share(preds, valid, ["model"]),
              metrics.f1_macro(preds.where(valid), ["model"], "cls", "pred_cls")]
    result = tables[0]
    for t in tables[1:]:
        result = result.join(t, "model")
    return result.select("model", *[num(c, 6).alias(c) for c in
                                    ("accuracy", "f1", "valid_accuracy", "valid_share", "f1_macro")])


@query("running_auc", f"""
WITH {_PREDS}, s AS (SELECT *, row_number() OVER (ORDER BY customer_id) AS seq FROM pr),
pf AS (SELECT least(p * 200, (SELECT max(seq) FROM s)) AS n FROM
  (SELECT unnest(range(1, (SELECT max(seq) // 200 + 2 FROM s))) AS p) WHERE (p - 1) * 200 < (SELECT max(seq) FROM s)),
x AS (SELECT n, target, score, rank() OVER (PARTITION BY n ORDER BY score)
   + (count(*) OVER (PARTITION BY n, score) - 1) / 2.0 AS r FROM pf JOIN s ON seq <= n)
SELECT n AS n_rows, {sql_num('''(sum(r) FILTER (target = 1) - count(*) FILTER (target = 1)
   * (count(*) FILTER (target = 1) + 1) / 2.0) / (count(*) FILTER (target = 1) * count(*) FILTER (target = 0))''', 6)}
   AS roc_auc, {sql_num('avg((target = (score >= 0.5)::int)::int)', 6)} AS accuracy FROM x GROUP BY n""")
def running_auc(spark, sf_dir):
    preds = _preds(spark, sf_dir).withColumn("seq", F.col("customer_id") + 1)
    result = metrics.running_metric(preds, 200)
    return result.select("n_rows", num("roc_auc", 6).alias("roc_auc"), num("accuracy", 6).alias("accuracy"))


_SEEDS = """sd AS (SELECT c_nationkey % 4 AS model, c_nationkey // 4 AS seed, avg(c_acctbal) AS score,
   CASE WHEN c_nationkey % 4 <> 3 THEN max(c_acctbal) END AS best FROM customer GROUP BY c_nationkey)"""


def _seeds(spark, sf_dir):
    n = F.col("c_nationkey")
    return (table(spark, sf_dir, "customer").groupBy(n)
            .agg(F.avg("c_acctbal").alias("score"), F.max("c_acctbal").alias("_max"))
            .select((n % 4).alias("model"), F.floor(n / 4).alias("seed"), "score",
                    F.when(n % 4 != 3, F.col("_max")).alias("best")))


@query("metric_by_seed", f"""
WITH {_SEEDS} SELECT model, {sql_num('avg(score)')} AS score_mean, {sql_num('stddev_samp(score)')} AS score_std,
  {sql_num('avg(best)')} AS best_mean, {sql_num('stddev_samp(best)')} AS best_std, count(*) AS n_seeds,
  {sql_num('stddev_pop(score)')} AS score_pop_std FROM sd GROUP BY model""")
def metric_by_seed(spark, sf_dir):
    runs = _seeds(spark, sf_dir)
    pop = metrics.metric_by_group(runs, ["model"], ["score"], ddof=0).select(
        "model", num("score_std").alias("score_pop_std"))
    means = metrics.metric_by_group(runs, ["model"], ["score", "best"])
    return (means.withColumns({c: num(c) for c in ("score_mean", "score_std", "best_mean", "best_std")})
            .join(pop, "model"))


@query("leaderboard", f"""
WITH {_SEEDS}, m AS (SELECT 'model_' || model AS name, avg(score) AS score FROM sd GROUP BY model)
SELECT name, {sql_num('score')} AS score, {sql_num("score - (SELECT score FROM m WHERE name = 'model_0')")} AS delta
FROM m""")
def leaderboard(spark, sf_dir):
    means = _seeds(spark, sf_dir).groupBy(F.concat(F.lit("model_"), F.col("model")).alias("name")).agg(
        F.avg("score").alias("score"))
    board = metrics.leaderboard(means, "name", "score", "model_0")
    return board.withColumns({"score": num("score"), "delta": num("delta")})


_HISTORY = """hi AS (SELECT o_orderpriority AS run, (date_diff('month', DATE '1995-01-01', o_orderdate::date))::int
    AS epoch, round(avg(o_totalprice), 3) AS val_score, round(avg(o_totalprice * 2), 3) AS test_score
  FROM orders GROUP BY ALL)"""


@query("best_epoch", f"""
WITH {_HISTORY}, f AS (SELECT run, arg_min(val_score, epoch) AS v0, arg_min(test_score, epoch) AS t0,
  max(val_score) AS bv FROM hi GROUP BY run),
b AS (SELECT run, min(epoch) AS be FROM hi JOIN f USING (run) WHERE val_score = bv GROUP BY run)
SELECT f.run, be AS best_epoch, bv > v0 AS kept, {sql_num('CASE WHEN bv > v0 THEN test_score ELSE t0 END', 2)}
  AS final_test FROM f JOIN b USING (run) JOIN hi ON hi.run = f.run AND hi.epoch = be""")
def best_epoch(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    month = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("int")
    history = o.groupBy(F.col("o_orderpriority").alias("run"), month.alias("epoch")).agg(
        F.round(F.avg("o_totalprice"), 3).alias("val_score"),
        F.round(F.avg(F.col("o_totalprice") * 2), 3).alias("test_score"))
    found = metrics.best_epoch(history, ["run"])
    return found.select("run", "best_epoch", "kept", num("final_test", 2).alias("final_test"))


_GRID = """gr AS (SELECT ['zero_shot', 'few_shot', 'cot'][(c_nationkey % 3)::int + 1] AS strategy,
   ['none', 'shap', 'knn', 'both'][(c_custkey % 4)::int + 1] AS enrichment, avg(c_acctbal) AS auc
  FROM customer GROUP BY ALL)"""


def _grid(spark, sf_dir):
    def pick(names, at):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    return (table(spark, sf_dir, "customer")
            .groupBy(pick(["zero_shot", "few_shot", "cot"], F.col("c_nationkey") % 3).alias("strategy"),
                     pick(["none", "shap", "knn", "both"], F.col("c_custkey") % 4).alias("enrichment"))
            .agg(F.avg("c_acctbal").alias("auc")))


@query("strategy_pivot", f"""
WITH {_GRID} SELECT strategy, {', '.join(sql_num(f"max(auc) FILTER (enrichment = '{e}')") + f' AS "{e}"'
                                         for e in ('none', 'shap', 'knn', 'both'))} FROM gr GROUP BY strategy""")
def strategy_pivot(spark, sf_dir):
    matrix = metrics.strategy_matrix(_grid(spark, sf_dir), "auc")
    return matrix.select("strategy", *[num(c).alias(c) for c in ("none", "shap", "knn", "both")])


@query("delta_points", f"""
WITH {_GRID}, p AS (SELECT strategy, max(auc) FILTER (enrichment = 'none') AS a,
   max(auc) FILTER (enrichment = 'knn') AS b FROM gr GROUP BY strategy)
SELECT strategy, {sql_num('a')} AS "none", {sql_num('b')} AS knn, {sql_num('(b - a) * 100', 2)} AS delta_points FROM p""")
def delta_points(spark, sf_dir):
    d = metrics.delta_points(_grid(spark, sf_dir), ["strategy"], "enrichment", "auc", "none", "knn")
    return d.select("strategy", num("none").alias("none"), num("knn").alias("knn"),
                    num("delta_points", 2).alias("delta_points"))


# --- losses -----------------------------------------------------------------

# Logits from the first half of the components, a teacher from the second.
_LOGITS = """lg AS (SELECT vec_id, label, (label >= 5)::int AS y, i, embedding[i]::double * 3 AS a,
   embedding[i + 32]::double * 3 AS b FROM embeddings, (SELECT unnest(range(1, 33))::int AS i)),
sm AS (SELECT *, a - ln(sum(exp(a)) OVER w) AS la, b - ln(sum(exp(b)) OVER w) AS lb FROM lg
   WINDOW w AS (PARTITION BY vec_id))"""


def _logits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    def scaled(start):
        return F.transform(F.slice("embedding", start, 32), lambda x: x.cast("double") * 3)
    return e.select("vec_id", "label", (F.col("label") >= 5).cast("int").alias("y"),
                    scaled(1).alias("a"), scaled(33).alias("b"))


@query("kl_losses", f"""
WITH {_LOGITS}, r AS (SELECT vec_id, any_value(label) AS label, sum(exp(lb) * (lb - la)) AS fkl,
    sum(exp(la) * (ln(exp(la) + 1e-8) - ln(exp(lb) + 1e-8))) AS rkl,
    (sum(exp(lb) * (lb - la)) + sum(exp(la) * (la - lb))) / 2 AS skl FROM sm GROUP BY vec_id)
SELECT label, {sql_num('avg(fkl)', 6)} AS forward_kl, {sql_num('avg(rkl)', 6)} AS reverse_kl,
  {sql_num('avg(skl)', 6)} AS symmetric_kl FROM r GROUP BY label""")
def kl_losses(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    teacher = fv.softmax(F.col("b"))
    return (rows.select("label", metrics.forward_kl(teacher, F.col("a")).alias("f"),
                        metrics.reverse_kl(teacher, F.col("a")).alias("r"),
                        metrics.symmetric_kl(F.col("a"), F.col("b")).alias("s"))
            .groupBy("label").agg(num(F.avg("f"), 6).alias("forward_kl"), num(F.avg("r"), 6).alias("reverse_kl"),
                                  num(F.avg("s"), 6).alias("symmetric_kl")))


@query("binary_losses", f"""
WITH {_LOGITS}, p AS (SELECT label, y, a AS logit, 1 / (1 + exp(-a)) AS p, 1 / (1 + exp(-b)) AS q FROM lg WHERE i = 1),
c AS (SELECT label, {sql_num('avg(-la)', 6)} AS ce FROM sm WHERE i = label % 4 + 1 GROUP BY label)
SELECT label, {sql_num('avg((-(q * ln(p) + (1 - q) * ln(1 - p)) - (p * ln(q) + (1 - p) * ln(1 - q))) / 2)', 6)}
  AS mutual_bce, {sql_num('avg(-(y * ln(p) + (1 - y) * ln(1 - p)))', 6)} AS bce_logits,
  any_value(ce) AS cross_entropy FROM p JOIN c USING (label) GROUP BY label""")
def binary_losses(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    p, q = fv.sigmoid(F.col("a")[0]), fv.sigmoid(F.col("b")[0])
    return (rows.select("label", metrics.mutual_bce(p, q).alias("m"), metrics.bce_logits(F.col("a")[0], F.col("y"))
                        .alias("b"), metrics.cross_entropy(F.col("a"), F.col("label") % 4).alias("c"))
            .groupBy("label").agg(num(F.avg("m"), 6).alias("mutual_bce"), num(F.avg("b"), 6).alias("bce_logits"),
                                  num(F.avg("c"), 6).alias("cross_entropy")))


_BATCH = f"""bt AS (SELECT vec_id, embedding[1:32]::double[] AS a, embedding[33:64]::double[] AS b,
   (row_number() OVER (ORDER BY {hash_order('vec_id')}, vec_id) - 1) // 64 AS batch_id FROM embeddings)"""
_SIMS = """si AS (SELECT l.batch_id, l.vec_id AS i, r.vec_id AS j,
    list_cosine_similarity(l.a, r.b) / 0.07 AS s FROM bt l JOIN bt r USING (batch_id)),
ro AS (SELECT batch_id, i, ln(sum(exp(s))) - max(s) FILTER (i = j) AS l1 FROM si GROUP BY batch_id, i),
co AS (SELECT batch_id, j, ln(sum(exp(s))) - max(s) FILTER (i = j) AS l2 FROM si GROUP BY batch_id, j)"""
_WEIGHTS = """di AS (SELECT vec_id, batch_id, sqrt(greatest(0, 2 - 2 * list_cosine_similarity(a, b))) AS d FROM bt),
sc AS (SELECT *, (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w + 1e-8) AS s FROM di
   WINDOW w AS (PARTITION BY batch_id)),
wt AS (SELECT vec_id, batch_id, exp(s) / sum(exp(s)) OVER w * count(*) OVER w AS weight FROM sc
   WINDOW w AS (PARTITION BY batch_id))"""


def _batches(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return sampling.assign_batches(rows, 64, key="vec_id")


@query("infonce", f"""
WITH {_BATCH}, {_SIMS} SELECT batch_id, count(*) AS n, {sql_num('(avg(l1) + avg(l2)) / 2', 6)} AS loss
FROM ro JOIN co USING (batch_id) WHERE i = j GROUP BY batch_id""")
def infonce(spark, sf_dir):
    return metrics.infonce(_batches(spark, sf_dir), "a", "b", key="vec_id").withColumn("loss", num("loss", 6))


@query("weighted_infonce", f"""
WITH {_BATCH}, {_SIMS}, {_WEIGHTS}
SELECT batch_id, count(*) AS n, {sql_num('avg(l1 * weight) + avg(l2 * weight)', 6)} AS loss
FROM ro JOIN co USING (batch_id) JOIN wt USING (batch_id) WHERE i = j AND vec_id = i GROUP BY batch_id""")
def weighted_infonce(spark, sf_dir):
    weighted = metrics.difficulty_weights(_batches(spark, sf_dir), "a", "b")
    return metrics.infonce(weighted, "a", "b", key="vec_id", weight="weight").withColumn("loss", num("loss", 6))


@query("difficulty_weights", f"""
WITH {_BATCH}, {_WEIGHTS} SELECT vec_id, batch_id, {sql_num('weight', 5)} AS weight FROM wt""")
def difficulty_weights(spark, sf_dir):
    rows = metrics.difficulty_weights(_batches(spark, sf_dir), "a", "b")
    return rows.select("vec_id", "batch_id", num("weight", 5).alias("weight"))
