"""Classifiers, attributions and learned vectors over the given tables.

All models have their full parameters. What hundreds of rounds give has no SQL;
the sums, splits and leaf values of the first rounds have, and what must hold of
any fit is checked from the scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from clienttrace.operators import aggregates, boosting, embedding, evidence, models, paths, sampling, sequences
from clienttrace.operators import vectors as vec
from clienttrace.operators.boosting import Boosting
from clienttrace.plans.registry import num, query, sql_num
from clienttrace.plans.roles import click_labels, clicks, customer_labels, shipments, table, vectors
from clienttrace.plans.sqltext import CLICK_ORDER, CLICKS
from clienttrace.session import shared_folder, written
from clienttrace.sources import results as res


def _vector_split(spark, sf_dir, target):
    rows = models.as_features(vectors(spark, sf_dir), target=target)
    split = sampling.stratified_split(rows, target)
    return split.where("split = 'train'"), split.where("split = 'test'")


def _client_rows(spark, sf_dir):
    features = aggregates.client_features(shipments(spark, sf_dir))
    return models.assemble(features.join(customer_labels(spark, sf_dir), "customer_id"))


@query("gbt_eval")
def gbt_eval(spark, sf_dir):
    return models.evaluate_gbt(*_vector_split(spark, sf_dir, "binary_target"), "binary")


@query("forest_eval")
def forest_eval(spark, sf_dir):
    return models.evaluate_gbt(*_vector_split(spark, sf_dir, "target"), "multiclass")


@query("logreg_eval")
def logreg_eval(spark, sf_dir):
    return models.evaluate_logreg(*_vector_split(spark, sf_dir, "target"), "multiclass")


@query("evaluate_all")
def evaluate_all(spark, sf_dir):
    return models.evaluate_all(*_vector_split(spark, sf_dir, "binary_target"), "binary")


@query("compare_vectors")
def compare_vectors(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("customer_id", "target", F.slice("embedding", 1, 32).alias("a"),
                                         F.slice("embedding", 33, 32).alias("b"))
    split = sampling.stratified_split(rows)
    return models.compare_vector_sets(split.where("split = 'train'"), split.where("split = 'test'"), "a", "b",
                                      "multiclass")


@query("oof_predictions")
def oof_predictions(spark, sf_dir):
    rows = _client_rows(spark, sf_dir)
    scored = models.oof_predictions(rows, models.tree_estimator("multiclass"))
    return scored.select("customer_id", "label", "fold", "score", "pred")


@query("holdout_predictions")
def holdout_predictions(spark, sf_dir):
    split = sampling.stratified_split(_client_rows(spark, sf_dir), "label")
    scored = models.holdout_predictions(split.where("split = 'train'"), split.where("split = 'test'"),
                                        models.tree_estimator("binary"))
    return scored.select("customer_id", "label", "score", "pred")


@query("soft_labels")
def soft_labels(spark, sf_dir):
    rows = models.as_features(vectors(spark, sf_dir))
    return models.teacher_soft_labels(rows, models.tree_estimator("multiclass"))


@query("soft_student")
def soft_student(spark, sf_dir):
    rows = models.as_features(vectors(spark, sf_dir), target="binary_target")
    soft = models.teacher_soft_labels(rows, models.tree_estimator("multiclass"))
    # Counted, fitted on and scored: the teacher scores it once.
    known = written(rows.join(soft.select("customer_id", "soft_labels"), "customer_id"), "teacher")
    student = models.soft_label_student(known, models.TEACHER_SHARE["gender"], 2)
    return models.scored(student, known).select("customer_id", "label", "score", "pred")


# A small tree over the first three components: (low, high] per leaf, and its value.
_LEAVES = evidence.Leaves(
    np.array([[-np.inf, -np.inf, -np.inf], [-np.inf, 0.05, -np.inf], [0.0, -np.inf, -np.inf], [0.0, -np.inf, -0.05]]),
    np.array([[0.0, 0.05, np.inf], [0.0, np.inf, np.inf], [np.inf, np.inf, -0.05], [np.inf, np.inf, np.inf]]),
    np.array([1.0, 2.5, -1.0, 4.0]))
_TREE = "CASE WHEN {0}.a <= 0 THEN CASE WHEN {1}.b <= 0.05 THEN 1 ELSE 2.5 END WHEN {2}.c <= -0.05 THEN -1 ELSE 4 END"


def _mean(*given: str) -> str:
    """The mean over all rows y, with the features named taken from x."""
    return "avg((" + _TREE.format(*("x" if f in given else "y" for f in "abc")) + ")::double)"


@query("tree_shapley", f"""
WITH e AS (SELECT vec_id, embedding[1]::double AS a, embedding[2]::double AS b, embedding[3]::double AS c FROM embeddings),
v AS (SELECT x.vec_id, {_mean()} AS n, {_mean('a')} AS a, {_mean('b')} AS b, {_mean('c')} AS c, {_mean('a', 'b')} AS ab,
  {_mean('a', 'c')} AS ac, {_mean('b', 'c')} AS bc, {_mean('a', 'b', 'c')} AS abc FROM e x, e y GROUP BY x.vec_id)
SELECT vec_id, {sql_num('abc', 6)} AS score, {sql_num('n', 6)} AS base_score,
  {sql_num('(a - n) / 3 + (ab - b + ac - c) / 6 + (abc - bc) / 3', 6)} AS phi_a,
  {sql_num('(b - n) / 3 + (ab - a + bc - c) / 6 + (abc - ac) / 3', 6)} AS phi_b,
  {sql_num('(c - n) / 3 + (ac - a + bc - b) / 6 + (abc - ab) / 3', 6)} AS phi_c FROM v""")
def tree_shapley(spark, sf_dir):
    """Attributions over the whole table as background, of a fixed tree."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", *[F.element_at("embedding", i + 1).alias(c) for i, c in enumerate("abc")])
    found = evidence.tree_attributions(_LEAVES, rows, rows, ["a", "b", "c"], "vec_id")
    return found.select("vec_id", num("score", 6).alias("score"), num("base_score", 6).alias("base_score"), *(
        num(F.col("attributions")[i]["phi"], 6).alias(f"phi_{c}") for i, c in enumerate("abc")))


# A tree over each three of the 64 components; the first of them is asked twice on the way to the last two leaves.
_COVERED = [paths.TreeNodes([3 * k, 3 * k + 1, 3 * k + 2, -1, -1, -1, 3 * k, -1, -1],
                            [0.0, 0.05, -0.05, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0],
                            [1, 3, 5, 0, 0, 0, 7, 0, 0], [2, 4, 6, 0, 0, 0, 8, 0, 0],
                            [0.0, 0.0, 0.0, 1.0 + k, 2.5, -1.0, 0.0, 4.0, 0.5 - k]) for k in range(21)]


def _known(given: str) -> str:
    """The tree's value where the components named are known and others go both ways by the counts of rows."""
    def node(component: str, cut: float, left: str, right: str, n_left: str, n_right: str) -> str:
        if component in given:
            return f"(CASE WHEN {component} <= {cut} THEN {left} ELSE {right} END)"
        return f"coalesce(({n_left} * {left} + {n_right} * {right}) / nullif({n_left} + {n_right}, 0), ({left} + {right}) / 2)"
    last = node("a", 0.1, "4.0::double", "(0.5 - k)::double", "n7", "n8")
    return node("a", 0.0, node("b", 0.05, "(1 + k)::double", "2.5::double", "n3", "n4"),
                node("c", -0.05, "-1.0::double", last, "n5", "(n7 + n8)"), "(n3 + n4)", "(n5 + n7 + n8)")


@query("path_shapley", f"""
WITH e AS (SELECT vec_id, k, embedding[3 * k + 1]::double AS a, embedding[3 * k + 2]::double AS b, embedding[3 * k + 3]::double AS c
  FROM embeddings, (SELECT unnest(range(21)) AS k)),
n AS (SELECT k, count_if(a <= 0 AND b <= 0.05) AS n3, count_if(a <= 0 AND b > 0.05) AS n4, count_if(a > 0 AND c <= -0.05) AS n5,
  count_if(a > 0 AND c > -0.05 AND a <= 0.1) AS n7, count_if(a > 0.1 AND c > -0.05) AS n8 FROM e GROUP BY k),
v AS (SELECT vec_id, k, {', '.join(f"{_known(g)} AS v{g}" for g in ('', 'a', 'b', 'c', 'ab', 'ac', 'bc', 'abc'))} FROM e JOIN n USING (k)),
p AS (SELECT vec_id, unnest([3 * k, 3 * k + 1, 3 * k + 2]) AS i, unnest([
  (va - v) / 3 + (vab - vb + vac - vc) / 6 + (vabc - vbc) / 3,
  (vb - v) / 3 + (vab - va + vbc - vc) / 6 + (vabc - vac) / 3,
  (vc - v) / 3 + (vac - va + vbc - vb) / 6 + (vabc - vab) / 3]) AS phi FROM v
  UNION ALL SELECT vec_id, 63, 0 FROM embeddings),
s AS (SELECT vec_id, sum(vabc) AS score, sum(v) AS base FROM v GROUP BY vec_id)
SELECT vec_id, 'f' || i AS feature, {sql_num('phi', 6)} AS phi, {sql_num('score', 6)} AS score, {sql_num('base', 6)} AS base_score
FROM p JOIN s USING (vec_id)""")
def path_shapley(spark, sf_dir):
    """Attributions of 21 fixed trees over 64 features, covers counted over the whole table."""
    features = [f"f{i}" for i in range(64)]
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", *[F.element_at("embedding", i + 1).alias(f) for i, f in enumerate(features)])
    model = paths.paths(paths.with_covers(_COVERED, rows, features))
    found = paths.path_attributions(model, rows, features, "vec_id")
    return found.select("vec_id", "score", "base_score", F.inline("attributions")).select(
        "vec_id", "feature", *[num(c, 6).alias(c) for c in ("phi", "score", "base_score")])


@query("shapley")
def shapley(spark, sf_dir):
    events = clicks(spark, sf_dir)
    rows = models.assemble(aggregates.client_features(events).join(click_labels(spark, sf_dir), "customer_id"))
    rows = written(rows, "features")
    leaves = models.tree_estimator("binary", models.EXTREME).fit(rows).leaves()
    found = evidence.tree_attributions(leaves, rows, rows)
    return found.select("customer_id", "score", "base_score", F.inline("attributions"))


# Two rounds of stumps over eight components and ten classes, bins a sixteenth wide.
_STUMPS = Boosting(rounds=2, rate=0.1, depth=1, least_rows=20, alpha=1.0, penalty=1.0)
_CUTS = [k / 16 - 1 for k in range(33)]


def _shrink(g: str) -> str:
    return f"sign({g}) * greatest(abs({g}) - 1, 0)"


def _stump_round(turn: int) -> str:
    """CTEs of a round: class probabilities, sums per bin, splits, the best of each class, leaf values, new scores."""
    r = turn
    left, right, whole = ((f"{x}.g", f"{x}.h") for x in ("l", "r", "w"))
    gain = " + ".join(f"pow({_shrink(g)}, 2) / ({h} + 1)" for g, h in (left, right)) + f" - pow({_shrink(whole[0])}, 2) / ({whole[1]} + 1)"
    return f"""
p{r} AS (SELECT vec_id, class, exp(score) / sum(exp(score)) OVER (PARTITION BY vec_id) AS p FROM s{r}),
d{r} AS (SELECT vec_id, class, p - (label = class)::int AS g, p * (1 - p) * 10 / 9 AS h FROM p{r} JOIN embeddings USING (vec_id)),
b{r} AS (SELECT class, f, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM d{r} JOIN x USING (vec_id) GROUP BY ALL),
w{r} AS (SELECT class, f, sum(g) AS g, sum(h) AS h, sum(n) AS n FROM b{r} GROUP BY ALL),
l{r} AS (SELECT class, f, k.bin, sum(g) AS g, sum(h) AS h, sum(n) AS n FROM b{r} b JOIN (SELECT unnest(range(33)) AS bin) k
  ON b.bin <= k.bin GROUP BY ALL),
c{r} AS (SELECT l.class, l.f, l.bin, {gain} AS gain, l.g AS lg, l.h AS lh, l.n AS ln, r.g AS rg, r.h AS rh, r.n AS rn
  FROM l{r} l JOIN w{r} w ON l.class = w.class AND l.f = w.f
  JOIN LATERAL (SELECT w.g - l.g AS g, w.h - l.h AS h, w.n - l.n AS n) r ON true WHERE l.n >= 20 AND r.n >= 20),
t{r} AS (SELECT *, -0.1 * ({_shrink('lg')}) / (lh + 1) AS lv, -0.1 * ({_shrink('rg')}) / (rh + 1) AS rv FROM c{r}
  QUALIFY row_number() OVER (PARTITION BY class ORDER BY round(gain, 9) DESC, f, bin) = 1),
s{r + 1} AS (SELECT vec_id, class, score + CASE WHEN x.bin <= t.bin THEN lv ELSE rv END AS score
  FROM s{r} JOIN t{r} t USING (class) JOIN x USING (vec_id, f))"""


@query("boosting_rounds", f"""
WITH x AS (SELECT vec_id, f, greatest(0, least(33, ceil((embedding[f + 1]::double + 1) * 16)))::int AS bin
  FROM embeddings, (SELECT unnest(range(8)) AS f)),
s0 AS (SELECT vec_id, class, ln((SELECT count(*) FROM embeddings WHERE label = class) / (SELECT count(*) FROM embeddings)) AS score
  FROM embeddings, (SELECT unnest(range(10)) AS class)),{_stump_round(0)},{_stump_round(1)}
SELECT round, class::int AS class, f::int AS feature, bin / 16 - 1 AS threshold, {', '.join(
    f"{sql_num(c, 6)} AS {n}" for c, n in (('lg', 'left_gradient'), ('lh', 'left_hessian'), ('lv', 'left_value'),
                                           ('rg', 'right_gradient'), ('rh', 'right_hessian'), ('rv', 'right_value')))},
  ln::bigint AS left_rows, rn::bigint AS right_rows
FROM (SELECT 0 AS round, * FROM t0 UNION ALL SELECT 1, * FROM t1)""")
def boosting_rounds(spark, sf_dir):
    """The stumps of the first two rounds, from sums over all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("v"), "label")
    model = boosting.fit_distributed(models.as_features(rows, "v", "label"), _STUMPS, key="vec_id", edges=[_CUTS] * 8)
    nodes = boosting.as_table(spark, model)
    facts = ["gradient", "hessian", "value"]
    top = nodes.where("node = 0").select("round", "class", "feature", "threshold")
    for side, node in (("left", 1), ("right", 2)):
        top = top.join(nodes.where(F.col("node") == node).select("round", "class", F.col("rows").alias(f"{side}_rows"), *(
            num(c, 6).alias(f"{side}_{c}") for c in facts)), ["round", "class"])
    return top


def _click_records(spark, sf_dir):
    return sequences.build_sequences(clicks(spark, sf_dir), ["category", "amount"], click_labels(spark, sf_dir))


_PAIRS = f"""
WITH {CLICKS}, t AS (SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY {CLICK_ORDER}) AS i,
    coalesce(category, '') || ':' || coalesce(floor(log2(abs(amount) + 1))::bigint::varchar, '') AS token FROM ev),
o AS (SELECT x.token AS a, y.token AS b FROM t x JOIN t y USING (customer_id) WHERE y.i - x.i BETWEEN 1 AND 5),
pairs AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM o UNION ALL SELECT b, a FROM o) GROUP BY ALL),
m AS (SELECT a, sum(n) AS n FROM pairs GROUP BY a),
pmi AS (SELECT p.a, p.b, p.n, ln(p.n::double * (SELECT sum(n) FROM pairs) / (x.n::double * y.n)) AS w
  FROM pairs p JOIN m x ON p.a = x.a JOIN m y ON p.b = y.a)"""


@query("token_pairs", f"""{_PAIRS}
SELECT a, b, n::bigint AS n, {sql_num('greatest(w, 0)', 6)} AS w FROM pmi""")
def token_pairs(spark, sf_dir):
    """Pairs of event tokens that lie near each other, and their mutual information."""
    pairs = embedding.token_pairs(_click_records(spark, sf_dir), "category", "amount")
    weights = embedding.mutual_information(pairs)
    return pairs.join(weights, ["a", "b"], "left").select("a", "b", "n", num(F.coalesce("w", F.lit(0.0)), 6).alias("w"))


@query("client_projections", f"""{_PAIRS},
s AS (SELECT token AS b, j, CASE WHEN md5(token || '-' || j)[1] < '8' THEN 1.0 ELSE -1.0 END::double AS sign
  FROM (SELECT DISTINCT a AS token FROM pmi WHERE w > 0), (SELECT unnest(range(8)) AS j)),
y AS (SELECT a, j, sum(w * sign) AS v FROM pmi JOIN s USING (b) WHERE w > 0 GROUP BY ALL)
SELECT customer_id, j::int AS place, {sql_num('avg(v)', 6)} AS value FROM t JOIN y ON t.token = y.a GROUP BY ALL""")
def client_projections(spark, sf_dir):
    """Clients as means of their tokens' lines of the matrix, projected on fixed signs: one pass of the solver."""
    records = written(_click_records(spark, sf_dir), "records")
    matrix = written(embedding.mutual_information(embedding.token_pairs(records, "category", "amount")), "matrix")
    fixed = matrix.select("a").distinct().select("a", embedding.signs(F.col("a"), 8).alias("v"))
    lines = embedding.product(matrix, fixed).select(F.col("a").alias("token"), F.col("v").alias("vector"))
    made = embedding.client_means(records, "category", "amount", lines)
    return made.select("customer_id", F.posexplode("embedding").alias("place", "value")).withColumn("value", num("value", 6))


@query("sequence_embedding")
def sequence_embedding(spark, sf_dir):
    """Learned vectors beside the clients' features, stored per split and read back."""
    learned = vec.embed_sequences(_click_records(spark, sf_dir), "category", "amount")
    joined = learned.join(aggregates.client_features(clicks(spark, sf_dir)), "customer_id")
    whole = F.concat("embedding", F.array(*(F.col(c).cast("float") for c in aggregates.FEATURES)))
    folder = shared_folder(spark, "embeddings")
    res.write_embeddings(sampling.stratified_split(joined.select("customer_id", "target", whole.alias("embedding"))), folder, "clicks")
    out = None
    for split in ("train", "test"):
        part = res.read_embeddings(spark, folder, "clicks", 42, split)
        out = part if out is None else out.unionByName(part)
    return out.select("customer_id", "target", "split", F.size("embedding").alias("dim"), "embedding")


@query("text_embedding", f"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS word
  FROM documents),
c AS (SELECT doc_id, (('0x' || substr(md5(word), 1, 8))::bigint % 64)::int AS place, count(*) AS n FROM w GROUP BY ALL),
d AS (SELECT place, ln(((SELECT count(DISTINCT doc_id) FROM documents) + 1.0) / (count(*) + 1.0)) AS idf FROM c GROUP BY place)
SELECT doc_id, place, 64 AS dim, {sql_num('(n * idf)::float', 3)} AS value FROM c JOIN d USING (place) WHERE (n * idf)::float <> 0""")
def text_embedding(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = vec.embed_texts(texts, "text", "doc_id", dim=64)
    return made.select("doc_id", F.size("embedding").alias("dim"), F.posexplode("embedding").alias("place", "value")).where(
        "value != 0").withColumn("value", num("value", 3))
