import collections
import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from clienttrace.operators import evidence, metrics, models, sampling
from clienttrace.operators.boosting import Boosting

QUICK = Boosting(rounds=10, rate=0.3, depth=3)


@pytest.fixture(scope="module")
def clients(spark):
    # Class 0 holds most rows.
    return spark.range(400).select(F.col("id").alias("customer_id"),
                                   F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 3 + 1).cast("int").alias("target"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_splits_do_not_depend_on_partitioning(clients):
    moved = clients.repartition(7)
    for make in (sampling.stratified_split, sampling.stratified_kfold, lambda d: sampling.sample_n(d, 50),
                 lambda d: sampling.equal_per_class(d, n=40), lambda d: sampling.assign_batches(d, 32),
                 lambda d: sampling.stratified_sample_n(d, n=77)):
        assert rows(make(clients)) == rows(make(moved))


def test_split_sizes(clients):
    sizes = collections.Counter(r["target"] for r in clients.collect())
    split = sampling.stratified_split(clients).collect()
    for c, n in sizes.items():
        assert sum(r["target"] == c and r["split"] == "test" for r in split) == int(n * 0.1 + 0.5)
    folds = collections.Counter((r["target"], r["fold"]) for r in sampling.stratified_kfold(clients).collect())
    for c in sizes:
        per = [folds[c, f] for f in range(5)]
        assert max(per) - min(per) <= 1 and sum(per) == sizes[c]
    assert sampling.stratified_sample_n(clients, n=77).count() == 77
    assert sampling.stratified_sample_n(clients, n=9999).count() == 400
    batches = collections.Counter(r["batch_id"] for r in sampling.assign_batches(clients, 32).collect())
    assert sorted(batches.values(), reverse=True) == [32] * 12 + [16]


def test_random_demos_are_distinct_and_complete(clients):
    split = sampling.stratified_split(clients)
    demos = sampling.random_demos(split.where("split = 'test'"), split.where("split = 'train'"), 3).collect()
    per_query = collections.defaultdict(list)
    for r in demos:
        per_query[r["query_id"]].append(r)
    assert len(per_query) == split.where("split = 'test'").count()
    for found in per_query.values():
        assert len({r["customer_id"] for r in found}) == 12
        assert collections.Counter(r["target"] for r in found) == {0: 3, 1: 3, 2: 3, 3: 3}
        assert sorted(r["position"] for r in found) == list(range(1, 13))


def test_auc(spark):
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "target int, score double")
    assert metrics.roc_auc(tied).first()[0] == 0.5
    perfect = spark.createDataFrame([(1, 3.5), (0, -2.0), (0, 0.5)], "target int, score double")
    assert metrics.roc_auc(perfect).first()[0] == 1.0
    assert metrics.roc_auc(perfect.where("target = 0")).first()[0] is None
    df = spark.range(3000).select((F.rand(3) < 0.3).cast("double").alias("target"), (F.floor(F.rand(4) * 300) / 300).alias("score"))
    df = df.withColumn("score", F.col("score") * 0.9 + F.col("target") * 0.05).cache()
    want = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="target", numBins=0).evaluate(df)
    assert abs(metrics.roc_auc(df).first()[0] - want) < 1e-12


def test_f1_with_missing_classes(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 3)], "target int, pred int")
    # classes 0..3: f1 = 2/3, 0, 0, 0
    assert abs(metrics.f1_macro(df).first()[0] - (2 / 3) / 4) < 1e-12
    assert metrics.f1_binary(df.where("target = 2")).first()[0] == 0.0
    assert metrics.accuracy(df, valid=F.col("pred") < 3).first()[0] == 0.5


def test_infonce_is_symmetric(spark):
    df = spark.range(40).select("id", *[F.array(*[F.rand(s + i) for i in range(5)]).alias(n) for n, s in (("a", 1), ("b", 9))])
    df = sampling.assign_batches(df, 16, key="id").cache()
    one = rows(metrics.infonce(df, "a", "b", key="id"))
    two = rows(metrics.infonce(df, "b", "a", key="id"))
    assert all(x[:2] == y[:2] and math.isclose(x[2], y[2]) for x, y in zip(one, two))
    weights = metrics.difficulty_weights(df, "a", "b").groupBy("batch_id").agg(F.sum("weight"), F.count("*")).collect()
    assert all(math.isclose(r[1], r[2]) for r in weights)


@pytest.fixture(scope="module")
def scored_clients(spark):
    return spark.range(120).select(
        F.col("id").alias("customer_id"), *[F.rand(i).alias(f) for i, f in enumerate("pqrst")]).withColumn(
        "target", (F.col("p") + 0.5 * F.col("q") > 0.8).cast("int")).cache()


def test_shapley_sums_to_the_score(scored_clients):
    features = list("pqrst")
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"),
                             GBTClassifier(labelCol="target", maxIter=3, maxDepth=3, seed=1)]).fit(scored_clients)
    score = 2 * F.element_at(vector_to_array("rawPrediction"), 2)
    found = evidence.attributions(model, scored_clients.limit(15), scored_clients, score, features, background_rows=10)
    for r in found.collect():
        assert abs(sum(a["phi"] for a in r["attributions"]) - (r["score"] - r["base_score"])) < 1e-9


def test_shapley_of_a_linear_model(scored_clients):
    features = list("pq")
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"),
                             LogisticRegression(labelCol="target", maxIter=20)]).fit(scored_clients)
    score = F.element_at(vector_to_array("rawPrediction"), 2)
    found = evidence.attributions(model, scored_clients, scored_clients, score, features, background_rows=200)
    weights = dict(zip(features, map(float, model.stages[1].coefficients)))
    closed = evidence.linear_attribution(scored_clients, weights, scored_clients)
    joined = found.join(closed.select("customer_id", F.col("attributions").alias("c")), "customer_id").collect()
    assert len(joined) == 120
    for r in joined:
        for a, c in zip(r["attributions"], r["c"]):
            assert abs(a["phi"] - c["phi"]) < 1e-9
    top = closed.select(evidence.top_factors(F.col("attributions"), 1).alias("t")).first()["t"]
    assert len(top) == 1


def test_out_of_fold_and_soft_labels(scored_clients):
    data = models.assemble(scored_clients, list("pqrst"))
    estimator = models.tree_estimator("multiclass", QUICK)
    oof = models.oof_predictions(data, estimator, k=3).collect()
    assert sorted(r["customer_id"] for r in oof) == list(range(120))
    assert {r["fold"] for r in oof} == {0, 1, 2}
    soft = models.teacher_soft_labels(data, estimator, k=3)
    for r in soft.collect():
        assert abs(sum(r["soft_labels"]) - 1) < 1e-9 and min(r["soft_labels"]) > 0
    known = data.join(soft.select("customer_id", "soft_labels"), "customer_id")
    student = models.soft_label_student(known, 0.1, 2)
    result = models.scored(student, known.withColumnRenamed("label", "target2").withColumn("label", F.col("target2")))
    assert metrics.roc_auc(result, target="label").first()[0] > 0.9


def test_evaluation_tables(scored_clients):
    data = models.assemble(scored_clients, list("pqrst"))
    table = models.evaluate_all(data, data, "binary", gradient=QUICK, extreme=QUICK).collect()
    assert {(r["model"], r["metric"]) for r in table} == {
        ("gradient_boosting", "roc_auc"), ("gradient_boosting", "accuracy"), ("gradient_boosting", "f1"),
        ("extreme_boosting", "roc_auc"), ("logistic_regression", "roc_auc")}
    assert all(0 <= r["value"] <= 1 for r in table)
    with pytest.raises(ValueError):
        models.evaluate_logreg(data, data, "regression")


def test_shapley_of_the_predicted_class(scored_clients):
    """Three classes: each row's own predicted class is explained."""
    features = list("pq")
    rows = scored_clients.withColumn("target", F.floor(F.col("p") * 3).cast("int"))
    data = models.assemble(rows, features)
    forest = RandomForestClassifier(featuresCol="scaled", labelCol="label", numTrees=10, maxDepth=5, seed=42)
    fitted = models.fit_scaled(data, forest)
    predicted = models.scored(fitted, data).select("customer_id", *features, "pred", F.array_max("probs").alias("top"))
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), *fitted.stages]).fit(rows)
    score = F.element_at(vector_to_array("probability"), F.col("pred") + 1)
    found = evidence.attributions(model, predicted, predicted, score, features, background_rows=8, carry=["pred"])
    for r in found.join(predicted.select("customer_id", "top"), "customer_id").collect():
        assert abs(r["score"] - r["top"]) < 1e-9
        assert abs(sum(a["phi"] for a in r["attributions"]) - (r["score"] - r["base_score"])) < 1e-9


def test_tree_attributions_equal_every_background_row(scored_clients):
    features = list("pqrst")
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"),
                             GBTClassifier(labelCol="target", maxIter=3, maxDepth=3, seed=1)]).fit(scored_clients)
    score = 2 * F.element_at(vector_to_array("rawPrediction"), 2)
    some = scored_clients.limit(10)
    slow = {r["customer_id"]: r for r in evidence.attributions(
        model, some, scored_clients, score, features, background_rows=1_000).collect()}
    fast = evidence.tree_attributions(evidence.boosted_leaves(model.stages[-1], 5), some, scored_clients, features)
    for r in fast.collect():
        want = slow[r["customer_id"]]
        assert abs(r["score"] - want["score"]) < 1e-9 and abs(r["base_score"] - want["base_score"]) < 1e-9
        for a, b in zip(r["attributions"], want["attributions"]):
            assert a["feature"] == b["feature"] and abs(a["phi"] - b["phi"]) < 1e-9
