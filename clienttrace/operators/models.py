"""Classifiers: evaluation, out-of-fold scores, soft labels.

Boosted trees are those of ``boosting``, for two and for several classes;
logistic regression is Spark's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import MaxAbsScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from clienttrace.functions.vectors import argmax_class, clip_and_renormalize
from clienttrace.operators import metrics
from clienttrace.operators.aggregates import FEATURES
from clienttrace.operators.boosting import BoostedModel, Booster, Boosting
from clienttrace.operators.sampling import stratified_kfold
from clienttrace.operators.vectors import concat_vectors
from clienttrace.session import side_by_side, written

# Parameters of the published runs.
GRADIENT_BINARY = Boosting(rounds=500, rate=0.02, depth=6, leaves=31, rows=0.5, columns=0.75, least_rows=50, alpha=1.0, penalty=1.0)
GRADIENT_MULTICLASS = Boosting(rounds=1000, rate=0.02, depth=12, leaves=50, rows=0.75, columns=0.75, least_rows=50, alpha=1.0,
                               penalty=1.0)
EXTREME = Boosting(rounds=300, rate=0.1, depth=6, rows=0.8, columns=0.8, least_hessian=1.0, penalty=1.0)
LOGISTIC = {"C": 1.0, "maxIter": 1000}
TASKS = ("binary", "multiclass")


def _check(task: str) -> None:
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}, expected one of {TASKS}")


def as_features(df: DataFrame, column: str = "embedding", target: str = "target") -> DataFrame:
    """Vector column ``features`` and double column ``label``."""
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>"))).withColumn(
        "label", F.col(target).cast("double"))


def assemble(df: DataFrame, features: Sequence[str] = FEATURES, target: str = "target") -> DataFrame:
    rows = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)
    return rows.withColumn("label", F.col(target).cast("double"))


def tree_estimator(task: str, params: Boosting | None = None, seed: int = 42) -> Booster:
    """Boosted trees for a task; the label's values say how many classes there are."""
    _check(task)
    return Booster(params or (GRADIENT_BINARY if task == "binary" else GRADIENT_MULTICLASS), seed)


def logistic_estimator(rows: int, params: Mapping[str, object] = LOGISTIC):
    """L2 with strength C, which Spark counts per row."""
    return LogisticRegression(featuresCol="scaled", labelCol="label", regParam=1.0 / (params["C"] * rows),
                              standardization=False, maxIter=params["maxIter"])


def fit_scaled(train: DataFrame, estimator, scale: bool = True):
    """Max-abs scaling (fitted on train) and the estimator as one pipeline model; scaling does not change trees."""
    if isinstance(estimator, Booster):
        return estimator.fit(train)
    if scale:
        first = MaxAbsScaler(inputCol="features", outputCol="scaled")
    else:
        first = VectorAssembler(inputCols=["features"], outputCol="scaled")
    return Pipeline(stages=[first, estimator]).fit(train)


def scored(model, rows: DataFrame) -> DataFrame:
    """Adds ``probs ARRAY<DOUBLE>``, ``score`` (class 1) and ``pred``."""
    result = model.transform(rows)
    if not isinstance(model, BoostedModel):
        result = result.withColumn("probs", vector_to_array("probability"))
    return (result.withColumn("score", F.element_at("probs", 2))
            .withColumn("pred", argmax_class(F.col("probs")))
            .drop("scaled", "rawPrediction", "probability", "prediction"))


def _measure(result: DataFrame, task: str, with_f1: bool) -> DataFrame:
    """One row per metric of scored rows, which are written: every metric reads them."""
    result = written(result.select("label", "score", "pred"), "scored")
    if task == "binary":
        labelled = result.withColumn("pred", (F.col("score") >= 0.5).cast("int"))
        tables = [("roc_auc", metrics.roc_auc(labelled, target="label"))]
        if with_f1:
            tables += [("accuracy", metrics.accuracy(labelled, target="label")),
                       ("f1", metrics.f1_binary(labelled, target="label"))]
    else:
        tables = [("accuracy", metrics.accuracy(result, target="label"))]
        if with_f1:
            tables += [("f1_macro", metrics.f1_macro(result.withColumn("pred", F.col("pred").cast("double")),
                                                     target="label"))]
    rows = [t.select(F.lit(n).alias("metric"), F.col(n).alias("value")) for n, t in tables]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def evaluate_gbt(train: DataFrame, test: DataFrame, task: str, params: Boosting | None = None,
                 seed: int = 42, with_f1: bool = True) -> DataFrame:
    """Boosted trees: ``metric, value``."""
    model = fit_scaled(train, tree_estimator(task, params, seed))
    return _measure(scored(model, test), task, with_f1)


def evaluate_logreg(train: DataFrame, test: DataFrame, task: str,
                    params: Mapping[str, object] = LOGISTIC) -> DataFrame:
    _check(task)
    model = fit_scaled(train, logistic_estimator(train.count(), params))
    return _measure(scored(model, test), task, with_f1=False)


def evaluate_all(train: DataFrame, test: DataFrame, task: str, seed: int = 42,
                 gradient: Boosting | None = None, extreme: Boosting = EXTREME,
                 logistic: Mapping[str, object] = LOGISTIC) -> DataFrame:
    """Long table ``model, metric, value`` of the three classifiers, fitted side by side."""
    _check(task)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    names = ("gradient_boosting", "extreme_boosting", "logistic_regression")
    parts = side_by_side([lambda: evaluate_gbt(train, test, task, gradient, seed),
                          lambda: evaluate_gbt(train, test, task, extreme, seed, with_f1=False),
                          lambda: evaluate_logreg(train, test, task, logistic)])
    train.unpersist()
    out = None
    for name, table in zip(names, parts):
        table = table.select(F.lit(name).alias("model"), "metric", "value")
        out = table if out is None else out.unionByName(table)
    return out


def compare_vector_sets(train: DataFrame, test: DataFrame, a: str, b: str, task: str,
                        params: Boosting | None = None, target: str = "target") -> DataFrame:
    """The same classifier on vectors a, b and both; the three are fitted at the same time."""
    columns = {"a": a, "b": b, "both": "_both"}
    tables = side_by_side([lambda column=column: evaluate_gbt(
        *(as_features(concat_vectors(t, a, b, "_both"), column, target) for t in (train, test)), task, params)
        for column in columns.values()])
    out = None
    for name, table in zip(columns, tables):
        table = table.select(F.lit(name).alias("vectors"), "metric", "value")
        out = table if out is None else out.unionByName(table)
    return out


def oof_predictions(df: DataFrame, estimator, k: int = 5, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """Every row scored by the model that did not see its fold.

    ``df`` has ``features`` and ``label``. Boosted trees of all folds are fitted
    side by side, other fits are separate jobs; the folds are written because
    each fit reads them.
    """
    folds = written(stratified_kfold(df, "label", k, seed, key), "folds")
    fitted = None
    if isinstance(estimator, Booster):
        others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i != F.col("fold"))
        fitted = estimator.fit_parts(folds.withColumn("part", others), key)
    out = None
    for i in range(k):
        # Trees are held no longer than it takes to tell the scoring tasks of them.
        model = fitted.pop(i) if fitted is not None else fit_scaled(folds.where(F.col("fold") != i), estimator)
        part = scored(model, folds.where(F.col("fold") == i))
        out = part if out is None else out.unionByName(part)
    return out.drop("features")


def holdout_predictions(train: DataFrame, test: DataFrame, estimator) -> DataFrame:
    return scored(fit_scaled(train, estimator), test).drop("features")


def teacher_soft_labels(df: DataFrame, estimator, k: int = 5, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """Out-of-fold class probabilities, kept off 0 and 1 and summing to 1."""
    oof = oof_predictions(df, estimator, k, seed, key)
    return oof.select(key, "label", clip_and_renormalize(F.col("probs")).alias("soft_labels"))


# Share of the teacher per data set.
TEACHER_SHARE = {"gender": 0.1, "churn": 0.1, "age": 0.05}


def soft_label_student(df: DataFrame, alpha: float, classes: int, soft: str = "soft_labels",
                       params: Mapping[str, object] = LOGISTIC):
    """Logistic model fitted on ``(1 - alpha) * label + alpha * teacher``.

    Each row becomes one weighted row per class, which is the cross entropy
    plus the forward divergence from the teacher, up to a constant.
    """
    weights = F.transform(soft, lambda p, i: F.struct(
        i.cast("double").alias("label"),
        (F.lit(alpha) * p + F.when(i == F.col("label").cast("int"), 1 - alpha).otherwise(0.0)).alias("weight")))
    rows = df.select("features", F.inline(weights))
    n = df.count()
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=params["maxIter"],
                            regParam=1.0 / (params["C"] * n), standardization=False,
                            family="binomial" if classes == 2 else "multinomial")
    return lr.fit(rows)
