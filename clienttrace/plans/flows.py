"""The three end-to-end flows, each one lazy plan between its model fits.

``evaluate_embeddings``  events -> client vectors -> classifiers -> metric table
``enrichment_grid``      profiles + evidence -> prompts -> answers -> AUC per cell
``response_transfer``    vectors -> teacher soft labels -> student -> AUC and divergences
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clienttrace.functions import answers
from clienttrace.functions.scalars import signed_log1p
from clienttrace.functions.vectors import total
from clienttrace.operators import (aggregates, events, evidence, knn, metrics, models, profiles, prompts, sampling,
                                   scoring, sequences, vectors)
from clienttrace.operators.boosting import Boosting
from clienttrace.session import shared_folder, side_by_side, written
from clienttrace.sources.results import skip_completed_cells


def evaluate_embeddings(client_events: DataFrame, labels: DataFrame, task: str = "binary", dim: int = 64,
                        seeds: Sequence[int] = (42,), minimum: int = 25,
                        params: Mapping[str, object] | None = None) -> DataFrame:
    """Metrics of three classifiers on learned client vectors, mean and std over seeds."""
    params = params or {}
    log_events = client_events.withColumn("log_amount", signed_log1p(F.col("amount")))
    records = written(sequences.build_sequences(log_events, ["category", "amount", "log_amount"], labels, minimum),
                      "records")
    embedded = models.as_features(written(vectors.embed_sequences(records, "category", "amount", dim), "embedded"))
    def run(seed: int) -> DataFrame:
        split = sampling.stratified_split(embedded.select("customer_id", "target", "features", "label"), seed=seed)
        return models.evaluate_all(split.where("split = 'train'"), split.where("split = 'test'"), task, seed,
                                   **params).withColumn("seed", F.lit(seed))

    runs = None
    for table in side_by_side([lambda seed=seed: run(seed) for seed in seeds]):
        runs = table if runs is None else runs.unionByName(table)
    return metrics.metric_by_group(runs, ["model", "metric"], ["value"])


def client_evidence(client_events: DataFrame, labels: DataFrame, vector_table: DataFrame, k: int = 10,
                    params: Boosting | None = None, seed: int = 42) -> DataFrame:
    """Per test client: model probability, top factors and neighbour votes.

    Trained and searched on the train split only; test clients come out.
    """
    split = sampling.stratified_split(labels, seed=seed)
    # Read by every pass of the fit and by the explanation: kept.
    features = written(events.left_with_default(split, aggregates.client_features(client_events),
                                                {f: 0.0 for f in aggregates.FEATURES}), "features")
    train, test = (features.where(F.col("split") == s) for s in ("train", "test"))
    model = models.tree_estimator("binary", params or models.EXTREME, seed).fit(models.assemble(train))
    explained = evidence.tree_attributions(model.leaves(), test, train).select(
        "customer_id", evidence.top_factors(F.col("attributions"), 3).alias("factors"),
        (1 / (1 + F.exp(-F.col("score")))).alias("prob"))
    placed = vector_table.join(split, "customer_id")
    base, query = (placed.where(F.col("split") == s) for s in ("train", "test"))
    near = knn.knn_join(vectors.max_abs_scale(base, query), vectors.max_abs_scale(base, base), k)
    votes = evidence.knn_vote_binary(near, base).withColumnRenamed("query_id", "customer_id")
    return test.select("customer_id", "target").join(explained, "customer_id").join(votes, "customer_id")


def enrichment_grid(client_events: DataFrame, labels: DataFrame, vector_table: DataFrame, scorer: scoring.Scorer,
                    task: prompts.Task, model: str, category: str = "category",
                    params: Boosting | None = None, store: str | None = None, cap: float = float("inf"),
                    finished: DataFrame | None = None, wave_calls: int = 100_000) -> DataFrame:
    """AUC, valid share, cost and calls of every strategy x evidence cell for one scorer.

    Answers are committed in waves to ``store`` (a fresh shared folder if not
    given): a second run over it sends nothing twice, and a cell that has spent
    more than ``cap`` stops. Cells in ``finished`` (column ``tag``) are skipped.
    Test clients without a vector have no neighbours to show and are left out.
    Few-shot examples come from the train split, so no prompt holds a test client's label.
    """
    pos, neg = task.pos, task.neg
    texts = profiles.client_profile(client_events, category)
    shown = sampling.stratified_split(labels).where("split = 'train'").drop("split")
    block = prompts.few_shot_block(
        sampling.first_per_class(texts.join(shown, "customer_id"), "customer_id", keep=["profile"]).select(
            (2 - F.col("target")).alias("position"), "profile",
            F.when(F.col("target") == 1, pos).otherwise(neg).alias("label"))).scalar()
    known = client_evidence(client_events, labels, vector_table, params=params)
    clients = events.left_with_default(known, texts, {"profile": profiles.NO_DATA}).withColumn("block", block)
    grid = prompts.prompt_grid(clients.sparkSession, [model])
    cells = prompts.spread_over_grid(clients, grid if finished is None else skip_completed_cells(grid, finished))

    def text(kind: str):
        return evidence.evidence_text(kind, pos, neg, F.col("prob"), F.col("factors"),
                                      (F.col("pos"), F.col("neg"), F.col("majority")))
    kind = F.col("enrichment")
    made = (cells.withColumn("evidence", F.when(kind == "shap", text("shap")).when(kind == "knn", text("knn"))
                             .when(kind == "both", text("both")).otherwise(""))
            .withColumn("messages", prompts.build_messages(task, F.col("strategy"), F.col("evidence"),
                                                           F.col("profile"), F.col("block")))
            .withColumnRenamed("tag", "run_id"))
    raw = scoring.score_in_waves(made.withColumn("model", F.lit(model)), scorer, store or shared_folder(made.sparkSession, "answers"),
                                 keep=["strategy", "enrichment", "target"], cap=cap, wave_calls=wave_calls)
    prob = F.when(F.col("status") == "ok", answers.answer_probability(F.col("response"), pos, neg))
    preds = raw.withColumn("score", prob)
    group = ["strategy", "enrichment"]
    return (metrics.roc_auc(preds, group).join(metrics.valid_share(preds, F.col("score").isNotNull(), group), group)
            .join(scoring.usage_summary(preds, group), group))


def response_transfer(vector_table: DataFrame, alpha: float, classes: int = 2, k: int = 5, seeds: Sequence[int] = (42,),
                      teacher_table: DataFrame | None = None, teacher_params: Boosting | None = None,
                      student_params: Mapping[str, object] = models.LOGISTIC) -> DataFrame:
    """Student trained on labels mixed with out-of-fold probabilities of a teacher that sees other vectors.

    ``teacher_table`` (``customer_id, embedding``) is the teacher's source, by
    default the student's own; clients it lacks fail the job. Mean and standard
    deviation over ``seeds`` of the test AUC (two classes) or accuracy, and of the
    student's divergences from the teacher on the train part.
    """
    def run(seed: int) -> DataFrame:
        split = sampling.stratified_split(models.as_features(vector_table), seed=seed)
        train, test = (split.where(F.col("split") == s) for s in ("train", "test"))
        shown = train
        if teacher_table is not None:
            theirs = teacher_table.select("customer_id", F.col("embedding").alias("_theirs"))
            shown = models.as_features(events.align_by_id(train.drop("features", "label"), theirs), "_theirs")
        soft = models.teacher_soft_labels(shown, models.tree_estimator("multiclass", teacher_params, seed), k, seed)
        known = written(events.align_by_id(train, soft.select("customer_id", "soft_labels")), "teacher")
        student = models.soft_label_student(known, alpha, classes, params=student_params)
        fitted, held = models.scored(student, known), models.scored(student, test)
        logits = F.transform("probs", lambda p: F.log(F.greatest(p, F.lit(1e-12))))
        gap = fitted.select(metrics.forward_kl(F.col("soft_labels"), logits).alias("f"),
                            metrics.reverse_kl(F.col("soft_labels"), logits).alias("r"),
                            total(F.col("soft_labels")).alias("mass"))
        quality = (metrics.roc_auc(held, target="label", out="quality") if classes == 2
                   else metrics.accuracy(held, target="label").withColumnRenamed("accuracy", "quality"))
        one = gap.agg(F.avg("f").alias("forward_kl"), F.avg("r").alias("reverse_kl"), F.avg("mass").alias("mass"),
                      F.count(F.lit(1)).cast("double").alias("train_rows")).withColumn("quality", quality.scalar())
        return one.withColumn("seed", F.lit(seed))

    runs = None
    for one in side_by_side([lambda seed=seed: run(seed) for seed in seeds]):
        runs = one if runs is None else runs.unionByName(one)
    return metrics.metric_by_group(runs, [], ["forward_kl", "reverse_kl", "mass", "train_rows", "quality"])
