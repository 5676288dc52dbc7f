"""Evaluation metrics and batch losses as aggregates.

Every metric takes grouping columns (model, strategy, seed, ...) and returns
one row per group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clienttrace.functions.vectors import euclidean_distance, l2_normalize, log_softmax, softmax, total
from clienttrace.operators.ranks import join_groups
from clienttrace.session import written

# Slices with about equally many distinct scores, whatever their spread.
SCORE_SLICES = 64


#: Rows of a contrastive batch, whose similarities are a matrix in one task.
MAX_BATCH = 4_096


def with_slices(counts: DataFrame, score: str) -> DataFrame:
    """Adds ``_slice``: the number of bounds below a score, bounds from a quantile sketch of all distinct scores."""
    shares = F.array(*[F.lit(i / SCORE_SLICES) for i in range(1, SCORE_SLICES)])
    bounds = counts.agg(F.percentile_approx(score, shares, 1000)).scalar()
    below = F.size(F.filter("_bounds", lambda b: b < F.col(score)))
    return counts.withColumn("_bounds", bounds).withColumn("_slice", below).drop("_bounds")


def roc_auc(preds: DataFrame, group: Sequence[str] = (), target: str = "target", score: str = "score",
            out: str = "roc_auc") -> DataFrame:
    """Exact area under the ROC curve; tied scores count one half.

    Rows are first counted per distinct score, map side. Each positive then
    needs the negatives below it: those in lower score slices (a small table)
    plus those below it inside its own slice. Null for groups with one class.
    Null and NaN scores rank nothing and are left out; null is a group like any other.
    """
    group = list(group)
    parts = group + ["_slice"]
    counts = (preds.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
              .groupBy(*group, F.col(score).cast("double").alias("_score"))
              .agg(F.count_if(F.col(target) == 1).alias("_pos"), F.count_if(F.col(target) != 1).alias("_neg")))
    counts = with_slices(counts, "_score")
    lower_slices = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (counts.groupBy(*parts).agg(F.sum("_neg").alias("_slice_neg"))
              .withColumn("_below", F.coalesce(F.sum("_slice_neg").over(lower_slices), F.lit(0)))
              .drop("_slice_neg"))
    inside = Window.partitionBy(*parts).orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("_pos") * (F.col("_below") + F.col("_inside") + F.col("_neg") / 2)
    return (join_groups(counts.withColumn("_inside", F.coalesce(F.sum("_neg").over(inside), F.lit(0))), slices, parts)
            .groupBy(*group)
            .agg(F.try_divide(F.sum(wins), F.sum("_pos").cast("double") * F.sum("_neg")).alias(out)))


def accuracy(preds: DataFrame, group: Sequence[str] = (), target: str = "target", pred: str = "pred",
             valid: Column | None = None) -> DataFrame:
    """Share of equal labels, over the rows where ``valid`` holds."""
    hit = (F.col(target) == F.col(pred)).cast("double")
    return preds.groupBy(*group).agg(F.avg(hit if valid is None else F.when(valid, hit)).alias("accuracy"))


def f1_binary(preds: DataFrame, group: Sequence[str] = (), target: str = "target", pred: str = "pred") -> DataFrame:
    y, p = F.col(target) == 1, F.col(pred) == 1
    hits = F.count_if(y & p)
    return preds.groupBy(*group).agg(
        F.coalesce(F.try_divide(2.0 * hits, F.count_if(y) + F.count_if(p)), F.lit(0.0)).alias("f1"))


def f1_macro(preds: DataFrame, group: Sequence[str] = (), target: str = "target", pred: str = "pred") -> DataFrame:
    """Plain mean of the class F1 over classes seen in labels or predictions.

    The confusion table is counted first; only that is spread to classes.
    """
    group = list(group)
    table = preds.groupBy(*group, target, pred).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.when(F.col(target) == F.col(pred), F.col("_n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col(target).alias("cls"), hit.alias("tp"), F.col("_n").alias("y"), zero.alias("p")),
        F.struct(F.col(pred).alias("cls"), zero.alias("tp"), zero.alias("y"), F.col("_n").alias("p")))
    per_class = (table.select(*group, F.inline(sides)).groupBy(*group, "cls")
                 .agg((2.0 * F.sum("tp") / (F.sum("y") + F.sum("p"))).alias("_f1")))
    return per_class.groupBy(*group).agg(F.avg("_f1").alias("f1_macro"))


def valid_share(preds: DataFrame, valid: Column, group: Sequence[str] = ()) -> DataFrame:
    return preds.groupBy(*group).agg((F.count_if(valid) / F.count(F.lit(1))).alias("valid_share"))


def metric_by_group(metrics: DataFrame, group: Sequence[str], names: Sequence[str], ddof: int = 1) -> DataFrame:
    """Mean and std of metrics over seeds; a metric a model lacks stays null."""
    spread = F.stddev_samp if ddof else F.stddev_pop
    stats = [c for n in names for c in (F.avg(n).alias(f"{n}_mean"), spread(n).alias(f"{n}_std"))]
    return metrics.groupBy(*group).agg(*stats, F.count(F.lit(1)).alias("n_seeds"))


def leaderboard(results: DataFrame, name: str, metric: str, baseline: str) -> DataFrame:
    """Results in descending order with the difference to the baseline row."""
    base = results.where(F.col(name) == baseline).agg(F.max(metric)).scalar()
    return (results.withColumn("delta", F.col(metric) - base)
            .orderBy(F.col(metric).desc(), F.col(name)))


def best_epoch(history: DataFrame, group: Sequence[str], epoch: str = "epoch", val: str = "val_score",
               test: str = "test_score") -> DataFrame:
    """Test score at the best validation score (first such epoch), if it beats the start."""
    start = F.struct(F.col(epoch))
    first_best = F.struct(F.col(val), -F.col(epoch))
    found = history.groupBy(*group).agg(
        F.min_by(val, start).alias("start_val"), F.min_by(test, start).alias("start_test"),
        F.max(val).alias("best_val"), F.max_by(epoch, first_best).alias("best_epoch"),
        F.max_by(test, first_best).alias("best_test"))
    better = F.col("best_val") > F.col("start_val")
    return (found.withColumn("kept", better)
            .withColumn("final_test", F.when(better, F.col("best_test")).otherwise(F.col("start_test"))))


def running_metric(preds: DataFrame, every: int, seq: str = "seq", group: Sequence[str] = (),
                   target: str = "target", score: str = "score") -> DataFrame:
    """AUC and accuracy (at 0.5) over the first n rows, n = every, 2*every, ..., all.

    ``seq`` numbers the rows of a group from 1. Rows are counted per (block of
    ``every``, score), map side. A pair of a positive and a negative counts in
    every prefix from the later block of the two on. Pairs are met in the nodes
    of a binary tree over the blocks: there the counts of the earlier half and
    of the later half meet for the first time, ordered by score. So a count goes
    to one node per level, log2(blocks) of them, and running sums give all
    prefixes. Null and NaN scores rank nothing, as in ``roc_auc``; their rows
    count in ``n_rows`` alone. Null is a group like any other.
    """
    group = list(group)
    rows = preds.select(*group, F.floor((F.col(seq) - 1) / every).cast("long").alias("_block"), F.col(target).alias("_y"),
                        F.col(score).cast("double").alias("_score"))
    counts = written(rows.groupBy(*group, "_block", "_score").agg(
        F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") != 1).alias("_neg"), F.count(F.lit(1)).alias("_all")), "counts")
    scored = F.col("_score").isNotNull() & ~F.isnan("_score")
    ranked = counts.where(scored)
    top = (counts.agg(F.max("_block")).first()[0] or 0).bit_length()

    # At level l a node is 2^l blocks and its later half has bit l - 1 set; level 0 is a block by itself.
    levels = F.array(*[F.struct(F.lit(n).alias("_level"), F.shiftright("_block", n).alias("_node"),
                                (F.shiftright("_block", max(n - 1, 0)) % 2 == 1).alias("_later")) for n in range(top + 1)])
    nodes = with_slices(ranked, "_score").select("*", F.inline(levels))
    own = F.col("_level") == 0
    nodes = nodes.withColumns({"_enemies": F.when(own | ~F.col("_later"), F.col("_neg")).otherwise(0),
                               "_friends": F.when(~own & ~F.col("_later"), F.col("_pos")).otherwise(0)})
    at, parts = [*group, "_level", "_node"], [*group, "_level", "_node", "_slice"]
    lower = Window.partitionBy(*at).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = nodes.groupBy(*parts).agg(F.sum("_enemies").alias("_e"), F.sum("_friends").alias("_f")).select(
        *parts, F.coalesce(F.sum("_e").over(lower), F.lit(0)).alias("_e_below"), F.coalesce(F.sum("_f").over(lower), F.lit(0)).alias("_f_below"),
        F.sum("_f").over(Window.partitionBy(*at)).alias("_f_all"))
    upto = Window.partitionBy(*parts).orderBy("_score").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = Window.partitionBy(*parts, "_score")
    met = join_groups(nodes.withColumns({
        "_e_upto": F.sum("_enemies").over(upto), "_f_upto": F.sum("_friends").over(upto),
        "_e_equal": F.sum("_enemies").over(equal), "_f_equal": F.sum("_friends").over(equal)}), slices, parts)
    beaten = F.col("_pos") * (F.col("_e_below") + F.col("_e_upto") - F.col("_e_equal") / 2)
    lost = F.col("_neg") * (F.col("_f_all") - F.col("_f_below") - F.col("_f_upto") + F.col("_f_equal") / 2)
    wins = met.groupBy(*group, "_block").agg(F.sum(F.when(own, beaten).when(F.col("_later"), beaten + lost).otherwise(0.0)).alias("_wins"))

    right = F.when(F.col("_score") >= 0.5, F.col("_pos")).otherwise(F.col("_neg"))
    blocks = counts.groupBy(*group, "_block").agg(
        F.sum("_all").alias("_all"), *(F.coalesce(F.sum(F.when(scored, c)), F.lit(0)).alias(n) for n, c in (
            ("_pos", F.col("_pos")), ("_neg", F.col("_neg")), ("_right", right))))
    so_far = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = join_groups(blocks, wins, [*group, "_block"], "left").select(
        *group, *(F.sum(c).over(so_far).alias(c) for c in ("_all", "_pos", "_neg", "_right")),
        F.sum(F.coalesce("_wins", F.lit(0.0))).over(so_far).alias("_wins"))
    return totals.select(*group, F.col("_all").alias("n_rows"),
                         F.try_divide(F.col("_wins"), F.col("_pos").cast("double") * F.col("_neg")).alias("roc_auc"),
                         F.try_divide(F.col("_right").cast("double"), F.col("_pos") + F.col("_neg")).alias("accuracy"))


def strategy_matrix(results: DataFrame, metric: str, strategies: str = "strategy", enrichment: str = "enrichment",
                    columns: Sequence[str] = ("none", "shap", "knn", "both")) -> DataFrame:
    return results.groupBy(strategies).pivot(enrichment, list(columns)).agg(F.first(metric))


def delta_points(results: DataFrame, group: Sequence[str], variant: str, metric: str, a: str, b: str) -> DataFrame:
    """``(metric of b - metric of a) * 100`` per group."""
    def of(v: str) -> Column:
        return F.max(F.when(F.col(variant) == v, F.col(metric)))
    return results.groupBy(*group).agg(of(a).alias(a), of(b).alias(b), ((of(b) - of(a)) * 100).alias("delta_points"))


# --- losses over probability columns ----------------------------------------

def forward_kl(teacher: Column, logits: Column) -> Column:
    """Sum over classes of ``p ln(p / q)`` with ``q = softmax(logits)``, for one row."""
    terms = F.zip_with(teacher, log_softmax(logits), lambda p, lq: F.when(p > 0, p * (F.ln(p) - lq)).otherwise(0.0))
    return total(terms)


def reverse_kl(teacher: Column, logits: Column) -> Column:
    """Sum of ``q ln(q / p)``; both logarithms guarded by 1e-8."""
    return total(F.zip_with(teacher, softmax(logits),
                            lambda p, q: q * (F.ln(q + 1e-8) - F.ln(p + 1e-8))))


def symmetric_kl(a: Column, b: Column) -> Column:
    """Average of both directions for two logit vectors."""
    return (forward_kl(softmax(b), a) + forward_kl(softmax(a), b)) / 2


def bce(p: Column, q: Column) -> Column:
    """Binary cross entropy of the probability ``p`` against the target ``q``."""
    return -(q * F.greatest(F.ln(p), F.lit(-100.0)) + (1 - q) * F.greatest(F.ln(1 - p), F.lit(-100.0)))


def mutual_bce(p: Column, q: Column) -> Column:
    return (bce(p, q) + bce(q, p)) / 2


def cross_entropy(logits: Column, label: Column) -> Column:
    return -F.element_at(log_softmax(logits), label.cast("int") + 1)


def bce_logits(logit: Column, target: Column) -> Column:
    """Stable form of the binary cross entropy on a logit."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def difficulty_weights(df: DataFrame, a: str, b: str, batch: str = "batch_id", out: str = "weight") -> DataFrame:
    """Per-row weight from the distance of two normalised vectors.

    The distance (over the dimensions both have) is scaled to 0..1 within the
    batch, then softmaxed times the batch size. Batches are bounded, see
    ``assign_batches``.
    """
    shorter = F.least(F.size(a), F.size(b))
    distance = euclidean_distance(l2_normalize(F.slice(a, F.lit(1), shorter)),
                                  l2_normalize(F.slice(b, F.lit(1), shorter)))
    w = Window.partitionBy(batch)
    scaled = (F.col("_d") - F.min("_d").over(w)) / (F.max("_d").over(w) - F.min("_d").over(w) + 1e-8)
    return (df.withColumn("_d", distance).withColumn("_s", scaled)
            .withColumn(out, F.exp("_s") / F.sum(F.exp("_s")).over(w) * F.count(F.lit(1)).over(w))
            .drop("_d", "_s"))


def infonce(pairs: DataFrame, a: str, b: str, batch: str = "batch_id", key: str = "customer_id",
            temperature: float = 0.07, weight: str | None = None, normalise: bool = True) -> DataFrame:
    """Contrastive loss of both directions per batch: ``batch_id, n, loss``.

    Without weights the directions are averaged; with a weight column each row
    counts with its weight and the directions are added. The similarity matrix
    of a batch lives inside one task (batches are cut to a fixed size by
    ``assign_batches``), so no table of pairs is ever formed. A batch of more
    than ``MAX_BATCH`` rows raises an error.
    """
    columns = [batch, key, a, b] + ([weight] if weight else [])

    def loss(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_BATCH:
            raise ValueError(f"a batch of {len(pdf)} rows; cut batches to {MAX_BATCH} at most with assign_batches")
        pdf = pdf.sort_values(key)
        x, y = (np.stack(pdf[c].to_numpy()).astype(np.float64) for c in (a, b))
        if normalise:
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
        sims = x @ y.T / temperature

        def entropy(m: np.ndarray) -> np.ndarray:
            top = m.max(axis=1)
            return top + np.log(np.exp(m - top[:, None]).sum(axis=1)) - np.diag(m)

        one, two = entropy(sims), entropy(sims.T)
        if weight:
            w = pdf[weight].to_numpy(dtype=np.float64)
            value = (one * w).mean() + (two * w).mean()
        else:
            value = (one.mean() + two.mean()) / 2
        return pd.DataFrame({batch: [pdf[batch].iloc[0]], "n": [len(pdf)], "loss": [value]})

    return pairs.select(*columns).groupBy(batch).applyInPandas(loss, f"{batch} long, n long, loss double")


