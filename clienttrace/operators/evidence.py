"""Retrieval votes, attributions and the evidence texts made from them."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clienttrace.functions.scalars import case_label, fmt0, fmt3, fmt_pct
from clienttrace.functions.vectors import argmax_class
from clienttrace.operators.aggregates import FEATURES
from clienttrace.operators.ranks import hash_order

#: Leaves whose shares are looked up together.
LEAF_BLOCK = 512


def knn_vote_binary(neighbours: DataFrame, labels: DataFrame, target: str = "target",
                    key: str = "customer_id") -> DataFrame:
    """``pos, neg, majority`` among the neighbours; a tie is negative."""
    voted = neighbours.join(labels.select(F.col(key).alias("base_id"), F.col(target).alias("_y")), "base_id")
    return (voted.groupBy("query_id")
            .agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") != 1).alias("neg"))
            .withColumn("majority", (F.col("pos") > F.col("neg")).cast("int")))


def knn_vote_multiclass(neighbours: DataFrame, labels: DataFrame, classes: int, k: int = 10, target: str = "target",
                        key: str = "customer_id") -> DataFrame:
    """``counts`` per class (zero filled), the top class (lowest on a tie) and its share."""
    voted = neighbours.join(labels.select(F.col(key).alias("base_id"), F.col(target).alias("_y")), "base_id")
    counts = F.array(*[F.count_if(F.col("_y") == c) for c in range(classes)])
    return (voted.groupBy("query_id").agg(counts.alias("counts"))
            .withColumn("top_class", argmax_class(F.col("counts")))
            .withColumn("share", F.array_max("counts") / F.lit(k)))


def linear_attribution(rows: DataFrame, weights: Mapping[str, float], background: DataFrame,
                       key: str = "customer_id") -> DataFrame:
    """Contributions ``w * (x - mean)`` of a linear model, means from the background."""
    means = background.agg(F.struct(*[F.avg(F.col(c).cast("double")).alias(c) for c in weights])).scalar()
    items = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                      (F.lit(float(w)) * (F.col(c).cast("double") - F.col("_mean")[c])).alias("phi"))
             for c, w in weights.items()]
    return (rows.withColumn("_mean", means)
            .select(key, F.array(*items).alias("attributions")))


def attributions(model, rows: DataFrame, background: DataFrame, score: Column,
                 features: Sequence[str] = FEATURES, key: str = "customer_id", background_rows: int = 50,
                 seed: int = 42, carry: Sequence[str] = ()) -> DataFrame:
    """Exact Shapley values of any Spark ML model over a few features.

    ``model`` scores a table with one column per feature (a pipeline starting
    with an assembler); ``score`` is the explained value on its result, e.g.
    twice the raw prediction of a boosted tree model (log-odds). ``carry``
    names columns of the row the score may use, such as its predicted class
    when one class of several is explained. Absent features take their values from a fixed sample of background rows. Every
    row becomes coalitions x background rows inside its own partition, and the
    scores are averaged map side before they are shuffled.
    """
    d = len(features)
    if d > 12:
        raise ValueError("more than 12 features need sampled coalitions")
    # A bounded sample: background_rows x features numbers.
    sample = (background.orderBy(hash_order(F.col(key), seed), key).limit(background_rows)
              .select(*[F.col(f).cast("double") for f in features]).collect())
    literal = F.from_json(F.lit(json.dumps([list(r) for r in sample])), "array<array<double>>")
    present = [F.col("_mask").bitwiseAND(F.lit(1 << j)) != 0 for j in range(d)]
    mixed = (rows.select(key, *carry, *[F.col(f).cast("double").alias(f"_x{j}") for j, f in enumerate(features)])
             .withColumn("_mask", F.explode(F.sequence(F.lit(0), F.lit(2 ** d - 1))))
             .withColumn("_b", F.explode(literal))
             .withColumns({f: F.when(present[j], F.col(f"_x{j}")).otherwise(F.col("_b")[j])
                           for j, f in enumerate(features)}))
    values = (model.transform(mixed).groupBy(key, "_mask")
              .agg(F.avg(score).alias("_v"), *[F.first(f"_x{j}").alias(f"_x{j}") for j in range(d)]))
    size = F.bit_count("_mask").cast("int")
    join_weight = F.element_at(F.array(*[F.lit(factorial(s - 1) * factorial(d - s) / factorial(d) if s else 0.0)
                                         for s in range(d + 1)]), size + 1)
    leave_weight = F.element_at(F.array(*[F.lit(factorial(s) * factorial(d - s - 1) / factorial(d) if s < d else 0.0)
                                          for s in range(d + 1)]), size + 1)
    phi = [F.sum(F.when(present[j], F.col("_v") * join_weight).otherwise(-F.col("_v") * leave_weight)).alias(f"_p{j}")
           for j in range(d)]
    full = F.max(F.when(F.col("_mask") == 2 ** d - 1, F.col("_v"))).alias("score")
    empty = F.max(F.when(F.col("_mask") == 0, F.col("_v"))).alias("base_score")
    items = [F.struct(F.lit(f).alias("feature"), F.col(f"_x{j}").alias("value"), F.col(f"_p{j}").alias("phi"))
             for j, f in enumerate(features)]
    return (values.groupBy(key).agg(*phi, full, empty, *[F.first(f"_x{j}").alias(f"_x{j}") for j in range(d)])
            .select(key, "score", "base_score", F.array(*items).alias("attributions")))


@dataclass
class Leaves:
    """The leaves of a tree model: per leaf and feature the range (low, high] that leads there, and its value."""

    low: np.ndarray
    high: np.ndarray
    value: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per feature the bounds of all ranges, and for each bin between them a line with the feature's bit where a
        leaf's range holds the bin."""
        out = []
        for j, (low, high) in enumerate(zip(self.low.T, self.high.T)):
            cuts = np.unique(np.r_[low, high])
            cuts = cuts[np.isfinite(cuts)]
            start, end = np.searchsorted(cuts, low, "right"), np.searchsorted(cuts, high, "left")
            start[np.isneginf(low)] = 0
            start[np.isposinf(low)] += 1
            bins = np.arange(len(cuts) + 1)[:, None]
            out.append((cuts, ((start <= bins) & (bins <= end)).astype(np.uint16) << np.uint16(j)))
        return out

    def masks(self, x: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """For each row and leaf a bit per feature that is in the leaf's range; NaN goes right, as in Spark's trees."""
        out = np.zeros((len(x), len(self.value)), np.uint16)
        for column, (cuts, lines) in zip(x.T, tables or self.tables()):
            out |= lines[np.searchsorted(cuts, column)]
        return out


def boosted_leaves(model, features: int, scale: float = 2.0) -> Leaves:
    """Leaves of a fitted boosted tree model, values times tree weight and ``scale`` (2: log-odds)."""
    low, high, value = [], [], []
    for tree, weight in zip(model.trees, model.treeWeights):
        todo = [(tree._java_obj.rootNode(), np.full(features, -np.inf), np.full(features, np.inf))]
        while todo:
            node, lo, hi = todo.pop()
            if node.subtreeDepth() == 0:
                low.append(lo)
                high.append(hi)
                value.append(node.prediction() * weight * scale)
                continue
            j, at = node.split().featureIndex(), node.split().threshold()
            left, right = hi.copy(), lo.copy()
            left[j], right[j] = min(hi[j], at), max(lo[j], at)
            todo += [(node.leftChild(), lo, left), (node.rightChild(), right, hi)]
    return Leaves(np.array(low), np.array(high), np.array(value))


def tree_attributions(leaves: Leaves, rows: DataFrame, background: DataFrame, features: Sequence[str] = FEATURES,
                      key: str = "customer_id") -> DataFrame:
    """Exact Shapley values of a tree model over the whole background.

    A leaf's value counts for a coalition if the row's features in it and a
    background row's other features lie in the leaf's ranges. So all the
    background has to tell is, per leaf, how many of its rows have which
    features in range: leaves x coalitions counts, combined map side. From
    these the shares of every (leaf, mask) follow once, and a row only sums
    those of its own masks; it is never multiplied by the background.
    """
    d = len(features)
    if d > 12:
        raise ValueError("more than 12 features: use paths.path_attributions")
    n_leaves, coalitions = len(leaves.value), 1 << d
    step = max(1, (1 << 20) // max(1, n_leaves))
    ranges = leaves.tables()

    def numbers(df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, *[F.col(f).cast("double").alias(f"_x{j}") for j, f in enumerate(features)])

    def masks(pdf: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray]]:
        x = pdf[[f"_x{j}" for j in range(d)]].to_numpy(float)
        for start in range(0, len(x), step):
            yield slice(start, start + step), leaves.masks(x[start:start + step], ranges)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(n_leaves * coalitions, np.int64)
        for pdf in batches:
            for _, m in masks(pdf):
                seen += np.bincount((m + np.arange(n_leaves) * coalitions).ravel(), minlength=len(seen))
        used = np.flatnonzero(seen)
        yield pd.DataFrame({"cell": used, "n": seen[used]})

    found = numbers(background).mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(n_leaves * coalitions)
    for row in found:
        counts[row["cell"]] = row["n"]
    counts = counts.reshape(n_leaves, coalitions)
    total = max(counts.sum(axis=1).max(initial=0.0), 1.0)
    every = np.arange(coalitions)
    # Share of the background with at least the features outside a coalition in range.
    rest = np.stack([counts[:, (every & ~s & (coalitions - 1)) == (~s & (coalitions - 1))].sum(axis=1) / total
                     for s in range(coalitions)], axis=1) * leaves.value[:, None]
    phi = np.zeros((n_leaves, coalitions, d))
    for s in range(coalitions):
        size = s.bit_count()
        held = (every & s) == s
        for j in range(d):
            inside = bool(s >> j & 1)
            others = size - inside
            weight = factorial(others) * factorial(d - others - 1) / factorial(d)
            phi[:, held, j] += (weight if inside else -weight) * rest[:, s, None]
    base = float(rest[:, 0].sum())
    # A few leaves at a time for many rows, so that their shares stay in a core's cache.
    shares, first = np.ascontiguousarray(phi.reshape(-1, d).T), np.arange(LEAF_BLOCK) * coalitions

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, score = np.zeros((len(pdf), d)), np.zeros(len(pdf))
            for part, m in masks(pdf):
                for leaf in range(0, n_leaves, LEAF_BLOCK):
                    some = m[:, leaf:leaf + LEAF_BLOCK]
                    at = some + first[:some.shape[1]]
                    for j, line in enumerate(shares[:, leaf * coalitions:(leaf + LEAF_BLOCK) * coalitions]):
                        out[part, j] += line.take(at).sum(axis=1)
                score[part] = (m == coalitions - 1) @ leaves.value
            yield pdf.assign(score=score, base_score=base, **{f"_p{j}": out[:, j] for j in range(d)})

    given = numbers(rows, key)
    schema = ", ".join([f"{key} {given.schema[key].dataType.simpleString()}", *(f"_x{j} double" for j in range(d)),
                        "score double", "base_score double", *(f"_p{j} double" for j in range(d))])
    items = [F.struct(F.lit(f).alias("feature"), F.col(f"_x{j}").alias("value"), F.col(f"_p{j}").alias("phi"))
             for j, f in enumerate(features)]
    return given.mapInPandas(explain, schema).select(key, "score", "base_score", F.array(*items).alias("attributions"))


def top_factors(attributions: Column, k: int = 3) -> Column:
    """The ``k`` entries with the largest |phi|; ties keep the feature order."""
    numbered = F.transform(attributions, lambda x, i: F.struct(
        (-F.abs(x["phi"])).alias("size"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.sort_array(numbered), 1, k), lambda x: x["x"])


# --- evidence texts ---------------------------------------------------------

def factor_text(factors: Column, style: str, label: str | Column) -> Column:
    """Factors as text: ``supports`` (name=value), ``impact``, ``size`` or ``class``."""
    label = F.lit(label) if isinstance(label, str) else label

    def item(x: Column) -> Column:
        up = x["phi"] > 0
        if style == "supports":
            return F.concat(x["feature"], F.lit("="), fmt0(x["value"]), F.lit(" ("),
                            F.when(up, "supports ").otherwise("against "), label, F.lit(")"))
        if style == "impact":
            return F.concat(x["feature"], F.lit(" ("), F.when(up, "increases").otherwise("decreases"),
                            F.lit(", impact="), fmt3(F.abs(x["phi"])), F.lit(")"))
        if style == "signed":
            return F.concat(x["feature"], F.lit(" ("), F.when(up, "increases").otherwise("decreases"),
                            F.lit(", "), fmt3(F.abs(x["phi"])), F.lit(")"))
        if style == "size":
            return F.concat(x["feature"], F.lit(" ("), fmt3(F.abs(x["phi"])), F.lit(")"))
        return F.concat(x["feature"], F.lit("="), fmt0(x["value"]), F.lit(" ("),
                        F.when(up, "high").otherwise("low"), F.lit(" → "), label, F.lit(")"))
    return F.array_join(F.transform(factors, item), "; ")


def _predicted(prob: Column, pos: str, neg: str, strict: bool) -> tuple[Column, Column]:
    yes = prob > 0.5 if strict else prob >= 0.5
    return F.when(yes, pos).otherwise(neg), fmt_pct(F.when(yes, prob).otherwise(1 - prob))


def _label(bit: Column, pos: str, neg: str) -> Column:
    return F.when(bit == 1, pos).otherwise(neg)


def _cat(*pieces: str | Column) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])


def evidence_text(kind: str, pos: str, neg: str, prob: Column | None = None, factors: Column | None = None,
                  votes: tuple[Column, Column, Column] | None = None, joint: str = "append") -> Column:
    """Evidence for a binary prompt.

    ``kind``: ``none``, ``shap``, ``knn``, ``counts`` (votes without the
    majority), ``both`` or ``prediction``. ``prob``
    is the model's positive probability, ``factors`` an attribution array,
    ``votes`` the columns (pos, neg, majority). ``both`` appends one text to
    the other or (``joint="compact"``) uses the shorter form.
    """
    if kind == "none":
        return F.lit("")
    if kind == "prediction":
        label, sure = _predicted(prob, pos, neg, strict=False)
        return _cat("ML model: predicts ", label, " (", sure, " confidence).")
    if kind == "counts":
        return _cat("\nSimilar clients: ", votes[0].cast("string"), f" {pos}, ", votes[1].cast("string"), f" {neg}.")
    shap = knn = None
    if kind in ("shap", "both"):
        label, sure = _predicted(prob, pos, neg, strict=True)
        text = factor_text(factors, "supports", pos)
        if kind == "both" and joint == "compact":
            return _cat("\nML model: ", label, " (", sure, "). Factors: ", text, ".\nSimilar clients: ",
                        votes[0].cast("string"), f" {pos}, ", votes[1].cast("string"), f" {neg}.\n")
        shap = _cat("\nML model: predicts ", label, " (", sure, " confidence).\nKey factors: ", text, ".\n")
    if kind in ("knn", "both"):
        knn = _cat("\nSimilar clients: ", votes[0].cast("string"), f" {pos}, ", votes[1].cast("string"),
                   f" {neg} (majority: ", _label(votes[2], pos, neg), ").\n")
    if shap is None:
        return knn
    return shap if knn is None else F.concat(shap, knn)


def knn_sentence(votes: tuple[Column, Column, Column], pos: str, neg: str, k: int = 10) -> Column:
    return _cat(f"Similar clients (top-{k} nearest by transaction patterns): ", votes[0].cast("string"), f" {pos}, ",
                votes[1].cast("string"), f" {neg} (majority: ", _label(votes[2], pos, neg), ").")


def impact_sentence(prob: Column, factors: Column, pos: str, neg: str) -> Column:
    """One sentence with the predicted label, its positive share and impacts."""
    return _cat("XGBoost predicts '", F.when(prob > 0.5, pos).otherwise(neg), "' (", fmt_pct(prob),
                f" {pos} confidence). Key factors: ", factor_text(factors, "impact", pos), ".")


def churn_sentence(prob: Column, factors: Column, pos: str = "churn", neg: str = "stay") -> Column:
    return _cat("ML predicts '", F.when(prob > 0.5, pos).otherwise(neg), "' (", fmt_pct(prob),
                f" {pos} prob). Key: ", factor_text(factors, "signed", pos), ".")


def class_sentence(predicted: Column, factors: Column, labels: Mapping[int, str]) -> Column:
    """One sentence with the predicted class and the sizes of its factors."""
    return _cat("ML predicts '", case_label(predicted, labels), "'. Key factors: ",
                factor_text(factors, "size", ""), ".")


def class_evidence(kind: str, labels: Mapping[int, str], short: Sequence[str], predicted: Column | None = None,
                   factors: Column | None = None, counts: Column | None = None, k: int = 10) -> Column:
    """Evidence for a multiclass prompt: ``none``, ``shap``, ``knn`` or ``both``."""
    if kind == "none":
        return F.lit("")
    named = case_label(predicted, labels) if predicted is not None else None
    neighbours = top = share = None
    if counts is not None:
        neighbours = F.array_join(F.array(*[_cat(f"{name}=", counts[i].cast("string"))
                                            for i, name in enumerate(short)]), ", ")
        top = case_label(argmax_class(counts), labels)
        share = fmt_pct(F.array_max(counts) / F.lit(float(k)))
    text = factor_text(factors, "class", named) if factors is not None else None
    if kind == "shap":
        return _cat("ML model analysis:\nXGBoost predicts: ", named, ".\nKey factors: ", text, ".")
    if kind == "knn":
        return _cat(f"Similar clients analysis:\nAmong {k} most similar clients: ", neighbours,
                    ".\nMost common age group: ", top, " (", share, " of neighbors).")
    return _cat("Evidence 1 - ML model:\nXGBoost predicts: ", named, ".\nKey factors: ", text,
                f".\n\nEvidence 2 - Similar clients:\nAmong {k} similar clients: ", neighbours,
                ".\nMajority: ", top, ".")


def class_prediction(predicted: Column, prob: Column) -> Column:
    return _cat("ML model predicts: class ", predicted.cast("string"), " (", fmt_pct(prob), " confidence).")
