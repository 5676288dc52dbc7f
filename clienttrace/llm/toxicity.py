"""Toxicity by a factorization machine over hashed terms.

A term is a word (A-Z in lower case, cut at ASCII signs), hashed to one of
``BUCKETS``. Its value in a document is the shrunken log ratio of how often it
occurs in toxic and in other documents, counted over *all* labelled documents.
A term that says nothing there is counted again among the documents left
unexplained, those without any term that speaks for toxicity: two words that
are toxic only together, each as often in toxic documents as any word, stand
out there. Terms that say nothing twice have value zero; so has a pair whose
words are even as common in unexplained toxic documents as in the other
unexplained ones. The machine adds a weight per term and, by factors of
``FACTORS`` numbers, a weight per pair of terms, so that two terms which are
harmless alone can weigh together:

    score = sigmoid(w0 + sum w_j x_j + 1/2 sum_f ((sum v_jf x_j)^2 - sum (v_jf x_j)^2))

The fit runs over a documented sample of at most about ``fit_rows`` labelled
rows (each class has half, less if it is smaller), in ``SHARDS`` tasks with
Adagrad from one start; their weights are averaged. Statistics and scores cover
all rows and whole texts. What reaches the driver is bounded by ``BUCKETS``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clienttrace.llm.common import columns, keep_texts, map_texts, written

BUCKETS = 1 << 18
FACTORS = 8
SHARDS = 4
EPOCHS = 12
#: Added to the counts, dealt out by the classes' shares: unseen terms get ratio zero.
SHRINK = 5.0
#: Standard deviations by which a term's toxic documents must differ from its share; else it says nothing.
LEAST_Z = 3.5
#: Unexplained toxic documents in which a term must occur to have a value by them.
LEAST_TOXIC = 10

#: Documents by term that are toxic and that are not, and their totals.
Counts = tuple[np.ndarray, np.ndarray, float, float]

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> np.ndarray:
    """The distinct term buckets of a whole text."""
    words = set(text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()) if text else ()
    return np.array(sorted({zlib.crc32(w) & (BUCKETS - 1) for w in words}), "<i4")


class Machine:
    """Weights of a fitted machine; ``ratio`` holds the value of each term."""

    def __init__(self, ratio: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.ratio, self.w0, self.w, self.v = ratio, w0, w, v

    def margin(self, idx: np.ndarray, x: np.ndarray) -> float:
        inner = x @ self.v[idx]
        pairs = float(inner @ inner) - float(((self.v[idx] * x[:, None]) ** 2).sum())
        return self.w0 + float(x @ self.w[idx]) + 0.5 * pairs

    def score(self, text: str | None) -> float:
        idx = terms(text)
        x = self.ratio[idx]
        used = x != 0
        return float(1 / (1 + np.exp(-np.clip(self.margin(idx[used], x[used]), -30, 30))))


def ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    if not n_toxic or not n_other:
        return np.zeros(len(toxic))
    share = n_toxic / (n_toxic + n_other)
    r = np.log((toxic + SHRINK * share) / (other + SHRINK * (1 - share))) - np.log(n_toxic / n_other)
    expected = (toxic + other) * share
    z = (np.abs(toxic - expected) - 0.5) / np.sqrt(np.maximum(expected * (1 - share), 1e-9))
    return np.where(z < LEAST_Z, 0.0, r)


def rest_ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    """As ``ratios``, from the unexplained documents."""
    return np.where(toxic >= LEAST_TOXIC, ratios(toxic, other, n_toxic, n_other), 0.0)


def _without(counts: Counts, idx: np.ndarray, label: int, counted: bool = True) -> Counts:
    """The counts of a row's terms without the row itself, if it was counted."""
    toxic, other, n_toxic, n_other = counts
    a, b = (label, 1 - label) if counted else (0, 0)
    return toxic[idx] - a, other[idx] - b, n_toxic - a, n_other - b


def start(prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Where every shard starts: the terms' ratios count as they are, pairs hardly."""
    v = np.random.default_rng(7).normal(0, 0.01, (BUCKETS, FACTORS))
    return prior, np.ones(BUCKETS), v


def train(rows: list[tuple[np.ndarray, int, float]], toxic: np.ndarray, other: np.ndarray, prior: float,
          totals: tuple[float, float], epochs: int = EPOCHS, rate: float = 0.3, l2: float = 1e-4,
          rest: Counts | None = None) -> Machine:
    """Adagrad over rows of (terms, label, weight); ``rest`` counts the unexplained documents.

    A row's own label is taken out of the counts before its values are made,
    else rare terms would give it away.
    """
    ratio = ratios(toxic, other, *totals)
    w0, w, v = start(prior)
    machine = Machine(None, w0, w, v)
    g0, gw, gv = 1.0, np.ones(BUCKETS), np.ones((BUCKETS, FACTORS))
    data = []
    for idx, label, weight in rows:
        x = ratios(*_without((toxic, other, *totals), idx, label))
        if rest is not None:
            unexplained = not (ratio[idx] > 0).any()
            x = np.where(ratio[idx] == 0, rest_ratios(*_without(rest, idx, label, unexplained)), x)
        data.append((idx[x != 0], x[x != 0], label, weight))
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(data)):
            idx, x, label, weight = data[k]
            p = 1 / (1 + np.exp(-np.clip(machine.margin(idx, x), -30, 30)))
            g = weight * (p - label)
            if abs(g) < 1e-4:
                continue
            vx = v[idx]
            dw = g * x + l2 * w[idx]
            dv = g * (x[:, None] * (x @ vx)[None, :] - vx * (x ** 2)[:, None]) + l2 * vx
            g0 += g * g
            gw[idx] += dw ** 2
            gv[idx] += dv ** 2
            machine.w0 -= rate * g / np.sqrt(g0)
            w[idx] -= rate * dw / np.sqrt(gw[idx])
            v[idx] -= rate * dv / np.sqrt(gv[idx])
    return machine


def _counts(rows: DataFrame, explained: np.ndarray | None = None) -> Counts:
    """Documents by term and class over all labelled rows; combined map side into at most ``BUCKETS`` rows.

    With ``explained``, a flag per term, documents that hold one of those terms are left out.
    """
    shared = None if explained is None else rows.sparkSession.sparkContext.broadcast(explained)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((BUCKETS + 1, 2), np.int64)
        for batch in batches:
            for packed, label in zip(batch["terms"], batch["label"]):
                idx = np.frombuffer(packed, "<i4")
                if shared is None or not shared.value[idx].any():
                    n[idx, label] += 1
                    n[BUCKETS, label] += 1
        used = np.flatnonzero(n.any(axis=1))
        yield pd.DataFrame({"bucket": used, "other": n[used, 0], "toxic": n[used, 1]})

    found = rows.select("terms", "label").mapInPandas(run, "bucket int, other long, toxic long").groupBy("bucket").agg(
        F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toPandas()
    n = np.zeros((2, BUCKETS + 1))
    n[:, found["bucket"]] = found[["other", "toxic"]].to_numpy().T
    return n[1, :BUCKETS], n[0, :BUCKETS], n[1, BUCKETS], n[0, BUCKETS]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "toxic", fit_rows: int = 16_384) -> Machine:
    """The machine learned from labelled rows of ``docs`` for which ``learn`` holds.

    A document labelled more than once is toxic if one label says so; null
    labels and labels of unknown documents count for nothing. With one class
    only, or no labels, every score is that class's share (no labels: 0).
    """
    known = columns(labels, id_column, label_column).toDF("id", "label").where("id is not null and label is not null")
    known = known.groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    texts = columns(docs.where(learn), id_column, text_column).toDF("id", "text")

    packed = map_texts(texts.where("id is not null"), "id", "text", {"terms": pa.binary()},
                       lambda batch: [[terms(t).tobytes() for t in batch]])
    # Labels grow with the documents, so they are never broadcast; terms are moved instead of texts.
    rows = written(packed.join(known.hint("merge"), "id").select(
        F.xxhash64("id").alias("key"), "label", "terms"), "labelled")
    toxic, other, n_toxic, n_other = _counts(rows)
    ratio = ratios(toxic, other, n_toxic, n_other)
    if not n_toxic or not n_other:
        prior = -30.0 if not n_toxic else 30.0
        return Machine(ratio, prior, np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS)))
    rest = _counts(rows, ratio > 0)
    ratio = np.where(ratio == 0, rest_ratios(*rest), ratio)
    prior = float(np.log(n_toxic / n_other))
    share = [min(1.0, fit_rows / 2 / n) for n in (n_other, n_toxic)]
    # Rows left out of a class are made up for by weight, whatever the size; the mean weight of the sample is 1.
    weight = [(share[0] * n_other + share[1] * n_toxic) / (n_other + n_toxic) / s for s in share]
    # A hash of the id picks the sample.
    unit = F.pmod(F.col("key"), F.lit(1 << 30)) / (1 << 30)
    picked = rows.where(unit < F.when(F.col("label") == 1, share[1]).otherwise(share[0])).withColumn(
        "shard", F.pmod(F.shiftrightunsigned("key", 32), F.lit(SHARDS)))
    seen = docs.sparkSession.sparkContext.broadcast([n.astype("f4") for n in (toxic, other, *rest[:2])])

    def shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "label"])
        data = [(np.frombuffer(t, "<i4"), y, weight[y]) for t, y in zip(group["terms"], group["label"])]
        m = train(data, *seen.value[:2], prior, (n_toxic, n_other), rest=(*seen.value[2:], *rest[2:]))
        w0, w, v = start(prior)
        used = np.flatnonzero((m.w != w) | (m.v != v).any(axis=1))
        change = np.column_stack([m.w[used] - w[used], m.v[used] - v[used]])
        return pd.DataFrame({"bucket": [-1, *used], "change": [[m.w0 - w0] + [0.0] * FACTORS, *change.tolist()]})

    parts = picked.groupBy("shard").applyInPandas(shard, "bucket int, change array<double>")
    sums = parts.groupBy("bucket").agg(
        *(F.sum(F.col("change")[i]).alias(f"c{i}") for i in range(FACTORS + 1)), F.count("*").alias("n")).toPandas()
    w0, w, v = start(prior)
    for row in sums.itertuples(index=False):
        # A shard that never met a term says nothing about it.
        change = np.array(row[1:FACTORS + 2]) / row[-1]
        if row[0] < 0:
            w0 += change[0]
        else:
            w[row[0]] += change[0]
            v[row[0]] += change[1:]
    return Machine(ratio, w0, w, v)


def score(docs: DataFrame, machine: Machine, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, score``: 0 to 1 per row; null and empty texts get the score of no terms. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    return map_texts(docs, id_column, text_column, {"score": pa.float64()},
                     lambda texts: [[shared.value.score(t) for t in texts]])


def keep_clean(docs: DataFrame, machine: Machine, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whole and in all columns, that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    return keep_texts(docs, text_column, lambda text: shared.value.score(text) < threshold)
