"""Language of a text by sparse multinomial logistic regression on TF-IDF of character n-grams.

Letters in lower case, everything else a blank, n-grams of one to three signs,
hashed to ``BUCKETS``. Document frequencies are counted over all learning rows,
combined map side. The weights come from follow-the-regularised-leader with
elastic-net penalties over a documented sample (at most about
``fit_rows_per_language`` rows of each language): ``SHARDS`` tasks learn one
shard each from the same start and their weights are averaged. A temperature,
chosen by the likelihood of sampled rows that took no part in the fit, turns
margins into probabilities.

The driver receives bucket counts, weights and a grid of likelihoods, all
bounded by ``BUCKETS`` times the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clienttrace.llm.common import columns, written

BUCKETS = 1 << 15
SHARDS = 4
EPOCHS = 2
#: Up to so many languages their shares are sent to the texts; beyond, both are shuffled.
BROADCAST_LANGUAGES = 10_000
UNKNOWN = "und"
TEMPERATURES = np.geomspace(0.02, 5.0, 56)
#: Code points counted at a time, so that a very long text needs little memory.
SLICE = 1 << 20

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """The lower-case letter of each code point, a blank for what is no letter; made once per worker."""
    if not _letters:
        lower = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                small = chr(c).lower()
                lower[c] = ord(small) if len(small) == 1 else c
        _letters.append(lower)
    return _letters[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of a whole text's n-grams; ``None`` without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.zeros(BUCKETS, np.int64)
    table, letters = _letter_table(), False
    # Slices overlap by two signs; n-grams are counted by the slice they start in.
    for start in range(0, len(codes), SLICE):
        c = table[np.minimum(codes[start:start + SLICE + 2], 0x10FFFF)]
        own = min(SLICE, len(codes) - start)
        letters = letters or bool((c[:own] != 32).any())
        a, b, d = c[:own], c[1:own + 1], c[2:own + 2]
        two = a[:len(b)] * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
        three = two[:len(d)] * np.uint32(0xC2B2AE3D) + d * np.uint32(0x27D4EB2F)
        for h, blank in ((a * np.uint32(0x165667B1), a == 32), (two, (a[:len(b)] == 32) & (b == 32)),
                         (three, (b[:len(d)] == 32) & ((a[:len(d)] == 32) | (d == 32)))):
            counts += np.bincount(((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(17))[~blank],
                                  minlength=BUCKETS)
    if not letters:
        return None
    used = np.flatnonzero(counts)
    return used, counts[used]


class Model:
    """Languages in order, the weight of each rarity, weights by bucket and language, temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float = 1.0):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def values(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        idx, counts = found
        x = (1 + np.log(counts)) * self.idf[idx]
        return idx, x / max(float(np.sqrt(x @ x)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text) if self.langs else None
        if found is None:
            return UNKNOWN, 0.0
        idx, x = self.values(found)
        p = softmax(x @ self.weights[idx] / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS,
                  alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> np.ndarray:
    """Weights by bucket and class; weights the penalty does not let out of zero stay exactly zero."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(at) -> np.ndarray:
        away = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, away / ((beta + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            idx, x, label = rows[k]
            w = weights(idx)
            p = softmax(x @ w)
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            old = n[idx]
            new = old + g * g
            z[idx] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[idx] = new
    return weights(slice(None))


def _frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                found = grams(text)
                if found:
                    df[found[0]] += 1
                    n += 1
        used = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": [-1, *used], "n": [n, *df[used]]})

    found = rows.select("text").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1)
    df[found["bucket"]] = found["n"]  # -1 is the last place
    return df[:BUCKETS], int(df[BUCKETS])


def fit(docs: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text",
        lang_column: str = "lang", fit_rows_per_language: int = 2_000) -> Model:
    """The model learned from rows of ``docs`` for which ``learn`` holds, with a text and a language.

    Without such rows there is no language, and every text is ``und``. The
    languages are a vocabulary: a list of them is held by the driver and the tasks.
    """
    rows = columns(docs.where(learn), id_column, text_column, lang_column).toDF("id", "text", "lang").where(
        "text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)))
    df, n = _frequencies(rows)
    model = Model(langs, np.log((1 + n) / (1 + df)) + 1, np.zeros((BUCKETS, len(langs))))
    # A hash of the id and the language's share pick the sample; a fifth of it is kept for the temperature.
    share = docs.sparkSession.createDataFrame(
        [(lang, i, min(1.0, fit_rows_per_language / sizes[lang])) for i, lang in enumerate(langs)],
        "lang string, label int, share double")
    if len(langs) <= BROADCAST_LANGUAGES:
        share = F.broadcast(share)
    key = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.col("text")))
    picked = rows.withColumn("key", key).join(share, "lang").where(
        F.pmod("key", F.lit(1 << 30)) / (1 << 30) < F.col("share")).select(
        "key", "text", "label", F.pmod(F.shiftrightunsigned("key", 32), F.lit(SHARDS + SHARDS // 4)).alias("shard"))
    picked = written(picked, "sample")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def shard(group: pd.DataFrame) -> pd.DataFrame:
        group, m = group.sort_values(["key", "label"]), shared.value
        found = [(grams(t), y) for t, y in zip(group["text"], group["label"])]
        w = follow_leader([(*m.values(g), y) for g, y in found if g], len(m.langs))
        bucket, label = np.nonzero(w)
        return pd.DataFrame({"bucket": bucket, "label": label, "w": w[bucket, label]})

    parts = picked.where(F.col("shard") < SHARDS).groupBy("shard").applyInPandas(
        shard, "bucket int, label int, w double")
    found = parts.groupBy("bucket", "label").agg((F.sum("w") / SHARDS).alias("w")).toPandas()
    model.weights[found["bucket"], found["label"]] = found["w"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, loss = shared.value, np.zeros(len(TEMPERATURES))
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                found = grams(text)
                if found:
                    idx, x = m.values(found)
                    z = (x @ m.weights[idx])[None, :] / TEMPERATURES[:, None]
                    top = z.max(axis=1)
                    loss += np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[:, label]
        yield pd.DataFrame({"t": range(len(loss)), "loss": loss})

    held = picked.where(F.col("shard") >= SHARDS).select("text", "label").mapInPandas(losses, "t int, loss double")
    ranked = held.groupBy("t").agg(F.sum("loss").alias("loss")).toPandas().sort_values(["loss", "t"])
    if len(ranked) and ranked["loss"].iloc[0] > 0:
        model.temperature = float(TEMPERATURES[ranked["t"].iloc[0]])
    return model


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, lang_pred, score`` per row; a null text or one without a letter is ``und`` with score 0.

    Of languages that are equally likely the first by name is taken. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    rows = columns(docs, id_column, text_column).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)


def keep_known(docs: DataFrame, model: Model, text_column: str = "text", least_score: float = 0.3) -> DataFrame:
    """The rows of ``docs``, whole and in all columns, in a known language with at least ``least_score``.

    Without any language learned all rows that have a letter stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(text: str | None) -> bool:
        m = shared.value
        if not m.langs:
            return grams(text) is not None
        lang, score = m.predict(text)
        return lang != UNKNOWN and score >= least_score

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[known(t) for t in batch[text_column]]]

    return docs.mapInPandas(run, docs.schema)
