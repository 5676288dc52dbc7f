"""Learned client vectors against dense linear algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clienttrace.operators import embedding, sequences, vectors


def _events(spark, clients=60, n=40):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(clients):
        at = rng.integers(0, 8)
        for t in range(int(rng.integers(1, n))):
            at = (at + rng.integers(0, 3)) % 8 if rng.random() < 0.8 else rng.integers(0, 8)
            rows.append((c, t, None if rng.random() < 0.02 else f"kind{at}", None if rng.random() < 0.02 else float(rng.integers(0, 20))))
    return spark.createDataFrame(rows, "customer_id long, time int, category string, amount double")


def _table(df):
    return {r["customer_id"]: np.array(r["embedding"]) for r in df.collect()}


@pytest.fixture(scope="module")
def records(spark):
    return sequences.build_sequences(_events(spark), ["category", "amount"]).cache()


def test_vectors_are_the_leading_eigenvectors(records):
    pairs = embedding.token_pairs(records, "category", "amount")
    matrix = {(r["a"], r["b"]): r["w"] for r in embedding.mutual_information(pairs).collect()}
    names = sorted({a for a, _ in matrix})
    dense = np.array([[matrix.get((a, b), 0.0) for b in names] for a in names])
    assert np.allclose(dense, dense.T) and len(names) > 20
    size, axes = np.linalg.eigh(dense)
    lead = np.argsort(-np.abs(size))[:3]
    found = {r["token"]: r["vector"] for r in embedding.token_vectors(embedding.mutual_information(pairs), 6, passes=12).collect()}
    got = np.array([found[n] for n in names])
    for k, i in enumerate(lead):
        want = axes[:, i] * np.sqrt(abs(size[i]))
        assert min(np.abs(got[:, k] - want).max(), np.abs(got[:, k] + want).max()) < 1e-2
    whole = embedding.token_vectors(embedding.mutual_information(pairs), 64).collect()
    assert all(len(r["vector"]) == 64 and np.isfinite(r["vector"]).all() for r in whole)
    full = np.array([{r["token"]: r["vector"] for r in whole}[n] for n in names])
    assert np.allclose(full @ full.T, axes @ np.diag(np.abs(size)) @ axes.T, atol=1e-6)


def test_partitions_and_chunks_change_nothing(spark, records):
    want = _table(vectors.embed_sequences(records, "category", "amount", 8))
    cut = sequences.build_sequences(_events(spark).repartition(7), ["category", "amount"], chunk_events=6)
    got = _table(vectors.embed_sequences(cut.repartition(5), "category", "amount", 8))
    assert want.keys() == got.keys() == set(range(60))
    assert max(np.abs(want[c] - got[c]).max() for c in want) < 1e-4


def test_one_token_and_no_records(spark):
    one = spark.createDataFrame([(1, ["x", "x"], [1.0, 1.0]), (2, ["x"], [1.0]), (3, [], [])],
                                "customer_id long, category array<string>, amount array<double>")
    got = _table(vectors.embed_sequences(one, "category", "amount", 4))
    assert got == {} or all(np.isfinite(v).all() for v in got.values())
    assert vectors.embed_sequences(one.limit(0), "category", "amount", 4).collect() == []
