"""AUC over prefixes and over crowded scores, against plain counting."""

import random

import pytest
from pyspark.sql import functions as F

from clienttrace.operators import metrics


def _auc(rows):
    pos, neg = ([s for y, s in rows if s is not None and s == s and (y == 1) == one] for one in (True, False))
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


@pytest.mark.parametrize("every,n", [(1, 40), (7, 200), (50, 200), (1000, 150)])
def test_prefixes_against_pairs(spark, every, n):
    rng = random.Random(every)
    rows = [(g, i + 1, rng.randint(0, 1), rng.choice([None, float("nan"), 0.5, 0.25, round(rng.random(), 2), rng.random()]))
            for g in ("a", None) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, seq long, target int, score double").repartition(5)
    got = {(r["g"], r["n_rows"]): r for r in metrics.running_metric(df, every, group=["g"]).collect()}
    ends = sorted({min(k * every, n) for k in range(1, n // every + 2)})
    assert sorted(got, key=str) == sorted(((g, e) for g in ("a", None) for e in ends), key=str)
    for (g, e), r in got.items():
        own = [(y, s) for h, q, y, s in rows if h == g and q <= e]
        want = _auc(own)
        assert r["roc_auc"] is want is None or abs(r["roc_auc"] - want) < 1e-12
        ranked = [(y, s) for y, s in own if s is not None and s == s]
        right = sum((y == 1) == (s >= 0.5) for y, s in ranked)
        assert r["accuracy"] is None and not ranked or abs(r["accuracy"] - right / len(ranked)) < 1e-12


def test_no_rows(spark):
    assert metrics.running_metric(spark.createDataFrame([], "seq long, target int, score double"), 10).collect() == []


def test_crowded_scores_are_spread_and_exact(spark):
    """All scores within a millionth of each other still fall in many slices."""
    df = spark.range(4_000).select((F.rand(1) < 0.4).cast("int").alias("target"), (0.5 + F.rand(2) * 1e-6).alias("score")).cache()
    counts = df.groupBy("score").count()
    slices = metrics.with_slices(counts, "score").groupBy("_slice").count().collect()
    assert len(slices) > 50 and max(r["count"] for r in slices) < 200
    assert abs(metrics.roc_auc(df).first()[0] - _auc([(r["target"], r["score"]) for r in df.collect()])) < 1e-12
