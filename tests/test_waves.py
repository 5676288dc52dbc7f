"""Scoring in committed waves: nothing is sent twice, runs stop at the cap."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from clienttrace.operators import scoring


def _scorer(folder, broken_after=None):
    def score(chats):
        sent = sum(int(f.split("-")[0]) for f in os.listdir(folder))
        if broken_after is not None and sent >= broken_after:
            raise scoring.CreditsExhausted
        open(os.path.join(folder, f"{len(chats)}-{uuid.uuid4().hex}"), "w").close()
        return [json.dumps({"choices": [], "usage": {"prompt_tokens": 1_000, "completion_tokens": 0}}) for _ in chats]
    return score


def _sent(folder):
    return sum(int(f.split("-")[0]) for f in os.listdir(folder))


@pytest.fixture
def prompts(spark):
    return spark.range(60).select(
        F.col("id").alias("customer_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("run_id"), F.lit("m").alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))).alias("messages"))


def test_second_run_sends_nothing(spark, tmp_path, prompts):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    done = scoring.score_in_waves(prompts, _scorer(str(calls)), store, wave_calls=25)
    assert done.count() == done.select("run_id", "customer_id").distinct().count() == 120 and _sent(calls) == 120
    # A wave without an entry in the manifest does not count.
    prompts.limit(3).select("run_id", "customer_id", "model").write.parquet(f"{store}/wave-lost")
    again = scoring.score_in_waves(prompts, _scorer(str(calls)), store, wave_calls=25)
    assert _sent(calls) == 120 and sorted(map(str, again.collect())) == sorted(map(str, done.collect()))


def test_run_stops_at_the_cap(spark, tmp_path, prompts):
    calls = tmp_path / "calls"
    calls.mkdir()
    prices = spark.createDataFrame([("m", 1000.0, 0.0)], "model string, price_in double, price_out double")
    few = prompts.where("run_id = 'a' or customer_id < 5")
    done = scoring.score_in_waves(few, _scorer(str(calls)), str(tmp_path / "store"), cap=17.5, wave_calls=10, prices=prices)
    spent = {r["run_id"]: r["total_cost"] for r in scoring.usage_summary(done).collect()}
    assert spent == {"a": 20.0, "b": 5.0} and _sent(calls) == 25


def test_unsent_prompts_stay_open(spark, tmp_path, prompts):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    first = scoring.score_in_waves(prompts, _scorer(str(calls), broken_after=40), store, partitions=1, wave_calls=15)
    sent = _sent(calls)
    assert first.count() == sent < 120
    rest = scoring.score_in_waves(prompts, _scorer(str(calls)), store)
    assert rest.count() == _sent(calls) == 120


def test_no_prompts(spark, tmp_path, prompts):
    assert scoring.score_in_waves(prompts.limit(0), _scorer(str(tmp_path)), str(tmp_path / "store")).count() == 0
