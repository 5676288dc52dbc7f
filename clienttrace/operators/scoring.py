"""Sending prompts to a user's scorer, cost and budget."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clienttrace.operators.ranks import hash_rank, running_total
from clienttrace.sources.results import resume_scoring

Scorer = Callable[[list[list[dict[str, str]]]], Sequence[str]]


class RateLimited(Exception):
    """Raised by a scorer to be called again after a pause."""


class CreditsExhausted(Exception):
    """Raised by a scorer when no further call can succeed."""


# Retry rule, and prices per million tokens (input, output).
ATTEMPTS = 3
WAIT_SECONDS = 5
UNKNOWN_PRICE = (1.0, 3.0)
PRICES: Mapping[str, tuple[float, float]] = {
    "qwen/qwen-2.5-7b-instruct": (0.10, 0.15),
    "google/gemma-4-26b-a4b-it:free": (0.0, 0.0),
    "z-ai/glm-4.7": (0.10, 0.30),
    "qwen/qwen3.6-plus": (0.10, 0.30),
    "deepseek/deepseek-v3.2-speciale": (0.30, 0.90),
}


def score_prompts(prompts: DataFrame, scorer: Scorer, keys: Sequence[str] = ("run_id", "customer_id"),
                  max_batch: int = 5, partitions: int | None = None, wait: float = WAIT_SECONDS) -> DataFrame:
    """``keys, response, status, attempts`` for each prompt.

    The scorer gets up to ``max_batch`` chats and returns as many raw answers.
    ``partitions`` bounds how many calls run at once. Status: ``ok``,
    ``failed`` (three attempts) or ``not_sent`` (credits ran out earlier in the
    same task). Write the result before using it: a recomputed plan would call
    the scorer again.
    """
    def call(chats: list) -> tuple[list, str, int]:
        for attempt in range(1, ATTEMPTS + 1):
            try:
                return list(scorer(chats)), "ok", attempt
            except CreditsExhausted:
                return [None] * len(chats), "exhausted", attempt
            except RateLimited:
                if attempt < ATTEMPTS:
                    time.sleep(wait * attempt)
            except Exception:  # noqa: BLE001 - any failure of user code is a failed row
                if attempt < ATTEMPTS:
                    time.sleep(wait * 0.4)
        return [None] * len(chats), "failed", ATTEMPTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = False
        for pdf in batches:
            answers, statuses, attempts = [], [], []
            for start in range(0, len(pdf), max_batch):
                part = pdf["_messages"].iloc[start:start + max_batch]
                if stopped:
                    got, status, tries = [None] * len(part), "not_sent", 0
                else:
                    got, status, tries = call([json.loads(m) for m in part])
                    if status == "exhausted":
                        stopped, status = True, "not_sent"
                answers += got
                statuses += [status] * len(part)
                attempts += [tries] * len(part)
            yield pdf[list(keys)].assign(response=answers, status=statuses, attempts=attempts)

    rows = prompts.select(*keys, F.to_json("messages").alias("_messages"))
    if partitions:
        rows = rows.repartition(partitions, *keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    return rows.mapInPandas(run, f"{fields}, response string, status string, attempts int")


def price_table(df: DataFrame, prices: Mapping[str, tuple[float, float]] = PRICES) -> DataFrame:
    return df.sparkSession.createDataFrame([(m, a, b) for m, (a, b) in prices.items()],
                                           "model string, price_in double, price_out double")


def call_cost(calls: DataFrame, prices: DataFrame | None = None, default_in: int = 500,
              default_out: int = 5) -> DataFrame:
    """Adds ``cost``; calls without usage are charged a fixed guess, unknown models a high price."""
    prices = price_table(calls) if prices is None else prices
    spent = (F.coalesce("prompt_tokens", F.lit(default_in)) * F.coalesce("price_in", F.lit(UNKNOWN_PRICE[0]))
             + F.coalesce("completion_tokens", F.lit(default_out)) * F.coalesce("price_out", F.lit(UNKNOWN_PRICE[1])))
    return (calls.join(prices, "model", "left").withColumn("cost", spent / 1_000_000)
            .drop("price_in", "price_out"))


def flat_cost(price_in: float = 0.20, price_out: float = 0.40, default_in: int = 500,
              default_out: int = 50) -> Column:
    """Cost of a call at one fixed price."""
    return (F.coalesce("prompt_tokens", F.lit(default_in)) * price_in
            + F.coalesce("completion_tokens", F.lit(default_out)) * price_out) / 1_000_000


def apply_budget(calls: DataFrame, cap: float, run: Sequence[str] = ("run_id",), seq: str = "seq") -> DataFrame:
    """Adds ``spent`` (running total of the run) and ``sent``.

    A call is sent while the total before it has not passed the cap.
    """
    spent = running_total(calls, run, seq, F.col("cost"), "spent")
    return spent.withColumn("sent", F.round(F.col("spent") - F.col("cost"), 9) <= cap)


def usage_summary(calls: DataFrame, group: Sequence[str] = ("run_id",), started: str | None = None) -> DataFrame:
    """Total spend and calls; with a call-time column (seconds) also calls per second."""
    stats = [F.sum("cost").alias("total_cost"), F.count(F.lit(1)).alias("calls")]
    if started:
        elapsed = F.greatest(F.max(started) - F.min(started), F.lit(0.1))
        stats.append((F.count(F.lit(1)) / elapsed).alias("calls_per_second"))
    return calls.groupBy(*group).agg(*stats)


def committed(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """The answers of all waves that a store's manifest lists; none where there is no store yet."""
    try:
        waves = [r["wave"] for r in spark.read.schema("wave string").json(f"{store}/manifest").distinct().collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        waves = []
    if not waves:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{store}/{w}" for w in waves))


def score_in_waves(prompts: DataFrame, scorer: Scorer, store: str, run: str = "run_id", key: str = "customer_id",
                   keep: Sequence[str] = (), cap: float = float("inf"), wave_calls: int = 100_000,
                   prices: DataFrame | None = None, **calling: object) -> DataFrame:
    """Scores prompts (``run, key, model, messages``) wave by wave into a store, within a budget per run.

    A wave is at most ``wave_calls`` open prompts of every run, in the order of a
    hash. Its answers are written to a folder of their own in ``store``, which
    all executors must reach; then its name is added to the manifest, and only
    that commits it. What is committed is never sent again, whether in this run,
    after a restart, or when an executor was lost; calls of a wave that did not
    get so far are repeated. Between waves the spending is summed, and a run that
    has passed ``cap`` sends no more. Prompts that were not sent because credits
    ran out stay open. Returns all committed answers: ``run, key, model, keep...,
    response, status, attempts`` with ``prompt_tokens, completion_tokens, cost``.
    """
    spark, keys = prompts.sparkSession, [run, key, "model", *keep]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.select(*keys).schema.fields)
    schema = f"{fields}, response string, status string, attempts int"

    def paid(done: DataFrame) -> DataFrame:
        tokens = {n: F.get_json_object("response", f"$.usage.{n}").cast("int") for n in ("prompt_tokens", "completion_tokens")}
        return call_cost(done.where("status != 'not_sent'").withColumns(tokens), prices)

    while True:
        done = paid(committed(spark, store, schema))
        over = usage_summary(done, [run]).where(F.col("total_cost") > cap).select(run)
        todo = resume_scoring(prompts, done, [run, key]).join(over, run, "left_anti")
        wave = hash_rank(todo, [run], key, 0, "_place", "_open").where(F.col("_place") <= wave_calls).drop("_place", "_open")
        name = f"wave-{uuid.uuid4().hex}"
        score_prompts(wave, scorer, keys, **calling).write.parquet(f"{store}/{name}")
        made = spark.read.schema(schema).parquet(f"{store}/{name}").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") != "not_sent").alias("sent")).first()
        if made["rows"]:
            spark.createDataFrame([(name,)], "wave string").write.mode("append").json(f"{store}/manifest")
        if not made["sent"]:
            return paid(committed(spark, store, schema))
