import gzip

import pytest
from pyspark.sql import functions as F

from clienttrace.functions.scalars import parse_bank_ts, parse_day_time
from clienttrace.operators import events as ev
from clienttrace.operators import scoring
from clienttrace.operators.vectors import embed_texts
from clienttrace.sources import events as src
from clienttrace.sources import results as res


def test_read_gzip_csv(spark, tmp_path):
    path = str(tmp_path / "transactions.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write("amount,customer_id,tr_datetime,mcc_code,tr_type\n-5.5,1,3 10:00:00,5411,7\n2,2,4,,\n")
    events = src.read_events(spark, path, src.GENDER_SPEC, src.GENDER_EVENTS,
                             {"time": parse_day_time(F.col("tr_datetime"))})
    got = {r["customer_id"]: r for r in events.collect()}
    assert got[1]["amount"] == -5.5 and abs(got[1]["time"] - 3.4166667) < 1e-6 and got[1]["code"] == 5411
    assert got[2]["code"] is None and got[2]["time"] == 4.0


def test_optional_columns_and_labels(spark, tmp_path):
    path = str(tmp_path / "churn.csv")
    with open(path, "w") as f:
        f.write("cl_id,MCC,TRDATETIME,channel_type,currency,amount,target_flag,trx_category\n"
                "7,5411,21OCT17:01:02:03,a,810,10.5,0,POS\n7,6011,22OCT17:00:00:00,b,810,3,1,ATM\n")
    events = src.read_events(spark, path, src.CHURN_SPEC, src.CHURN_EVENTS,
                             {"time": parse_bank_ts(F.col("TRDATETIME"))})
    assert events.count() == 2 and "category" in events.columns
    raw = src.read_table(spark, path, src.CHURN_EVENTS)
    assert "PERIOD" not in raw.columns
    assert ev.labels_from_flags(raw, "target_flag", "cl_id").first()["target"] == 1
    assert src.read_labels(spark, path, "cl_id", "target_flag", src.CHURN_EVENTS).count() == 2


def test_missing_input_is_named(spark, tmp_path):
    with pytest.raises(src.MissingInput, match="made by: the loader"):
        src.require_inputs(spark, {str(tmp_path / "none"): "the loader"})
    there = str(tmp_path / "t")
    spark.range(3).write.parquet(there)
    src.require_inputs(spark, {there: "x"}, {there: ["id"]})
    with pytest.raises(src.MissingInput, match="lacks column"):
        src.require_inputs(spark, {there: "x"}, {there: ["other"]})


def test_embeddings_round_trip_is_pruned(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0], "train"), (2, 1, [3.0, 4.0], "test")],
                                 "customer_id long, target int, embedding array<double>, split string")
    res.write_embeddings(rows, path, "gender")
    res.write_embeddings(rows, path, "gender", seed=7)
    back = res.read_embeddings(spark, path, "gender", 42, "test")
    assert [(r["customer_id"], r["embedding"]) for r in back.collect()] == [(2, [3.0, 4.0])]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan


def test_predictions_metrics_and_records(spark, tmp_path):
    preds = spark.createDataFrame([(1, 0, 0.25, 0, 9)], "customer_id long, target int, pred_prob double, pred_label int, x int")
    res.write_predictions(preds, str(tmp_path / "p"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).columns == [
        "customer_id", "target", "pred_prob", "pred_label"]
    res.write_metrics(preds, str(tmp_path / "m"), "json")
    assert spark.read.json(str(tmp_path / "m")).count() == 1
    table = spark.createDataFrame([({"auc": 0.7},)], "metrics map<string,double>")
    fields = {n: F.lit(n) for n in ("experiment_id", "method", "dataset")}
    record = res.result_record(table, "binary", "RQ1", fields, {"k": 10}, {"preds": "p"}, notes="n")
    res.write_result(record, str(tmp_path / "r"))
    saved = spark.read.json(str(tmp_path / "r")).first()
    assert saved["metrics"]["auc"] == 0.7 and saved["config"]["k"] == "10" and saved["rq"] == "RQ1"
    for bad in (("ranking", "RQ1", table), ("binary", "RQ9", table),
                ("binary", "RQ1", spark.createDataFrame([({},)], "metrics map<string,double>"))):
        with pytest.raises(Exception, match="must"):
            res.result_record(bad[2], bad[0], bad[1], fields).collect()


def test_resume_and_alignment(spark):
    todo = spark.createDataFrame([(1, i) for i in range(5)], "run_id int, customer_id int")
    done = todo.where("customer_id in (1, 3)")
    assert {r["customer_id"] for r in res.resume_scoring(todo, done).collect()} == {0, 2, 4}
    assert ev.align_by_id(todo, todo.withColumn("v", F.lit(1)).drop("run_id")).count() == 5
    with pytest.raises(Exception, match="missing customer_id: "):
        ev.align_by_id(todo, done.drop("run_id")).collect()
    with pytest.raises(Exception, match="missing customer_id: "):
        ev.align_by_id(todo, done.drop("run_id")).count()
    assert ev.align_by_id(todo, done.drop("run_id"), require_complete=False).count() == 2


def chats(spark, n):
    return spark.range(n).selectExpr("'r' as run_id", "id as customer_id",
                                     "array(named_struct('role', 'user', 'content', cast(id as string))) as messages")


def test_scorer_batches_retries_and_stops(spark):
    def steady(batch):
        assert 1 <= len(batch) <= 5
        return [m[-1]["content"] for m in batch]
    got = scoring.score_prompts(chats(spark, 23), steady, partitions=3).collect()
    assert len(got) == 23 and all(r["response"] == str(r["customer_id"]) and r["attempts"] == 1 for r in got)

    calls = []

    def limited(batch):
        calls.append(1)
        if len(calls) % 3:
            raise scoring.RateLimited()
        return ["ok"] * len(batch)
    got = scoring.score_prompts(chats(spark, 4).coalesce(1), limited, wait=0).collect()
    assert {(r["status"], r["attempts"]) for r in got} == {("ok", 3)}

    def broken(batch):
        raise RuntimeError("no")
    assert {r["status"] for r in scoring.score_prompts(chats(spark, 4), broken, wait=0).collect()} == {"failed"}

    def runs_out(batch):
        if any(m[-1]["content"] == "7" for m in batch):
            raise scoring.CreditsExhausted()
        return ["ok"] * len(batch)
    got = scoring.score_prompts(chats(spark, 20).coalesce(1), runs_out).collect()
    assert [r["status"] for r in sorted(got, key=lambda r: r["customer_id"])] == ["ok"] * 5 + ["not_sent"] * 15


def test_budget(spark):
    calls = spark.range(10).selectExpr("'r' as run_id", "id as seq", "'nobody' as model", "100000 as prompt_tokens",
                                       "cast(null as int) as completion_tokens")
    costs = scoring.call_cost(calls)
    assert abs(costs.first()["cost"] - 0.100015) < 1e-9
    sent = scoring.apply_budget(costs, 0.35).orderBy("seq").collect()
    # The call that crosses the cap is still sent, none after it.
    assert [r["sent"] for r in sent] == [True] * 4 + [False] * 6
    assert scoring.usage_summary(costs).first()["calls"] == 10


def test_embed_texts_with_user_function(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "customer_id long, text string")
    got = embed_texts(df, embed_fn=lambda texts: [[len(t), 1] for t in texts]).collect()
    assert {r["customer_id"]: r["embedding"] for r in got} == {1: [2.0, 1.0], 2: [3.0, 1.0]}
