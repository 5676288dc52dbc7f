import datetime as dt

from pyspark.sql import functions as F

from clienttrace.functions import answers as an
from clienttrace.functions import codes
from clienttrace.functions import scalars as sc
from clienttrace.functions import vectors as fv
from clienttrace.operators import aggregates, evidence, prompts


def column(spark, values, kind, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_times(spark):
    assert column(spark, ["12 03:04:05", "12", None, "x"], "string", sc.parse_day_time) == [
        12 + (3 * 3600 + 4 * 60 + 5) / 86400, 12.0, None, None]
    assert [tuple(r) for r in column(spark, ["12 03:04:05", "12"], "string", sc.parse_day_hour)] == [(12, 3), (12, 12)]
    assert column(spark, ["21OCT17:01:02:03", "junk"], "string", sc.parse_bank_ts) == [
        dt.datetime(2017, 10, 21, 1, 2, 3), None]
    assert column(spark, ["12 03:04:05", "12"], "string", sc.extract_hour) == [3, None]


def test_numbers(spark):
    assert column(spark, [0.5, 1.5, 2.5, 12345.5, 1234567.0], "double", sc.fmt0) == ["0", "2", "2", "12346", "1234567"]
    assert column(spark, [0.125, -0.25, 0.3], "double", sc.fmt_signed_pct) == ["+12%", "-25%", "+30%"]
    assert column(spark, ["1.5", "x", None], "string", sc.to_amount) == [1.5, 0.0, 0.0]
    assert column(spark, [-1.0, 0.0, 1.0], "double", sc.amount_direction) == ["spent", "received", "received"]
    assert column(spark, [0.5], "double", lambda c: sc.threshold_label(c)) == [1]
    assert column(spark, [0.5], "double", lambda c: sc.threshold_label(c, strict=True)) == [0]
    assert column(spark, [None, 3], "int", lambda c: sc.fill_category(c, 0)) == [0, 3]
    assert column(spark, [None, "a"], "string", sc.fill_category) == ["UNK", "a"]


def test_code_edges(spark):
    values = ["0", "1", "1499", "1500", "5599", "5600", "8299", "8300", "x", None]
    want = ["Other", "Agriculture", "Agriculture", "Construction", "Retail Stores", "Clothing Stores", "Education",
            "Other", "Other", "Other"]
    assert column(spark, values, "string", codes.classify_code) == want
    full = column(spark, values, "string", lambda c: codes.classify_code(c, codes.FULL, not_a_number="Unknown"))
    assert full[-3:] == ["Membership/Organizations", "Unknown", "Unknown"]
    ranges = spark.createDataFrame(list(codes.CANONICAL), "low int, high int, name string")
    looked = codes.range_lookup(spark.createDataFrame([(v,) for v in values], "code string"), "code", ranges, "m")
    assert sorted(r["m"] for r in looked.collect()) == sorted(want)


def pair(spark, rows, fn):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, r string")
    return [x[0] for x in df.orderBy("i").select(fn(F.col("c"), F.col("r"))).collect()]


def test_json_answers(spark):
    rows = [('{"label": "male", "confidence": 0.7}', None), ('{"label": "Female", "confidence": 1.7}', None),
            ('text {"label": "male"} more', None), ("", "so it is female"), ("", None), ('{"label": "male"}', None),
            ('{"label": "male", "confidence": "high"}', None), ('{"label": 1}', "male I guess")]
    got = pair(spark, rows, lambda c, r: F.round(an.parse_json_answer(c, r, "male", "female"), 6))
    assert got == [0.7, 0.05, 0.85, 0.15, 0.5, 0.85, 0.85, 0.85]
    got = pair(spark, [('so "label": "female"', None), ("female", None)],
               lambda c, r: F.round(an.parse_json_answer(c, r, "male", "female", "label"), 6))
    assert got == [0.15, 0.5]


def test_text_answers(spark):
    rows = [("87% churn", None), ("stay", None), ("churn or stay", None), ("churn x</think>stay", None), ("", None),
            ("99% stay or churn", None), ("40%", None)]
    got = pair(spark, rows, lambda c, r: F.round(an.parse_text_answer(c, "churn", "stay"), 6))
    assert got == [0.87, 0.15, 0.3, 0.15, 0.5, 0.95, 0.5]
    for legacy, want in ((False, 0.15), (True, 0.7)):
        assert pair(spark, [("female", None)], lambda c, r: F.round(
            an.parse_text_answer(c, "male", "female", legacy_substring=legacy), 6)) == [want]


def test_recovery(spark):
    rows = [(" ", "hm. Answer: male then female"), ("", "first female, and then " + "x" * 60), ("", "the male"),
            ("kept", "female"), ("", None), ("", "nothing")]
    got = pair(spark, rows, lambda c, r: an.recover_from_reasoning(c, r, "male", "female"))
    assert got == ["male", "female", "male", "kept", "", ""]
    assert pair(spark, rows[1:2], lambda c, r: an.recover_from_reasoning(c, r, "male", "female", False)) == [""]


def test_token_probability(spark):
    import math
    rows = [([(" Male", math.log(0.6)), ("fem", math.log(0.2)), ("x", -0.1)],), ([("", math.log(0.5))],),
            ([("male", math.log(0.001))],)]
    df = spark.createDataFrame(rows, "t array<struct<token string, logprob double>>")
    got = [r[0] for r in df.select(F.round(an.token_probability(F.col("t"), "male", "female"), 6)).collect()]
    assert got == [0.75, 1.0, None]


def test_class_answers(spark):
    values = ['{"label": 2}', 'so "label": 3 fits', "class 1 or 2", "none", "", '{"label": "1"}', "9 8"]
    assert column(spark, values, "string", an.parse_class_answer) == [2, 3, 2, -1, -1, 1, -1]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [0.5, 0.5])], "a array<double>, z array<double>, t array<double>")
    row = df.select(fv.l2_normalize(F.col("a")), fv.l2_normalize(F.col("z")), fv.cosine_similarity(F.col("a"), F.col("z")),
                    fv.argmax_class(F.col("t")), fv.softmax(F.col("t"))).first()
    assert [round(x, 9) for x in row[0]] == [0.6, 0.8] and row[1] == [0.0, 0.0] and row[2] == 0.0
    assert row[3] == 0 and [round(x, 9) for x in row[4]] == [0.5, 0.5]


def test_diversity_and_trend_edges(spark):
    e = spark.createDataFrame([(1, float(i), c, 10.0) for i, c in enumerate("aabbc")] + [(2, 0.0, "a", 5.0)],
                              "customer_id int, time double, category string, amount double")
    assert {tuple(r) for r in aggregates.category_diversity(e).collect()} == {(1, 3), (2, 1)}
    assert {tuple(r) for r in aggregates.category_diversity(e, mode="distinct_counts").collect()} == {(1, 2), (2, 1)}
    assert {(r["customer_id"], r["trend"]) for r in aggregates.half_trend(e).collect()} == {(1, "stable"), (2, "stable")}
    span = {r["customer_id"]: (r["days_span"], r["months"], r["per_month"]) for r in aggregates.activity_span(e).collect()}
    assert span == {1: (4, 1, 5), 2: (0, 1, 1)}
    exact = spark.createDataFrame([(1, 0.0, 10.0), (1, 1.0, 11.0)], "customer_id int, time double, amount double")
    assert aggregates.half_trend(exact).first()["trend"] == "stable"
    assert aggregates.half_trend(exact, "change").first()["trend"] is None


def test_votes(spark):
    near = spark.createDataFrame([(1, b) for b in range(10)] + [(2, b) for b in range(4, 14)], "query_id long, base_id long")
    labels = spark.createDataFrame([(b, int(b < 5 or b > 9)) for b in range(14)], "customer_id long, target int")
    got = {r["query_id"]: (r["pos"], r["majority"]) for r in evidence.knn_vote_binary(near, labels).collect()}
    assert got == {1: (5, 0), 2: (5, 0)}
    more = spark.createDataFrame([(1, b) for b in range(4)], "query_id long, base_id long")
    row = evidence.knn_vote_multiclass(more, spark.createDataFrame([(0, 2), (1, 1), (2, 1), (3, 2)],
                                                                   "customer_id long, target int"), 4, 4).first()
    assert row["counts"] == [0, 2, 2, 0] and row["top_class"] == 1 and row["share"] == 0.5


def test_demo_answers_are_json(spark):
    import json
    df = spark.createDataFrame([(1, 'a "quoted"\nprofile', "male")], "position int, profile string, label string")
    turns = prompts.demo_messages(df.withColumn("query_id", F.lit(7)), cot=True).first()["demos"]
    assert [t["role"] for t in turns] == ["user", "assistant"]
    assert json.loads(turns[1]["content"])["label"] == "male"
    text = df.select(prompts.demo_answer(F.col("label"), F.col("profile"))).first()[0]
    assert json.loads(text) == {"reasoning": 'a "quoted"\nprofile', "label": "male", "confidence": 0.9}
    full = prompts.with_demos(prompts.chat("s", "q"), F.lit(None).cast("array<struct<role:string,content:string>>"))
    assert [m["role"] for m in df.select(full.alias("m")).first()["m"]] == ["system", "user"]
