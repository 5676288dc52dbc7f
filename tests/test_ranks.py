"""Ranks, medians and what is made of them, however rows lie and however large a group is."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from clienttrace.operators import aggregates, profiles, ranks, sequences

random.seed(5)
START = dt.datetime(2024, 1, 1)
# Client 1 holds most rows, with many equal times.
ROWS = [(1 if random.random() < 0.7 else random.randint(2, 9), START + dt.timedelta(minutes=random.randint(0, 900) * 7),
         round(random.uniform(-900, 900), 2), random.choice("abcd"), i) for i in range(600)]


def events(spark):
    return (spark.createDataFrame(ROWS, "customer_id long, time timestamp_ntz, amount double, category string, id long")
            .withColumn("tie", F.struct("id")))


def test_order_and_median_of_hot_clients(spark):
    for parts in (1, 7):
        e = events(spark).repartition(parts)
        ranked = sequences.order_events(e).collect()
        for c in {r["customer_id"] for r in ranked}:
            own = sorted((r for r in ranked if r["customer_id"] == c), key=lambda r: r["event_no"])
            assert [r["event_no"] for r in own] == list(range(1, len(own) + 1))
            assert {r["n_events"] for r in own} == {len(own)}
            assert [(r["time"], r["id"]) for r in own] == sorted((r["time"], r["id"]) for r in own)
        medians = {r[0]: r[1] for r in ranks.exact_median(e, ["customer_id"], F.abs("amount")).collect()}
        for c, value in medians.items():
            assert abs(value - statistics.median(abs(r[2]) for r in ROWS if r[0] == c)) < 1e-9


def test_ordered_rank_over_any_partitions(spark):
    """Null groups, groups over many partitions, equal rows, small batches."""
    rows = [(None if i % 11 == 0 else "a" if i < 1500 else f"k{i % 40}", i % 3, i * 37 % 500) for i in range(2_000)]
    df = spark.createDataFrame(rows, "k string, j int, v long")
    for batch, parts in ((4096, 8), (16, 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = ranks.ordered_rank(df, ["k", "j"], [F.col("v")], "r", "n").collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4096)
            spark.conf.set("spark.sql.shuffle.partitions", 8)
        groups = {}
        for k, j, v in rows:
            groups.setdefault((k, j), []).append(v)
        want = sorted((str(k), j, v, r, len(g)) for (k, j), g in groups.items() for r, v in enumerate(sorted(g), 1))
        assert sorted((str(r["k"]), r["j"], r["v"], r["r"], r["n"]) for r in got) == want


def test_profiles_do_not_depend_on_partitions(spark):
    for make in (profiles.client_profile, profiles.churn_profile, profiles.rich_profile, aggregates.half_trend):
        plain, split = (sorted(map(str, make(events(spark).repartition(n)).select("customer_id", name).collect()))
                        for n in (1, 9) for name in ["trend" if make is aggregates.half_trend else "profile"])
        assert len(plain) == 9 and plain == split


def test_long_histories_continue_in_chunks(spark):
    e = events(spark)
    whole = {r["customer_id"]: r["amount"] for r in sequences.build_sequences(e, ["amount"]).collect()}
    chunks = sequences.build_sequences(e, ["amount"], chunk_events=50).orderBy("customer_id", "chunk")
    joined, times = {}, {}
    for r in chunks.collect():
        assert len(r["amount"]) == len(r["event_time"]) <= 50
        joined.setdefault(r["customer_id"], []).extend(r["amount"])
        times.setdefault(r["customer_id"], []).extend(r["event_time"])
    assert joined == whole
    assert all(t[0] == 0 and t == sorted(t) for t in times.values())


def test_bucketed_rank_and_running_total(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g"), F.lit(1.5).alias("v"))
    ranked = ranks.hash_rank(df, ["g"], "id", 3).collect()
    for g in (0, 1):
        assert sorted(r["rank"] for r in ranked if r["g"] == g) == list(range(1, 251))
    order = sorted((r for r in ranked if r["g"] == 0), key=lambda r: r["rank"])
    hashes = spark.createDataFrame([(r["id"], i) for i, r in enumerate(order)], "id long, i int").orderBy("i").select(
        ranks.hash_order(F.col("id"), 3)).collect()
    assert [h[0] for h in hashes] == sorted(h[0] for h in hashes)
    totals = ranks.running_total(df, ["g"], "id", F.col("v"), "t", block=7).orderBy("g", "id").collect()
    assert [r["t"] for r in totals] == [1.5 * (i + 1) for i in range(250)] * 2


def test_empty_input(spark):
    e = events(spark).where("false")
    assert sequences.order_events(e).count() == 0
    assert profiles.client_profile(e).count() == 0


def test_null_groups_are_kept(spark):
    from clienttrace.operators import aggregates, metrics, profiles, sampling

    rows = spark.createDataFrame([(i, None if i < 3 else i % 2) for i in range(10)], "customer_id long, target int")
    assert sampling.stratified_split(rows).count() == 10
    assert sampling.stratified_kfold(rows).count() == 10
    assert sampling.sample_n(rows, 4).count() == 4
    preds = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.1), (None, 1, 0.2), (None, 0, 0.1), (None, 1, float("nan"))],
                                  "model string, target int, score double")
    assert {(r["model"], r["roc_auc"]) for r in metrics.roc_auc(preds, ["model"]).collect()} == {("m", 1.0), (None, 1.0)}
    tx = spark.sql("""SELECT * FROM VALUES (1L, timestamp'2024-01-01', 5.0D, 'a'), (1L, timestamp'2024-01-02', 7.0D, null),
        (2L, timestamp'2024-01-01', null, 'a') AS t(customer_id, time, amount, category)""")
    assert aggregates.client_features(tx).count() == 2
    assert profiles.client_profile(tx).count() == 2
    history = {r["customer_id"]: r["history"] for r in profiles.history_text(tx).collect()}
    assert history[1].count("\n") == 2 and "Other" in history[1]


def test_chunks_of_a_history_are_one_client(spark):
    from clienttrace.operators import sequences, vectors

    e = spark.sql("""SELECT id % 3 AS customer_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, int(id)) AS time,
        id AS tie, id * 1.0D AS amount, concat('c', id % 4) AS category FROM range(90)""")

    def made(chunk_events):
        records = sequences.build_sequences(e, ["amount", "category"], chunk_events=chunk_events)
        slices = sequences.sample_slices(records, ["amount"], cnt_min=5, cnt_max=25)
        learned = vectors.embed_sequences(records, "category", "amount", dim=4)
        return ({tuple(r) for r in slices.selectExpr("customer_id", "slice_no", "slice_start", "array_join(amount, ',')").collect()},
                learned.count())
    whole, cut = made(1_000_000), made(20)
    assert whole == cut and len(whole[0]) == 15 and whole[1] == 3
