"""Boosted trees: both ways of fitting, growth, scores and quality."""

import threading

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from clienttrace.operators import boosting, evidence, metrics, models
from clienttrace.operators.boosting import Booster, Boosting, Tree


def _rows(spark, n, classes, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    z = x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=n)
    y = np.digitize(z, np.quantile(z, np.arange(1, classes) / classes))
    return spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))],
                                 "customer_id long, embedding array<double>, target int")


@pytest.mark.parametrize("classes,parts", [(2, 1), (2, 7), (4, 3)])
def test_distributed_and_bounded_fits_agree(spark, classes, parts):
    rows = models.as_features(_rows(spark, 700, classes)).repartition(parts)
    p = Boosting(rounds=10, rate=0.2, depth=5, leaves=9, rows=0.7, columns=0.6, least_rows=8, alpha=0.3, penalty=1.0, bins=20)
    one = Booster(p, seed=3).fit(rows)
    two = boosting.fit_distributed(rows, p, seed=3, edges=[list(e) for e in one.edges])
    for a, b in zip(one.rounds, two.rounds, strict=True):
        for s, t in zip(a, b, strict=True):
            assert (s.feature, s.bin, s.left) == (t.feature, t.bin, t.left)
            assert len(s.feature) <= 17 and np.allclose(s.sums, t.sums) and np.allclose(s.values(p), t.values(p))
    assert len({len(t.feature) for r in one.rounds for t in r} - {1}) > 0


def test_leaf_wise_growth_takes_the_best_splits_first(spark):
    """With few leaves the splits are those with the highest gains that can be reached."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(400, 4)), rng.integers(0, 2, 400)
    y = np.where(x[:, 0] > 1, 1, y)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1])) for j in range(4)]
    bins = boosting.binned(x, edges)
    g, h = boosting.gradients(np.zeros((400, 1)), y)
    cuts = np.array([len(e) for e in edges])

    def grown(leaves):
        p = Boosting(rounds=1, rate=1, depth=8, leaves=leaves, least_rows=5, penalty=1.0)
        return boosting.grow(1, [np.arange(4)], cuts, p, lambda t, w: boosting.histograms(bins, g, h, t, w, 17))[0]

    # Plainly: one leaf after the other.
    p = Boosting(rounds=1, rate=1, depth=8, least_rows=5, penalty=1.0)
    plain = Tree()
    for leaves in range(1, 12):
        splits = sorted((f, b, int(s[2])) for f, b, s in zip(plain.feature, plain.bin, plain.sums) if f >= 0)
        made = grown(leaves)
        assert sorted((f, b, int(s[2])) for f, b, s in zip(made.feature, made.bin, made.sums) if f >= 0) == splits
        open_nodes = [n for n, f in enumerate(plain.feature) if f < 0]
        found = boosting.histograms(bins, g, h, [plain], [(0, n) for n in open_nodes], 17)
        for n, i in zip(open_nodes, range(len(open_nodes))):
            plain.sums[n] = found[:, i, 0].sum(axis=1)
        best = boosting.best_splits(found, cuts, p)
        top = max((i for i, b in enumerate(best) if b), key=lambda i: best[i][0])
        plain.best[open_nodes[top]] = best[top]
        plain.expand(open_nodes[top])


def test_scores_leaves_and_odd_rows(spark):
    rows = _rows(spark, 500, 2)
    odd = spark.createDataFrame([(900, [float("nan")] * 6, 1), (901, None, 1), (902, [0.0] * 6, None)], rows.schema)
    train = models.as_features(rows.unionByName(odd).withColumn("embedding", F.coalesce("embedding", F.array(*[F.lit(0.0)] * 6))))
    model = Booster(Boosting(rounds=12, rate=0.3, depth=4, leaves=7)).fit(train)
    x = np.vstack([np.random.default_rng(5).normal(size=(50, 6)), [[np.nan] * 6]])
    odds = model.scores(x, model.flat())[:, 0]
    leaves = model.leaves()
    assert np.allclose((leaves.masks(x) == 63) @ leaves.value, odds)
    scored = models.scored(model, train)
    assert scored.where("probs[0] + probs[1] between 0.999999999 and 1.000000001").count() == 503
    p = scored.where("customer_id < 10").orderBy("customer_id").select("embedding", "score").collect()
    assert np.allclose([r["score"] for r in p], 1 / (1 + np.exp(-model.scores(np.array([r["embedding"] for r in p]), model.flat())[:, 0])))
    explained = evidence.tree_attributions(leaves, rows.select("customer_id", *(F.col("embedding")[i].alias(f"f{i}") for i in range(6))).limit(20),
                                           rows.select("customer_id", *(F.col("embedding")[i].alias(f"f{i}") for i in range(6))), [f"f{i}" for i in range(6)])
    for r in explained.collect():
        assert abs(sum(a["phi"] for a in r["attributions"]) - (r["score"] - r["base_score"])) < 1e-9
    with pytest.raises(ValueError):
        Booster(Boosting(rounds=1, rate=1, depth=1)).fit(train.limit(0))


def test_bound_on_fit_rows_and_quality(spark):
    train, test = models.as_features(_rows(spark, 2_000, 4)), models.as_features(_rows(spark, 600, 4, seed=9))
    p = Boosting(rounds=60, rate=0.1, depth=6, leaves=20, rows=0.75, columns=0.75, least_rows=20, alpha=1.0, penalty=1.0)
    full = metrics.accuracy(models.scored(models.tree_estimator("multiclass").fit(train), test), target="label").first()[0]
    forest = models.fit_scaled(train, RandomForestClassifier(
        featuresCol="scaled", labelCol="label", numTrees=200, maxDepth=12, minInstancesPerNode=50, subsamplingRate=0.75,
        featureSubsetStrategy="0.75", seed=1))
    assert full >= metrics.accuracy(models.scored(forest, test), target="label").first()[0]
    small = Booster(p, fit_rows=300).fit(train)
    assert 200 < small.rounds[0][0].sums[0][2] / 0.75 < 400
    parts = Booster(p, fit_rows=300).fit_parts(train.withColumn("part", F.array(F.lit(0), F.lit(5))))
    assert set(parts) == {0, 5} and parts[0].rounds[3][1].feature == parts[5].rounds[3][1].feature == small.rounds[3][1].feature


def test_held_growth_sums_the_smaller_child_and_gives_the_plain_trees(monkeypatch):
    rng = np.random.default_rng(4)
    n, d = 20_000, 6
    x = rng.normal(size=(n, d))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) > 0).astype(int)
    edges = [np.quantile(x[:, j], np.arange(1, 32) / 32) for j in range(d)]
    p = Boosting(rounds=2, rate=0.3, depth=7, leaves=100, least_rows=10, alpha=0.5, penalty=1.0)
    summed, sums = [], boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda b, g, h, groups, w: summed.append(sum(map(len, groups))) or sums(b, g, h, groups, w))
    model = boosting._fitted(np.arange(n), y, x, edges, 2, p, 1)
    bins, cuts = boosting.binned(x, edges), np.full(d, 31)
    scores, rows = np.tile(model.prior, (n, 1)), 0
    for turn in model.rounds:
        g, h = boosting.gradients(scores, y)

        def plain(trees, wanted):
            nonlocal rows
            rows += int(np.isin(trees[0].place(bins), [node for _, node in wanted]).sum())
            return boosting.histograms(bins, g, h, trees, wanted, 32)
        tree = boosting.grow(1, [np.arange(d)], cuts, p, plain)[0]
        assert (tree.feature, tree.bin, tree.left) == (turn[0].feature, turn[0].bin, turn[0].left)
        assert np.allclose(tree.values(p), turn[0].values(p))
        scores[:, 0] += tree.values(p)[tree.place(bins)]
    assert sum(summed) < 0.8 * rows
    # More than 64 leaves, and rows at bounds, beyond them and without a value.
    assert max(t.feature.count(-1) for r in model.rounds for t in r) > 64
    odd = np.vstack([x[:500], [[e[3] for e in edges]], np.full((1, d), np.inf), np.full((1, d), -np.inf), np.full((1, d), np.nan)])
    want = sum(t.values(p)[t.place(boosting.binned(odd, edges))] for r in model.rounds for t in r) + model.prior[0]
    assert np.allclose(model.scores(odd, model.flat())[:, 0], want, atol=1e-12)


def test_vector_sets_and_models_are_fitted_at_the_same_time(spark, monkeypatch):
    """Each fit waits for the others: one after the other would never end."""
    met = threading.Barrier(3, timeout=20)
    table = spark.createDataFrame([("accuracy", 1.0)], "metric string, value double")

    def fit(*args, **kwargs):
        met.wait()
        return table
    monkeypatch.setattr(models, "evaluate_gbt", fit)
    monkeypatch.setattr(models, "evaluate_logreg", fit)
    rows = spark.createDataFrame([(1, [1.0], [2.0], 0)], "customer_id long, a array<double>, b array<double>, target int")
    assert [r["vectors"] for r in models.compare_vector_sets(rows, rows, "a", "b", "binary").collect()] == ["a", "b", "both"]
    assert models.evaluate_all(rows, rows, "binary").count() == 3


def test_masks_of_leaves_compare_a_row_once_per_bound():
    """Rows meet bounds, not leaves: as the plain comparison, at bounds, beyond them, without a value, and with a table made once."""
    rng = np.random.default_rng(8)
    cuts = np.sort(rng.normal(size=(7, 3)).round(1), axis=0)
    low, high = np.full((40, 3), -np.inf), np.full((40, 3), np.inf)
    for leaf in range(40):
        for j in range(3):
            a, b = sorted(rng.integers(0, 9, 2))
            low[leaf, j], high[leaf, j] = ([-np.inf, *cuts[:, j], np.inf][i] for i in (a, max(b, a + 1) if a < 8 else 8))
    low[0] = high[0] = np.inf
    leaves = evidence.Leaves(low, high, rng.normal(size=40))
    x = np.vstack([rng.normal(size=(50, 3)).round(1), cuts, np.full((1, 3), np.nan), np.full((1, 3), np.inf), np.full((1, 3), -np.inf)])
    z = np.where(np.isnan(x), np.inf, x)[:, None, :]
    plain = ((((z > low) | np.isneginf(low)) & (z <= high)) << np.arange(3)).sum(axis=2)
    tables = leaves.tables()
    assert [len(c) for c, _ in tables] == [len(np.unique(np.r_[low[:, j], high[:, j]][np.isfinite(np.r_[low[:, j], high[:, j]])])) for j in range(3)]
    assert (leaves.masks(x, tables) == plain).all() and (leaves.masks(x) == plain).all()


def test_quantiles_need_no_task_per_partition(spark):
    """Bounds are those of each feature and group by itself; the number of tasks that read does not grow with the partitions."""
    d, x = 37, np.random.default_rng(4).normal(size=(600, 37)).round(2)
    rows = spark.createDataFrame([(p, i % 3, [float(v) for v in r]) for i, r in enumerate(x) for p in (5, i % 2)],
                                 "part int, label int, x array<double>").repartition(100).cache()
    assert rows.count() == 1200
    spark.sparkContext.setJobGroup("quantiles", "")
    found = boosting.cut_points(rows, d, 8)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("quantiles") for s in tracker.getJobInfo(j).stageIds]
    tasks = [tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s).numCompletedTasks]
    spark.sparkContext.setJobGroup("others", "")
    assert tasks and max(tasks) <= max(boosting.SKETCHES, spark.sparkContext.defaultParallelism)
    shares = F.array(*[F.lit(i / 8) for i in range(1, 8)])
    for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.max("label").alias("top"), F.array(
            *[F.percentile_approx(F.col("x")[j], shares, 10_000) for j in range(d)]).alias("edges")).collect():
        assert found[r["part"]] == (r["n"], r["top"], r["edges"])
    assert len(found) == 3 and boosting.cut_points(rows, 0, 8)[5] == (600, 2, [])
    assert boosting.cut_points(rows, 7, 8) == {part: (n, top, edges[:7]) for part, (n, top, edges) in found.items()}


@pytest.mark.parametrize("classes", [2, 4])
def test_rows_dealt_over_tasks_give_the_trees_of_one_task(spark, monkeypatch, tmp_path, classes):
    """Nothing is drawn: more rows than a task holds are fitted on by several that run at the same time."""
    monkeypatch.setattr(boosting, "shared_folder", lambda spark, name: str(tmp_path / name))
    rows = models.as_features(_rows(spark, 5_000, classes))
    p = Boosting(rounds=12, rate=0.2, depth=6, leaves=20, rows=0.7, columns=0.6, least_rows=8, alpha=0.3, penalty=1.0, bins=20)
    one = Booster(p, seed=3).fit(rows)
    monkeypatch.setattr(boosting, "HELD", 1_000)
    monkeypatch.setattr(boosting, "LEAST_ROWS", 700)
    folds = rows.withColumn("part", F.when(F.col("customer_id") % 9 == 0, F.array(F.lit(0), F.lit(7))).otherwise(F.array(F.lit(0))))
    # The second part is small enough for one task; the first is not.
    found = Booster(p, seed=3).fit_parts(folds)
    assert set(found) == {0, 7} and len(found[0].rounds) == 12 and np.allclose(found[0].prior, one.prior)
    for a, b in zip(one.rounds, found[0].rounds, strict=True):
        for s, t in zip(a, b, strict=True):
            assert (s.feature, s.bin, s.left, s.depth) == (t.feature, t.bin, t.left, t.depth)
            assert np.allclose(s.sums, t.sums) and np.allclose(s.values(p), t.values(p))
    assert max(t.feature.count(-1) for t in one.rounds[3]) > 5
    # Of what the tasks told each other nothing is left.
    left = list((tmp_path / "sums").iterdir())
    assert len(left) == 8 and not any(f.stat().st_size for f in left)
    # Without tasks at the same time the same rows are fitted on by passes.
    monkeypatch.setattr(boosting, "_tasks_together", lambda *args: 0)
    passes = Booster(p, seed=3).fit(rows)
    assert [t.feature for r in passes.rounds for t in r] == [t.feature for r in one.rounds for t in r]


def test_all_rows_are_fitted_on(spark):
    """65,536 of them were drawn."""
    rows = spark.range(70_000).select(F.col("id").alias("customer_id"), F.array((F.col("id") % 7).cast("double"), F.rand(1)).alias(
        "embedding"), (F.col("id") % 7 > 2).cast("int").alias("target"))
    model = models.tree_estimator("binary", Boosting(rounds=3, rate=0.5, depth=2)).fit(models.as_features(rows))
    assert [r[0].sums[0][2] for r in model.rounds] == [70_000] * 3
    assert model.rounds[0][0].feature[0] == 0 and [s[2] for s in model.rounds[0][0].sums[1:3]] == [30_000, 40_000]


def test_trees_stay_in_the_shared_folder(spark):
    """A fit brings no tree to the driver; what is asked for comes as plain arrays, of all rounds."""
    rows = models.as_features(_rows(spark, 400, 3))
    found = Booster(Boosting(rounds=8, rate=0.2, depth=4, least_rows=5)).fit_parts(rows.withColumn("part", F.array(F.lit(0), F.lit(1))))
    assert [m.rounds._arrays for m in found.values()] == [None, None]
    rounds = list(found[1].rounds)
    nodes = sum(len(t.feature) for r in rounds for t in r)
    assert len(rounds) == 8 and {len(r) for r in rounds} == {3} and nodes > 50
    assert sum(a.nbytes for a in found[1].rounds._arrays.values()) <= 36 * nodes + 12 * 24
    packs = list(boosting._packs(iter(rounds)))
    again = list(boosting.Rounds(3, lambda: packs))
    assert [(t.feature, t.bin, t.left, t.depth, np.array(t.sums).tolist()) for r in again for t in r] == [
        (t.feature, t.bin, t.left, t.depth, np.array(t.sums).tolist()) for r in rounds for t in r]
    assert found[1].rounds[-1][2].feature == rounds[7][2].feature and len(found[1].rounds[2:4]) == 2
    with pytest.raises(IndexError):
        found[1].rounds[8]


@pytest.mark.parametrize("task", models.TASKS)
def test_no_operator_bounds_the_rows_of_a_fit(task):
    assert models.tree_estimator(task).fit_rows is None and models.tree_estimator(task, models.EXTREME, 7).fit_rows is None
