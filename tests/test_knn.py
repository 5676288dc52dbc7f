import numpy as np
import pytest

from clienttrace.operators import knn, metrics, prompts

SCHEMA = "customer_id long, embedding array<float>, target int"


def points(n, seed, copies=0, zeros=0, classes=3, dim=6):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)) + rng.integers(0, 4, size=(n, 1)) * 3
    if copies:
        m[:copies] = m[0]  # a third of the base may be one vector
    if zeros:
        m[-zeros:] = 0
    m = m.astype(np.float32)
    return [(i, m[i].tolist(), int(i % classes)) for i in range(n)]


def brute(query, base, k, per_class):
    def unit(rows):
        m = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)
    q, b = unit(query), unit(base)
    d = np.round(1 - q @ b.T, 9) + 0.0
    out = set()
    for i, row in enumerate(query):
        for c in sorted({r[2] for r in base}) if per_class else [None]:
            own = [j for j, r in enumerate(base) if c is None or r[2] == c]
            best = sorted(own, key=lambda j: (d[i, j], base[j][0]))[:k]
            out |= {(row[0], base[j][0], p + 1) for p, j in enumerate(best)}
    return out


@pytest.mark.parametrize("per_class", [None, "target"])
@pytest.mark.parametrize("pivots", [1, 7])
def test_exact_with_copies_zeros_and_small_blocks(spark, monkeypatch, per_class, pivots):
    monkeypatch.setattr(knn, "BASE_BLOCK", 25)
    monkeypatch.setattr(knn, "QUERY_GROUP", 10)
    base, query = points(180, 1, copies=60, zeros=4), points(35, 2, zeros=2)
    query = [(r[0] + 1000, r[1], r[2]) for r in query]
    found = knn.knn_join(spark.createDataFrame(query, SCHEMA), spark.createDataFrame(base, SCHEMA), 4,
                         per_class=per_class, pivots=pivots)
    got = {(r["query_id"], r["base_id"], r["place"]) for r in found.collect()}
    assert got == brute(query, base, 4, per_class)


def test_pruning_leaves_cells_out(spark):
    """Clustered vectors: far fewer than all cells are visited a second time."""
    rng = np.random.default_rng(3)
    centres = np.eye(8) * 10
    rows = [(i, (centres[i % 8] + rng.normal(size=8) * 0.1).astype(np.float32).tolist(), 0) for i in range(400)]
    base = spark.createDataFrame(rows, SCHEMA)
    vectors = base.selectExpr("customer_id as base_id", "0 as label", "cast(embedding as array<double>) as vector")
    chosen = knn._choose_pivots(vectors, "vector", "base_id", 24)
    cells = knn._cells(knn._assign(vectors, chosen), chosen)
    query = vectors.selectExpr("base_id as query_id", "vector",
                               "array(named_struct('label', 0, 'chord', 0.05D)) as bounds")
    visits = knn._second_visits(query, cells, 3).count()
    assert visits < 400 * len(cells.label) / 3


@pytest.mark.parametrize("noise", [0.0, 1e-6, 2e-5])
def test_near_copies_are_equal_for_every_pivot_count(spark, noise):
    """Distances that round to the same number must not rule out a smaller id."""
    rng = np.random.default_rng(9)
    rows = [(i, (np.ones(8) + noise * rng.normal(size=8)).astype(np.float32).tolist(), 0) for i in range(200)]
    query = [(1000 + i, r[1], 0) for i, r in enumerate(rows[::7])]
    found = [{(r["query_id"], r["base_id"], r["place"]) for r in knn.knn_join(
        spark.createDataFrame(query, SCHEMA), spark.createDataFrame(rows, SCHEMA), 5, pivots=p).collect()} for p in (1, 20)]
    assert found[0] == found[1]


def test_fewer_base_vectors_than_k(spark):
    base, query = points(3, 1), points(2, 2)
    found = knn.knn_join(spark.createDataFrame(query, SCHEMA), spark.createDataFrame(base, SCHEMA), 10, pivots=2)
    assert found.count() == 6


def test_small_base_needs_no_pivots(spark):
    base, query = points(60, 4, zeros=2), points(9, 5, zeros=1)
    found = knn.knn_join(spark.createDataFrame(query, SCHEMA), spark.createDataFrame(base, SCHEMA), 5)
    assert {(r["query_id"], r["base_id"], r["place"]) for r in found.collect()} == brute(query, base, 5, None)
    with pytest.raises(ValueError, match="no vectors"):
        knn.knn_join(spark.createDataFrame(query, SCHEMA), spark.createDataFrame([], SCHEMA), 5)


@pytest.mark.parametrize("pivots", [1, 5])
def test_text_ids(spark, pivots):
    rows = [(f"c{i}", r[1], 0) for i, r in enumerate(points(40, 6))]
    df = spark.createDataFrame(rows, "customer_id string, embedding array<float>, target int")
    found = knn.knn_join(df, df, 1, pivots=pivots).collect()
    assert len(found) == 40 and all(r["query_id"] == r["base_id"] for r in found)


def test_unusable_vectors_and_classes_take_no_part(spark):
    fine = [(i, [float(i % 7) + 1, 1.0, float(i % 3)], i % 2) for i in range(40)]
    odd = [(100, None, 0), (101, [1.0, None, 0.0], 1), (102, [float("nan"), 1.0, 0.0], 0), (103, [float("inf"), 1.0, 0.0], 1),
           (104, [], 0), (None, [1.0, 1.0, 1.0], 0)]
    schema = "customer_id long, embedding array<double>, target int"
    plain, mixed = spark.createDataFrame(fine, schema), spark.createDataFrame(fine + odd, schema).repartition(4)
    for pivots in (1, 4):
        want, got = (sorted(map(tuple, knn.knn_join(d, d, 3, pivots=pivots).collect())) for d in (plain, mixed))
        assert got == want and len(want) == 120
    unlabelled = mixed.unionByName(spark.createDataFrame([(200, [1.0, 1.0, 1.0], None)], schema))
    per_class = knn.knn_join_per_class(unlabelled, unlabelled, 2).collect()
    assert {r["base_id"] for r in per_class} <= set(range(40)) and {r["query_id"] for r in per_class} == {*range(40), 200}


def test_nearest_demos(spark):
    base = spark.createDataFrame([(i, i % 2, [1.0, i / 10]) for i in range(20)] + [(90, 1, None), (91, None, [1.0, 0.0])],
                                 "customer_id long, target int, embedding array<double>")
    asked = spark.createDataFrame([(100, [1.0, 0.05]), (101, [1.0, 1.9]), (102, None)], "customer_id long, embedding array<double>")
    got = knn.nearest_demos(asked, base, 2).collect()
    found = {q: sorted(r["customer_id"] for r in got if r["query_id"] == q) for q in (100, 101)}
    assert found == {100: [0, 1, 2, 3], 101: [16, 17, 18, 19]} and len(got) == 8
    assert all(sorted(r["position"] for r in got if r["query_id"] == q) == [1, 2, 3, 4] for q in found)
    assert all(r["target"] == r["customer_id"] % 2 for r in got)


def test_sizes_held_by_one_task_are_checked(spark):
    rows = spark.range(metrics.MAX_BATCH + 1).selectExpr("id AS customer_id", "0L AS batch_id", "array(1D) AS a", "array(1D) AS b")
    with pytest.raises(Exception, match="assign_batches"):
        metrics.infonce(rows, "a", "b").collect()
    many = spark.range(prompts.MAX_EXAMPLES + 1).selectExpr("id AS position", "'p' AS profile", "'l' AS label")
    with pytest.raises(Exception, match="examples for one block"):
        prompts.few_shot_block(many).collect()
    assert prompts.few_shot_block(many.where("position < 1")).first()["block"] == "Example 0:\np\nAnswer: l\n\n"


def test_distances_of_few_queries_are_held_at_a_time(monkeypatch):
    """A block meets its queries in slices of bounded size; ties go to the smaller id, few base rows give all they have."""
    rng = np.random.default_rng(3)
    base, queries = rng.normal(size=(300, 5)), rng.normal(size=(70, 5))
    base[100:200] = base[:100]
    base[250:] = base[0]
    sizes, nearest = [], knn._nearest

    def watched(q, unit, k, first):
        sizes.append(len(q) * len(unit))
        return nearest(q, unit, k, first)
    monkeypatch.setattr(knn, "COMPARED", 2_000)
    unit, asked = knn._unit(base, 1), knn._unit(queries, 0)
    step = max(1, knn.COMPARED // len(unit))
    for k in (1, 7, 500):
        found = [watched(asked[s:s + step], unit, k, s) for s in range(0, 70, step)]
        at, near, distance = (np.concatenate(c) for c in zip(*found))
        d = np.round(1.0 - asked @ unit.T, 9) + 0.0
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        assert (at == np.repeat(np.arange(70), order.shape[1])).all() and (near == order.ravel()).all()
        assert np.allclose(distance, np.take_along_axis(d, order, axis=1).ravel(), atol=1e-12)
    assert max(sizes) <= 2_000
