"""Attributions from covers against all coalitions, and what must hold of fitted models."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from clienttrace.operators import models, paths
from clienttrace.operators.boosting import Booster, Boosting


def _random_tree(rng, d, depth):
    nodes = ([], [], [], [], [])
    feature, threshold, left, right, value = nodes

    def add(level):
        at = len(feature)
        for part in nodes:
            part.append(0)
        feature[at], value[at] = -1, float(rng.normal())
        if level < depth and rng.random() < 0.85:
            feature[at], threshold[at] = int(rng.integers(d)), float(rng.normal())
            left[at] = add(level + 1)
            right[at] = add(level + 1)
        return at

    add(0)
    return paths.TreeNodes(*nodes)


def _value(t, x, known, node=0):
    """Walks the tree; a feature not known goes both ways by cover."""
    f = t.feature[node]
    if f < 0:
        return t.value[node]
    a, b = t.left[node], t.right[node]
    if f in known:
        return _value(t, x, known, a if x[f] <= t.threshold[node] else b)
    whole = t.cover[a] + t.cover[b]
    part = t.cover[a] / whole if whole else 0.5
    return part * _value(t, x, known, a) + (1 - part) * _value(t, x, known, b)


def _all_coalitions(trees, x, d):
    phi = np.zeros(d)
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        for size in range(d):
            weight = factorial(size) * factorial(d - size - 1) / factorial(d)
            for s in combinations(rest, size):
                phi[i] += weight * sum(_value(t, x, {*s, i}) - _value(t, x, set(s)) for t in trees)
    return phi


def test_equal_all_coalitions(spark):
    """Repeated features on a path, nodes that no row reached, nulls, infinities."""
    d, rng = 6, np.random.default_rng(3)
    trees = [_random_tree(rng, d, 7) for _ in range(4)]
    x = rng.normal(size=(40, d))
    x[0, 2], x[1, 0], x[2, 1] = np.nan, np.inf, -np.inf
    names = [f"f{i}" for i in range(d)]
    rows = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)],
                                 "customer_id long, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    covered = paths.with_covers(trees, rows, names)
    for t in covered:
        assert t.cover[0] == 40
        assert np.array_equal(t.cover, [np.count_nonzero([_reaches(t, r, node) for r in x]) for node in range(len(t.feature))])
    assert any((t.cover[1:] == 0).any() for t in covered)
    model = paths.paths(covered, 0.25)
    found = {r["customer_id"]: r for r in paths.path_attributions(model, rows, names).collect()}
    assert len(found) == 40
    for i in (0, 1, 2, 3, 4):
        r, given = found[i], np.where(np.isnan(x[i]), np.inf, x[i])
        want = _all_coalitions(covered, given, d)
        assert np.allclose([a["phi"] for a in r["attributions"]], want, atol=1e-10)
        assert abs(r["base_score"] - 0.25 - sum(_value(t, given, set()) for t in covered)) < 1e-10
        assert abs(r["score"] - 0.25 - sum(_value(t, given, set(range(d))) for t in covered)) < 1e-10
    assert found[0]["attributions"][2]["value"] is None and found[0]["attributions"][2]["feature"] == "f2"


def _reaches(t, x, wanted, node=0):
    if node == wanted:
        return True
    f = t.feature[node]
    return f >= 0 and _reaches(t, x, wanted, t.left[node] if x[f] <= t.threshold[node] else t.right[node])


def test_wide_models_and_odd_tables(spark):
    """64 features, paths longer than twelve; sums, repeated and no rows, no trees."""
    d, rng = 64, np.random.default_rng(5)
    names = [f"f{i}" for i in range(d)]
    chain = paths.TreeNodes([*range(20), *[-1] * 21], [0.3] * 20 + [0.0] * 21, [20 + i for i in range(20)] + [0] * 21,
                            [*range(1, 20), 40] + [0] * 21, [0.0] * 20 + list(rng.normal(size=21)))
    x = rng.normal(size=(30, d))
    schema = "customer_id string, " + ", ".join(f"{n} double" for n in names)
    rows = spark.createDataFrame([(f"c{i % 29}", *map(float, r)) for i, r in enumerate(x)], schema)
    model = paths.paths(paths.with_covers([chain, _random_tree(rng, d, 9)], rows, names))
    assert model.feature.shape[1] == 20
    found = paths.path_attributions(model, rows, names).collect()
    assert len(found) == 30 and {r["customer_id"] for r in found} == {f"c{i}" for i in range(29)}
    for r in found:
        assert abs(sum(a["phi"] for a in r["attributions"]) - (r["score"] - r["base_score"])) < 1e-9
    assert abs(np.mean([r["score"] for r in found]) - model.base()) < 1.0
    assert paths.path_attributions(model, rows.limit(0), names).collect() == []
    halves = paths.with_covers([chain], rows.limit(0), names)
    assert halves[0].cover.sum() == 0 and abs(paths.paths(halves).share.prod(axis=1).sum() - 1) < 1e-12
    none = paths.path_attributions(paths.paths([], 0.5), rows.limit(1), names).first()
    assert none["score"] == none["base_score"] == 0.5 and all(a["phi"] == 0 for a in none["attributions"])


def test_fitted_model(spark):
    """Scores are the model's log-odds; covers are sums of hessians."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 20))
    y = (x[:, 0] + x[:, 13] * x[:, 17] > 0).astype(int)
    names = [f"f{i}" for i in range(20)]
    rows = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))],
                                 "customer_id long, embedding array<double>, target int")
    model = Booster(Boosting(rounds=10, rate=0.3, depth=5, leaves=12)).fit(models.as_features(rows))
    wide = rows.select("customer_id", *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)])
    found = paths.path_attributions(model.paths(), wide, names).orderBy("customer_id").collect()
    assert np.allclose([r["score"] for r in found], model.scores(x, model.flat())[:, 0])
    phi = np.array([[a["phi"] for a in r["attributions"]] for r in found])
    assert np.allclose(phi.sum(axis=1), [r["score"] - r["base_score"] for r in found])
    assert set(np.abs(phi).mean(axis=0).argsort()[-3:]) == {0, 13, 17}


@pytest.mark.parametrize("p", [1, 2, 5, 13])
def test_rule_is_exact(p):
    """The integral equals the weights of all coalitions of a path of p features."""
    rng = np.random.default_rng(p)
    share = rng.random((1, p))
    model = paths.Paths(np.arange(p)[None], np.zeros((1, p)), np.full((1, p), np.inf), share, np.array([3.0]))
    x = rng.normal(size=(3, p))
    score, phi = paths.explain(model, x)
    for row, s, f in zip(x, score, phi):
        o = (row > 0).astype(float)
        assert s == 3.0 * o.prod()
        # Polynomials of the other features, one per feature: coefficient s counts coalitions of s.
        for i in range(p):
            poly = np.ones(1)
            for k in range(p):
                if k != i:
                    poly = np.convolve(poly, [share[0, k], o[k]])
            want = sum(c * factorial(n) * factorial(p - n - 1) / factorial(p) for n, c in enumerate(poly))
            assert abs(f[i] - 3.0 * (o[i] - share[0, i]) * want) < 1e-12
