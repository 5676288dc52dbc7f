"""Attributions of tree models with any number of features (L9), from the covers of their nodes.

A feature left out of a coalition goes both ways at its splits, in the shares
of the rows that did (the cover). A leaf then is a game of the features on its
own path only: its value counts by a factor per feature, 1 or 0 for a known
feature inside or outside the leaf's range, the product of its shares for an
unknown one. With ``o`` and ``z`` for the two, the Shapley value of feature i is

    value * (o_i - z_i) * integral over t in [0, 1] of prod_{k != i} (z_k (1 - t) + o_k t)

a polynomial in t, which a Gauss rule of half as many points as the path has
features integrates exactly. There are no coalitions to enumerate and no
background to hold: a row costs leaves x path length x points, whatever the
number of features. Only leaves reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers a task holds per array while it explains a slice of its rows.
CELLS = 1 << 20


@dataclass
class TreeNodes:
    """One tree, root first: ``feature`` is -1 in leaves; rows with ``x <= threshold`` go left, others and NaN right."""

    feature: Sequence[int]
    threshold: Sequence[float]
    left: Sequence[int]
    right: Sequence[int]
    value: Sequence[float]
    cover: Sequence[float] | None = None

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row; children follow their parents."""
        at = np.zeros(len(x), np.int64)
        for node, f in enumerate(self.feature):
            if f >= 0:
                here = np.flatnonzero(at == node)
                at[here] = np.where(x[here, f] <= self.threshold[node], self.left[node], self.right[node])
        return at

    def with_leaf_covers(self, leaf_rows: np.ndarray) -> TreeNodes:
        cover = np.array(leaf_rows, float)
        for node in range(len(self.feature) - 1, -1, -1):
            if self.feature[node] >= 0:
                cover[node] = cover[self.left[node]] + cover[self.right[node]]
        return TreeNodes(self.feature, self.threshold, self.left, self.right, self.value, cover)


@dataclass
class Paths:
    """Per leaf its path: features (-1 pads), the range (low, high] of each, its share when unknown; and the value."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray
    start: float = 0.0

    def base(self) -> float:
        return self.start + float(self.share.prod(axis=1) @ self.value)


def paths(trees: Sequence[TreeNodes], start: float = 0.0) -> Paths:
    """All leaves of trees with covers. Below a node that no row reached, both ways count half."""
    found: list[tuple[dict[int, tuple[float, float, float]], float]] = []
    for t in trees:
        todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while todo:
            node, way = todo.pop()
            f = t.feature[node]
            if f < 0:
                found.append((way, t.value[node]))
                continue
            low, high, share = way.get(f, (-np.inf, np.inf, 1.0))
            cut, whole = t.threshold[node], t.cover[t.left[node]] + t.cover[t.right[node]]
            part = t.cover[t.left[node]] / whole if whole else 0.5
            todo.append((t.left[node], way | {f: (low, min(high, cut), share * part)}))
            todo.append((t.right[node], way | {f: (max(low, cut), high, share * (1 - part))}))
    shape = (len(found), max([1, *(len(way) for way, _ in found)]))
    out = Paths(np.full(shape, -1), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape),
                np.array([v for _, v in found], float), start)
    for i, (way, _) in enumerate(found):
        for j, (f, (low, high, share)) in enumerate(way.items()):
            out.feature[i, j], out.low[i, j], out.high[i, j], out.share[i, j] = f, low, high, share
    return out


def explain(model: Paths, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and attributions (rows x features) of a few rows."""
    n, (leaves, p) = len(x), model.feature.shape
    points, weights = np.polynomial.legendre.leggauss((p + 1) // 2)
    points, weights = (points + 1) / 2, weights / 2
    known = np.where(np.isnan(x), np.inf, x)[:, model.feature]
    # NaN goes right, so it is inside every range without an upper end; -inf is inside those without a lower one.
    inside = ((known > model.low) | np.isneginf(model.low)) & (known <= model.high) | (model.feature < 0)
    o, z = inside.astype(float), np.broadcast_to(model.share, inside.shape)
    others = np.zeros(inside.shape)
    for t, weight in zip(points, weights):
        factor = z * (1 - t) + o * t
        before, after = np.ones(inside.shape), np.ones(inside.shape)
        before[..., 1:] = np.cumprod(factor[..., :-1], axis=2)
        after[..., :-1] = np.cumprod(factor[..., :0:-1], axis=2)[..., ::-1]
        others += weight * before * after
    phi = (o - z) * others * model.value[:, None]
    out = np.zeros((n, x.shape[1]))
    used = model.feature >= 0
    np.add.at(out, (slice(None), model.feature[used]), phi[:, used])
    return model.start + inside.all(axis=2) @ model.value, out


def _numbers(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    return df.select(*keep, F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features]).alias("_x"))


def _matrix(values: pd.Series, d: int) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float) if len(values) else np.zeros((0, d))


def with_covers(trees: Sequence[TreeNodes], background: DataFrame, features: Sequence[str]) -> list[TreeNodes]:
    """The trees with the number of background rows in every node; counted in one pass, map side, per leaf."""
    width, d = max((len(t.feature) for t in trees), default=1), len(features)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(trees), width), np.int64)
        for pdf in batches:
            x = _matrix(pdf["_x"], d)
            for i, t in enumerate(trees):
                seen[i] += np.bincount(t.place(x), minlength=width)
        tree, node = np.nonzero(seen)
        yield pd.DataFrame({"tree": tree, "node": node, "n": seen[tree, node]})

    rows = np.zeros((len(trees), width))
    for r in (_numbers(background, features).mapInPandas(count, "tree int, node int, n long")
              .groupBy("tree", "node").agg(F.sum("n").alias("n")).collect()):
        rows[r["tree"], r["node"]] = r["n"]
    return [t.with_leaf_covers(rows[i, :len(t.feature)]) for i, t in enumerate(trees)]


def path_attributions(model: Paths, rows: DataFrame, features: Sequence[str], key: str = "customer_id") -> DataFrame:
    """``key, score, base_score, attributions`` per row: Shapley values that add up to score minus base.

    Rows stay where they are. A null or NaN feature goes right at every split, as in scoring; repeated rows
    come out as often as they went in; no rows give none.
    """
    d, base = len(features), model.base()
    # The leaves are shared once instead of travelling with every task.
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        step = max(1, CELLS // max(1, model.feature.size))
        for pdf in batches:
            x = _matrix(pdf["_x"], d)
            parts = [explain(model, x[i:i + step]) for i in range(0, len(x), step)]
            if parts:
                yield pdf.assign(score=np.concatenate([s for s, _ in parts]), base_score=base,
                                 _phi=list(np.concatenate([phi for _, phi in parts])))

    given = _numbers(rows, features, key)
    found = given.mapInPandas(run, f"{key} {given.schema[key].dataType.simpleString()}, _x array<double>, "
                                   "score double, base_score double, _phi array<double>")
    items = [F.struct(F.lit(f).alias("feature"), F.nanvl(F.col("_x")[j], F.lit(None)).alias("value"),
                      F.col("_phi")[j].alias("phi")) for j, f in enumerate(features)]
    return found.select(key, "score", "base_score", F.array(*items).alias("attributions"))
