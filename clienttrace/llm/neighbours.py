"""Approximate nearest neighbours by vantage-point trees, one per shard.

Vectors are made unit vectors, so the Euclidean distance is a metric with the
order of the cosine. Every shard (rows by hash of the id) is a task's vantage
point tree: a node keeps its vantage point and, for the near and the far half,
the range of their distances to it. A half is passed over if

    gap * factor > distance of the k-th best found so far

where ``gap`` is how far outside the half's range the query's own distance lies.
By the triangle inequality ``factor`` one rules out only what cannot be nearer:
the search is exact. Larger factors prune more.

Queries are a stated set against all rows: they are cut into blocks, and each
block meets each shard in one group of bounded size. Per query and shard ``k + 2``
rows leave it (the two more for ties in rounded distances), of which the best ``k`` remain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clienttrace.llm.common import columns, written

SHARD_ROWS = 20_000
QUERY_BLOCK = 32_768
LEAF = 256
FACTOR = 3.0
#: For rounding of distances.
ROOM = 3e-6


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tree:
    """A vantage-point tree over unit vectors; nodes lie in lists, leaves are slices of one order."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF):
        self.unit, self.order = unit, np.arange(len(unit))
        self.nodes: list[tuple] = []
        rng = np.random.default_rng(5)
        todo = [(0, len(unit), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][5][side] = me
            if hi - lo <= leaf:
                self.nodes.append((lo, hi, None, None, None, None))
                continue
            point = self._point(lo, hi, rng)
            d = self._distances(self.unit[self.order[lo:hi]], point[None, :])[:, 0]
            by = np.argsort(d, kind="stable")
            self.order[lo:hi] = self.order[lo:hi][by]
            d, mid = d[by], (hi - lo) // 2
            # Cut by rank: equal vectors never make a node that cannot be cut.
            self.nodes.append((lo, hi, point, (d[0], d[mid - 1]), (d[mid], d[-1]), [0, 0]))
            todo += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 1)]

    def _point(self, lo: int, hi: int, rng) -> np.ndarray:
        """Of a few vectors, the one whose distances to a few others differ most."""
        some = self.unit[self.order[rng.integers(lo, hi, 8)]]
        others = self.unit[self.order[rng.integers(lo, hi, 64)]]
        return some[int(np.argmax((some @ others.T).std(axis=1)))]

    def _distances(self, queries: np.ndarray, points: np.ndarray) -> np.ndarray:
        # Rounded, so that equal vectors are equally far whatever the shape of the product.
        return np.sqrt(np.maximum(2 - 2 * np.round(queries @ points.T, 12), 0))

    def _gaps(self, queries: np.ndarray, node: tuple) -> list[np.ndarray]:
        d = self._distances(queries, node[2][None, :])[:, 0]
        return [np.maximum(np.maximum(r[0] - d, d - r[1]), 0) - ROOM for r in node[3:5]]

    def _leaf(self, queries, who, own, node, best, rows) -> None:
        at = self.order[node[0]:node[1]]
        d = self._distances(queries[who], self.unit[at])
        d[at[None, :] == own[who, None]] = np.inf
        better = d.min(axis=1) <= best[who, -1]
        who, d = who[better], d[better]
        every = np.concatenate([best[who], d], axis=1)
        which = np.concatenate([rows[who], np.broadcast_to(at, d.shape)], axis=1)
        # Rows of a shard are in the order of their ids, so that ties go to the smaller.
        take = np.lexsort((which, every), axis=1)[:, :best.shape[1]]
        best[who] = np.take_along_axis(every, take, 1)
        rows[who] = np.where(np.isfinite(best[who]), np.take_along_axis(which, take, 1), -1)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the ``k`` nearest per query; -1 where there are fewer. ``own`` rows are left out.

        First every query goes down to the leaf it lies nearest to, which gives
        a distance to prune with; then all queries that reach a node are handled together.
        """
        def empty():
            return np.full((len(queries), k), np.inf), np.full((len(queries), k), -1)

        best, rows = empty()
        todo = [(0, np.arange(len(queries)))]
        while todo:
            at, who = todo.pop()
            node = self.nodes[at]
            if node[2] is None:
                self._leaf(queries, who, own, node, best, rows)
                continue
            gaps = self._gaps(queries[who], node)
            inner = gaps[0] <= gaps[1]
            todo += [(half, who[group]) for half, group in zip(node[5], (inner, ~inner)) if group.any()]
        limit = best[:, -1]
        best, rows = empty()
        todo = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            at, who, gap = todo.pop()
            who = who[gap * factor <= np.minimum(limit[who], best[who, -1])]
            node = self.nodes[at]
            if not len(who):
                continue
            if node[2] is None:
                self._leaf(queries, who, own, node, best, rows)
            else:
                todo += [(half, who, g) for half, g in zip(node[5], self._gaps(queries[who], node))]
        return rows, best


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, v``: rows whose vector is not null, empty or zero and has finite numbers only."""
    rows = columns(vectors, id_column, vector_column).toDF("id", "v").where("id is not null and v is not null")
    rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 5, factor: float = FACTOR, id_column: str = "vec_id",
            vector_column: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` largest cosines found for each row where ``is_query`` holds.

    Every row but the query's own is a candidate; scores are cosines of the
    original vectors in double precision, ties go to the smaller id. Null and
    zero vectors and those with null or non-finite numbers take no part, nor do
    null ids; of rows with one id that with the largest vector counts. Vectors
    of another length than the most are no candidates of each other: each length is
    searched for itself. Fewer candidates give fewer rows, an empty table none.
    """
    rows = usable(vectors, id_column, vector_column).withColumn("size", F.size("v"))
    # Arrays of one id compare by their numbers, so repeated ids give the same row in every run.
    rows = written(rows.groupBy("id").agg(F.max(F.struct("size", "v")).alias("m")).select("id", "m.size", "m.v"), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    asked = rows.where(is_query(F.col("id")))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    base = rows.select("id", "size", "v", shard, each(blocks, "block"))
    spread = asked.select("id", "size", "v", block, each(shards, "shard"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["id"][:0], "id": left["id"][:0], "score": []})
        left = left.sort_values("id")
        ids, who = left["id"].to_numpy(), right["id"].to_numpy()
        x, q = np.array(left["v"].tolist()), np.array(right["v"].tolist())
        place = {i: r for r, i in enumerate(ids)}
        own = np.array([place.get(i, -2) for i in who])
        found, _ = Tree(_unit(x)).search(_unit(q), own, k + 2, factor)
        a, slot = np.nonzero(found >= 0)
        b = found[a, slot]
        lengths = np.sqrt((q ** 2).sum(axis=1))[a] * np.sqrt((x ** 2).sum(axis=1))[b]
        return pd.DataFrame({"query_id": who[a], "id": ids[b], "score": (q[a] * x[b]).sum(axis=1) / lengths})

    by = ["size", "shard", "block"]
    found = base.groupBy(*by).cogroup(spread.groupBy(*by)).applyInPandas(
        search, f"query_id {kind}, id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_column), "score")
