"""Exact nearest neighbours by cosine distance.

Vectors on the unit sphere are ordered the same way by chord length as by
cosine, and chord length is a metric, so the triangle inequality can rule out
whole cells of base vectors (a pivot-based kNN join):

1. Base vectors go to their nearest pivot; a cell keeps its size and radius.
2. Every query is compared with its own cell first. That gives a distance its
   k-th neighbour cannot exceed.
3. It then visits just those other cells that can hold something closer. No
   candidate is dropped otherwise, so the result is exact.

Cells are cut into blocks of bounded size and queries into groups of bounded
size; one task compares one block with one group as a matrix product and emits
only the best ``k`` per query. A cell with a third of all vectors is many
blocks, and pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from clienttrace.operators.ranks import hash_order
from clienttrace.operators.vectors import max_abs_scale
from clienttrace.session import written

BASE_BLOCK = 20_000   # base vectors compared in one task
QUERY_GROUP = 8_192   # queries compared in one task
COMPARED = 1 << 20    # distances held at a time
VISIT_ROWS = 10_000   # visit rows, each with its vector, made at a time
MAX_PIVOTS = 512      # pivots are sent to every task: at most 512 vectors
_DIGITS = 9           # distances are rounded so copies of a vector tie exactly
_ROUNDED = 10.0 ** -_DIGITS  # a rounded distance may be this much too small (half of it by rounding)
_SLACK = 1e-7         # room for float arithmetic when a cell is ruled out


def _matrix(rows: pa.Table) -> np.ndarray:
    """The vectors of a table as they lie in its buffers, with no object per row."""
    return rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def _unit(column: pd.Series | np.ndarray, side: int) -> np.ndarray:
    """Unit rows with two extra coordinates.

    A zero vector has distance 1 to everything: on each side it becomes an
    extra axis of its own, at right angles to all else.
    """
    m = column if isinstance(column, np.ndarray) else np.stack(column.to_numpy()).astype(np.float64, copy=False)
    norm = np.linalg.norm(m, axis=1)
    zero = norm == 0
    m = m / np.where(zero, 1.0, norm)[:, None]
    extra = np.zeros((len(m), 2))
    extra[zero, side] = 1.0
    return np.hstack([m, extra])


def _chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _nearest(queries: np.ndarray, unit: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries (counted from ``first``) and of their ``k`` nearest base rows, and the distances; ties in base order."""
    d = queries @ unit.T
    np.subtract(1.0, d, out=d)
    np.round(d, _DIGITS, out=d)
    d += 0.0
    k = min(k, d.shape[1])
    bound = np.partition(d, k - 1, axis=1)[:, k - 1]
    at, near = np.nonzero(d <= bound[:, None])
    found = d[at, near]
    order = np.lexsort((near, found, at))
    # Sorted by query: the number in the query is the place less the query's first.
    inside = np.arange(len(at)) - np.searchsorted(at, np.arange(len(d)))[at[order]]
    order = order[inside < k]
    return at[order] + first, near[order], found[order]


@dataclass
class _Cells:
    """Pivots and per-cell facts, at most pivots x classes entries."""

    pivots: np.ndarray
    number: dict[tuple[int, int], int]  # (class number, pivot) -> cell
    label: np.ndarray
    pivot: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray


def _choose_pivots(base: DataFrame, vector: str, key: str, count: int) -> np.ndarray:
    sample = base.orderBy(hash_order(F.col(key), 7), key).limit(count).select(vector).toPandas()
    return _unit(sample[vector], 1)


def _assign(base: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Base rows with their nearest pivot and distance to it."""
    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _chord(_unit(pdf["vector"], 1), pivots)
                pivot = d.argmin(axis=1)
                yield pdf.assign(pivot=pivot.astype("int32"), to_pivot=d[np.arange(len(d)), pivot])
    return base.mapInPandas(nearest, f"base_id {_kind(base, 'base_id')}, label int, vector array<double>, pivot int, "
                                     "to_pivot double")


def _cells(assigned: DataFrame, pivots: np.ndarray) -> _Cells:
    facts = (assigned.groupBy("label", "pivot")
             .agg(F.count(F.lit(1)).alias("rows"), F.max("to_pivot").alias("radius"))
             .orderBy("label", "pivot").toPandas())
    rows = facts["rows"].to_numpy()
    keys = zip(facts["label"].tolist(), facts["pivot"].tolist())
    return _Cells(pivots, {k: i for i, k in enumerate(keys)}, facts["label"].to_numpy(), facts["pivot"].to_numpy(),
                  rows, facts["radius"].to_numpy(), -(-rows // BASE_BLOCK))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _visit_schema(queries: DataFrame) -> str:
    return f"query_id {_kind(queries, 'query_id')}, vector array<double>, cell int, block int"


def _spread(query_ids: np.ndarray, vectors: list, pairs: np.ndarray, cells: _Cells) -> Iterator[pd.DataFrame]:
    """Visit rows for (query position, cell) pairs, one per block of the cell, ``VISIT_ROWS`` at a time."""
    at, cell = pairs
    times = cells.blocks[cell]
    at, cell = np.repeat(at, times), np.repeat(cell, times)
    block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    for start in range(0, len(at), VISIT_ROWS):
        part = slice(start, start + VISIT_ROWS)
        yield pd.DataFrame({"query_id": query_ids[at[part]], "vector": [vectors[i] for i in at[part]],
                            "cell": cell[part].astype("int32"), "block": block[part].astype("int32")})


def _home_cells(d: np.ndarray, cells: _Cells, k: int) -> np.ndarray:
    """(query, cell) pairs: per class the nearest cell with at least k vectors, else the nearest."""
    pairs = []
    for label in np.unique(cells.label):
        own = np.flatnonzero(cells.label == label)
        full = own[cells.rows[own] >= k]
        choice = full if len(full) else own
        best = choice[d[:, cells.pivot[choice]].argmin(axis=1)]
        pairs.append(np.vstack([np.arange(len(d)), best]))
    return np.hstack(pairs)


def _first_visits(queries: DataFrame, cells: _Cells, k: int) -> DataFrame:
    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _chord(_unit(pdf["vector"], 0), cells.pivots)
                yield from _spread(pdf["query_id"].to_numpy(), pdf["vector"].tolist(), _home_cells(d, cells, k), cells)
    return queries.mapInPandas(visit, _visit_schema(queries))


def _all_visits(queries: DataFrame, cells: _Cells) -> DataFrame:
    """Every query visits every block: one cell per class, nothing to rule out."""
    listed = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(int(n)).alias("blocks"))
                       for i, n in enumerate(cells.blocks)])
    return (queries.select("query_id", "vector", F.inline(listed))
            .select("query_id", "vector", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))


def _second_visits(queries: DataFrame, cells: _Cells, k: int) -> DataFrame:
    """Visits of the cells a first visit cannot rule out.

    ``bounds`` is the query's k-th distance per class, as (class, chord) pairs.
    A class without one (fewer than k vectors seen) is visited whole.
    """
    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            d = _chord(_unit(pdf["vector"], 0), cells.pivots)
            home = _home_cells(d, cells, k)
            limit = np.full((len(pdf), len(cells.label)), np.inf)
            for i, bounds in enumerate(pdf["bounds"]):
                for b in ([] if bounds is None else bounds):
                    limit[i, cells.label == b["label"]] = b["chord"]
            open_cells = d[:, cells.pivot] - cells.radius <= limit + _SLACK
            open_cells[home[0], home[1]] = False
            yield from _spread(pdf["query_id"].to_numpy(), pdf["vector"].tolist(), np.vstack(np.nonzero(open_cells)), cells)
    return queries.mapInPandas(visit, _visit_schema(queries))


def _best_in_blocks(visits: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per (query, block); both sides of a comparison are bounded.

    The queries visiting a cell are split into groups of ``QUERY_GROUP``; a
    base block is repeated once per group of its own cell, so cells nobody
    visits are not read into the shuffle at all.
    """
    keys = ["cell", "block", "group"]
    # One row per visited cell, at most pivots x classes.
    groups = F.broadcast(visits.where(F.col("block") == 0).groupBy("cell")
                         .agg(F.ceil(F.count(F.lit(1)) / QUERY_GROUP).alias("groups")))
    left = (visits.join(groups, "cell")
            .withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups"))).drop("groups"))
    right = (base.join(groups, "cell")
             .withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups"))

    schema = f"query_id {_kind(visits, 'query_id')}, base_id {_kind(base, 'base_id')}, label int, distance double"
    made = to_arrow_schema(_parse_datatype_string(schema))

    def best(q: pa.Table, b: pa.Table) -> pa.Table:
        if not (q.num_rows and b.num_rows):
            return made.empty_table()
        b = b.take(pc.sort_indices(b.column("base_id")))
        queries, unit = _unit(_matrix(q), 0), _unit(_matrix(b), 1)
        step = max(1, COMPARED // len(unit))
        at, near, distance = zip(*(_nearest(queries[start:start + step], unit, k, start) for start in range(0, len(queries), step)))
        at, near = np.concatenate(at), np.concatenate(near)
        return pa.Table.from_arrays([q.column("query_id").take(at).cast(made.field(0).type), b.column("base_id").take(near).cast(made.field(1).type),
                                     pa.array(np.full(len(at), b.column("label")[0].as_py()), pa.int32()),
                                     pa.array(np.concatenate(distance))], schema=made)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, schema)


def _usable(rows: DataFrame, key: str) -> DataFrame:
    """Rows with an id and a vector of finite components."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(key).isNotNull() & (F.size("vector") > 0) & fine)


def knn_join(query: DataFrame, base: DataFrame, k: int, key: str = "customer_id", vector: str = "embedding",
             per_class: str | None = None, pivots: int = 1) -> DataFrame:
    """The ``k`` nearest base vectors of every query vector.

    Result: ``query_id, base_id, distance, place`` and, with ``per_class`` (an
    integer column of the base), ``label``: then the nearest ``k`` within every
    class. Equal distances are ordered by base id; a zero vector has distance 1.
    Rows without an id, and vectors that are null, empty or hold a null or
    non-finite component take no part on either side, nor do base rows without a
    class where neighbours are sought per class.

    ``pivots`` chooses how, never what: with one, every query meets every block
    of the base; with more (at most ``MAX_PIVOTS``), cells that cannot hold
    anything nearer are ruled out first, which pays for large clustered bases.
    """
    label = F.col(per_class).cast("int") if per_class else F.lit(0)
    base = base.select(F.col(key).alias("base_id"), label.alias("label"),
                       F.col(vector).cast("array<double>").alias("vector"))
    base = _usable(base, "base_id").where("label is not null")
    query = _usable(query.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("vector")), "query_id")
    pruned = pivots > 1
    if pruned:
        chosen = _choose_pivots(base, "vector", "base_id", min(pivots, MAX_PIVOTS))
        assigned = written(_assign(base, chosen), "knn-base")
    else:
        chosen = np.zeros((1, 0))
        assigned = base.withColumns({"pivot": F.lit(0), "to_pivot": F.lit(0.0)})
    cells = _cells(assigned, chosen)
    if not len(cells.rows):
        raise ValueError("the base has no vectors")

    facts = base.sparkSession.createDataFrame(
        [(int(lab), int(piv), i, int(cells.blocks[i])) for (lab, piv), i in cells.number.items()],
        "label int, pivot int, cell int, blocks int")
    blocks = (assigned.join(F.broadcast(facts), ["label", "pivot"])  # at most pivots x classes rows
              .withColumn("block", F.pmod(F.xxhash64("base_id"), F.col("blocks")).cast("int"))
              .select("cell", "block", "base_id", "label", "vector"))

    place = F.row_number().over(Window.partitionBy("query_id", "label").orderBy("distance", "base_id"))

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("place", place).where(F.col("place") <= k)

    visits = _first_visits(query, cells, k) if pruned else _all_visits(query, cells)
    result = best(_best_in_blocks(visits, blocks, k))
    if pruned:
        nearest = written(result, "knn-first")
        # cos distance c and chord length h: h^2 = 2c. Near zero the rounding of c
        # is a large part of h, so it is added to c before the root.
        chord = F.sqrt(F.greatest(F.lit(0.0), 2 * (F.col("distance") + _ROUNDED)))
        bounds = (nearest.where(F.col("place") == k).groupBy("query_id")
                  .agg(F.collect_list(F.struct("label", chord.alias("chord"))).alias("bounds")))
        second = _best_in_blocks(_second_visits(query.join(bounds, "query_id", "left"), cells, k), blocks, k)
        result = best(nearest.drop("place").unionByName(second))
    return result if per_class else result.drop("label")


def knn_join_per_class(query: DataFrame, base: DataFrame, k_per_class: int = 2, target: str = "target",
                       key: str = "customer_id", vector: str = "embedding", pivots: int = 1) -> DataFrame:
    """The nearest ``k_per_class`` base vectors within every label."""
    return knn_join(query, base, k_per_class, key, vector, per_class=target, pivots=pivots)


def nearest_demos(queries: DataFrame, base: DataFrame, k_per_class: int = 2, seed: int = 42, target: str = "target",
                  key: str = "customer_id", vector: str = "embedding", pivots: int = 1) -> DataFrame:
    """The ``k_per_class`` nearest base clients of each class for every query.

    Vectors are scaled by the largest absolute base values first. Result, as that
    of ``random_demos``: ``query_id, position, customer_id, target``, the positions
    in a random order per query. A class with fewer clients gives all it has;
    queries and clients without a usable vector take no part.
    """
    near = knn_join_per_class(max_abs_scale(base, queries, vector), max_abs_scale(base, base, vector), k_per_class,
                              target, key, vector, pivots)
    shuffled = Window.partitionBy("query_id").orderBy(
        hash_order(F.concat_ws("-", F.col("query_id"), F.col("base_id")), seed), F.col("base_id"))
    return near.select("query_id", F.row_number().over(shuffled).alias("position"), F.col("base_id").alias(key),
                       F.col("label").alias(target))
