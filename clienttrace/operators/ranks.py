"""Ranks and order statistics that never put a whole hot group into one task.

Two ways, both exact and the same for every size of group:

* ``bucketed_rank`` splits every group by an order-preserving bucket (a prefix
  of a hash, of a string, or a slice of a number), ranks inside the buckets and
  adds the number of rows in lower buckets. Used where few groups hold all rows
  (classes, the whole table).
* ``ordered_rank`` sorts all rows by group and order in even ranges, so a hot
  group lies in as many partitions as it fills. Rows are numbered as they stream
  by; only groups cut by the end of a partition, two per partition at most, need
  the counts of the partitions before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clienttrace.session import written


def hash_order(key: Column, seed: int) -> Column:
    """Reproducible random order of a key, the same in every partitioning."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def join_groups(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Facts per group joined to rows; null is a group like any other."""
    renamed = facts.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return rows.join(renamed, same, how).drop(*(f"_of_{k}" for k in keys))


def bucketed_rank(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column],
                  rank: str = "rank", size: str = "group_rows") -> DataFrame:
    """Adds the 1-based rank in the group and the group's row count.

    ``bucket`` must not decrease along ``order``. One shuffle of the rows, on
    (group, bucket); the bucket counts are combined map side.
    """
    group = list(group)
    parts = group + ["_bucket"]
    rows = df.withColumn("_bucket", bucket)
    below = (Window.partitionBy(*group).orderBy("_bucket")
             .rowsBetween(Window.unboundedPreceding, -1))
    counts = (rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("_rows"))
              .withColumn("_below", F.coalesce(F.sum("_rows").over(below), F.lit(0)))
              .withColumn(size, F.sum("_rows").over(Window.partitionBy(*group)))
              .drop("_rows"))
    inside = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    return (join_groups(rows.withColumn("_inside", inside), counts, parts)
            .withColumn(rank, F.col("_inside") + F.col("_below"))
            .drop("_inside", "_below", "_bucket"))


def hash_rank(df: DataFrame, group: Sequence[str], key: str, seed: int,
              rank: str = "rank", size: str = "group_rows") -> DataFrame:
    """Rank by ``hash_order`` in each group, in 65,536 even buckets per group."""
    rows = df.withColumn("_hash", hash_order(F.col(key), seed))
    return bucketed_rank(rows, group, F.substring("_hash", 1, 4), [F.col("_hash"), F.col(key)],
                         rank, size).drop("_hash")


def _changes(batch: pa.RecordBatch, at: Sequence[int], before: list | None) -> np.ndarray:
    """Places of a batch where a new group starts; nulls are equal."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = before is None or [batch.column(i)[0].as_py() for i in at] != before
    for i in at:
        a, b = batch.column(i).slice(1), batch.column(i).slice(0, batch.num_rows - 1)
        one_null = pc.xor(pc.is_null(a), pc.is_null(b))
        new[1:] |= pc.fill_null(pc.or_kleene(pc.not_equal(a, b), one_null), False).to_numpy(zero_copy_only=False)
        new[1:] |= one_null.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _number(batches: Iterator[pa.RecordBatch], at: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their number in the group, the group's rows here, the partition, and whether it may go on elsewhere.

    The group in hand is kept until it ends; it is a part of one partition at most.
    """
    part = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    before, started = None, False

    def made(batch: pa.RecordBatch, inside: np.ndarray, here: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        added = [pa.array(inside, pa.int64()), pa.array(here, pa.int64()), pa.array(np.full(len(inside), part), pa.int32()), pa.array(edge, pa.bool_())]
        return pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "_inside", "_here", "_part", "_edge"])

    def closed(edge: bool) -> Iterator[pa.RecordBatch]:
        here, done = sum(b.num_rows for b in held), 0
        for b in held:
            n = b.num_rows
            yield made(b, np.arange(done + 1, done + n + 1), np.full(n, here), np.full(n, edge))
            done += n

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _changes(batch, at, before)
        before = [batch.column(i)[batch.num_rows - 1].as_py() for i in at]
        if not len(starts):
            held.append(batch)
            continue
        if starts[0]:
            held.append(batch.slice(0, starts[0]))
        if held:
            yield from closed(not started)
            started = True
        whole = batch.slice(starts[0], starts[-1] - starts[0])
        if whole.num_rows:
            sizes = np.diff(starts)
            here = np.repeat(sizes, sizes)
            edge = np.zeros(whole.num_rows, bool)
            if not started:
                edge[:sizes[0]] = True
                started = True
            yield made(whole, np.arange(whole.num_rows) - np.repeat(starts[:-1] - starts[0], sizes) + 1, here, edge)
        held = [batch.slice(starts[-1])]
    if held:
        yield from closed(True)


def ordered_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank",
                 size: str = "group_rows") -> DataFrame:
    """Adds the 1-based rank along ``order`` in the group and the group's row count.

    One shuffle into even ranges, written; rows with equal keys and order share a partition.
    """
    keys = list(keys)
    by = [*(F.col(k) for k in keys), *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    at = [df.columns.index(k) for k in keys]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    laid = written(rows.mapInArrow(lambda batches: _number(batches, at),
                                   f"{fields}, _inside long, _here long, _part int, _edge boolean"), "ordered")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cut = laid.where("_edge and _inside = 1").select(
        *keys, "_part", F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_below"),
        F.sum("_here").over(Window.partitionBy(*keys)).alias("_whole"))
    # Two groups per partition at most.
    return (join_groups(laid, F.broadcast(cut), [*keys, "_part"], "left")
            .withColumn(rank, F.col("_inside") + F.coalesce("_below", F.lit(0)))
            .withColumn(size, F.coalesce("_whole", "_here"))
            .drop("_inside", "_here", "_part", "_edge", "_below", "_whole"))


def exact_median(df: DataFrame, keys: Sequence[str], value: Column, out: str = "median") -> DataFrame:
    """Exact median of a value per group (nulls ignored): the mean of the one or two rows in the middle."""
    keys = list(keys)
    rows = df.select(*keys, value.cast("double").alias("_value")).where(F.col("_value").isNotNull())
    ranked = ordered_rank(rows, keys, [F.col("_value")], "_rank", "_n")
    middle = F.col("_rank").between(F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2))
    return ranked.where(middle).groupBy(*keys).agg(F.avg("_value").alias(out))


def running_total(df: DataFrame, group: Sequence[str], seq: str, value: Column, out: str,
                  block: int = 100_000) -> DataFrame:
    """Adds the sum of ``value`` over this and all earlier rows of the group.

    ``seq`` numbers the rows. Sums per block of ``seq`` are combined map side
    and added to the running sum inside the block, so one long run is not one
    task.
    """
    group = list(group)
    parts = group + ["_block"]
    rows = df.withColumn("_value", value).withColumn("_block", F.floor(F.col(seq) / block))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (rows.groupBy(*parts).agg(F.sum("_value").alias("_sum"))
              .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
              .drop("_sum"))
    inside = Window.partitionBy(*parts).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (join_groups(rows.withColumn("_inside", F.sum("_value").over(inside)), blocks, parts)
            .withColumn(out, F.col("_before") + F.col("_inside"))
            .drop("_value", "_inside", "_before", "_block"))
