"""Near-duplicate documents by SimHash and deletion-variant signatures.

Two fingerprints that differ in at most three of 64 bits, cut into two segments
of 32 bits, differ by at most one bit in one of the segments. So every segment
is indexed as it is and with each of its bits left out in turn; two fingerprints
meet under an equal key, are verified by the number of differing bits, and
linked. Of a left-out bit only opposite values are joined (equal segments meet
under the whole segment), so a pair is seen once per segment.

A segment that more than ``DENSE`` fingerprints share is dense. A sparse
segment meets at most ``DENSE`` partners under a key, so those joins stay linear. Pairs
of dense segments are cut once more: the other segment, which holds the rest of
the difference, is halved and its halves indexed by the same rule. What shares
such a key has at most 18 free bits, so a group is bounded (2^18 fingerprints)
whatever the data; it is linked by the edges of a spanning forest inside a task.

Equal texts have equal fingerprints and are one node. Nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clienttrace.llm.common import map_texts, raw, written
from clienttrace.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 3
DENSE = 128
#: Shingles hashed at a time, so that a very long text needs little memory.
SLICE = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a whole text, as a signed number; a text without words has 0."""
    words = raw(text).split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n, digest = len(words) - shingle + 1, xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for start in range(0, n, SLICE):
        part = words[start:min(start + SLICE, n) + shingle - 1]
        hashes = [digest(s, seed) for s in map(b" ".join, zip(*(part[i:] for i in range(shingle))))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, fp``: the fingerprint of each row's whole text."""
    return map_texts(docs, id_column, text_column, {"fp": pa.int64()}, lambda texts: [[fingerprint(t) for t in texts]])


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= BITS


def _keys(rows: DataFrame, value: str, width: int, *keep: str) -> DataFrame:
    """Rows under each key of ``value``: slot 0 whole, slot i + 1 without bit i, which ``bit`` tells."""
    slots = rows.select(*keep, value, F.explode(F.sequence(F.lit(0), F.lit(width))).alias("slot"))
    one = F.when(F.col("slot") == 0, F.lit(0)).otherwise(F.expr("shiftleft(1L, slot - 1)"))
    return slots.select(*keep, "slot", F.col(value).bitwiseAND(F.bitwise_not(one)).alias("key"),
                        (F.col(value).bitwiseAND(one) != 0).cast("int").alias("bit"))


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Verified pairs of rows under one key that differ in the left-out bit (or share the whole segment)."""
    a, b = left.alias("x"), right.alias("y")
    same = (F.col("x.seg") == F.col("y.seg")) & (F.col("x.slot") == F.col("y.slot")) & (F.col("x.key") == F.col("y.key"))
    # Spark sizes exploded rows like those they come from, a sixteenth of what they are, and would broadcast them.
    return a.hint("merge").join(b, same & _close("x.fp", "y.fp")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def _forest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    root = np.arange(len(values))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a: list[int] = []
    b: list[int] = []
    step = max(1, (1 << 22) // max(1, len(values)))
    for start in range(0, len(values), step):
        near = np.bitwise_count(values[start:start + step, None] ^ values[None, start:]) <= BITS
        for i, j in zip(*np.nonzero(near)):
            x, y = top(start + i), top(start + j)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(start + i)
                b.append(start + j)
    return values[a].view(np.int64), values[b].view(np.int64)


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """``a, b``: edges that connect all fingerprints (``fp``) which differ in at most three bits.

    Edges may repeat. Groups of dense segments are given by a spanning forest,
    all others by their pairs. ``dense`` changes the way, not what is connected.
    """
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    sides = prints.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("seg"), low.alias("value"), high.alias("rest")),
        F.struct(F.lit(1).alias("seg"), high.alias("value"), low.alias("rest")))).alias("s")).select("fp", "s.*")
    crowded = sides.groupBy("seg", "value").count().where(F.col("count") > dense).select(
        "seg", "value", F.lit(True).alias("dense"))
    sides = written(sides.join(crowded, ["seg", "value"], "left").withColumn(
        "dense", F.coalesce("dense", F.lit(False))), "segments")
    sparse, crowd = sides.where(~F.col("dense")), sides.where("dense")
    whole = lambda d: d.select("seg", "fp", F.lit(0).alias("slot"), F.col("value").alias("key"))
    left_out = lambda d, bit: _keys(d, "value", 32, "seg", "fp").where(
        f"slot > 0 and bit = {bit}").drop("bit")
    # Sparse with sparse, under a whole segment and under each left-out bit.
    found = _meet(whole(sparse), whole(sparse)).where("a < b")
    found = found.unionByName(_meet(left_out(sparse, 0), left_out(sparse, 1)))
    if crowd.isEmpty():
        return found
    found = found.unionByName(_meet(left_out(sparse, 0), left_out(crowd, 1)))
    found = found.unionByName(_meet(left_out(crowd, 0), left_out(sparse, 1)))
    # Dense with dense: both under the key of the segment and one of the halved rest.
    rows = _keys(crowd, "value", 32, "seg", "fp", "rest").select("seg", "fp", "slot", "key", "rest")
    halves = rows.select("seg", "fp", "slot", "key", F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.col("rest").bitwiseAND(F.lit(0xFFFF)).alias("part")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("rest", 16).alias("part")))).alias("h")).select(
        "seg", "fp", "slot", "key", "h.*")
    fine = halves.select("seg", "fp", "slot", "key", "half", "part", F.explode(
        F.sequence(F.lit(0), F.lit(16))).alias("slot2"))
    one = F.when(F.col("slot2") == 0, F.lit(0)).otherwise(F.expr("shiftleft(1L, slot2 - 1)"))
    fine = fine.withColumn("part", F.col("part").bitwiseAND(F.bitwise_not(one)))

    # A key leaves 18 bits free at most, so its list has at most 2^18 numbers.
    lists = fine.groupBy("seg", "slot", "key", "half", "slot2", "part").agg(F.collect_set("fp").alias("fps")).where(
        F.size("fps") > 1).select("fps")

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            edges = [_forest(np.sort(fps).view(np.uint64)) for fps in batch["fps"]]
            if edges:
                yield pd.DataFrame({"a": np.concatenate([e[0] for e in edges]),
                                    "b": np.concatenate([e[1] for e in edges])})

    return found.unionByName(lists.mapInPandas(forest, "a long, b long"))


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, fingerprint, component_id`` per row: 16 hex digits, and the smallest id reachable over links.

    Null and empty texts have fingerprint zero and are linked like any other. A
    null id never becomes a component id unless the whole component has none
    (then it is null). Repeated rows are repeated in the result; an empty table
    gives no rows; other columns are not read.
    """
    rows = written(fingerprints(docs, id_column, text_column), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min(id_column).alias("low")), "prints")
    roots = components(links(prints.select("fp")))
    # Their files are far smaller than what a broadcast holds; the sizes of the joins below are measured before.
    linked = prints.hint("merge").join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = linked.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row left of each component of ``groups``: that of its smallest id.

    Of several rows with that id one stays. Rows without an id cannot be told
    apart by it; they stay and do not push out others.
    """
    known = docs.where(F.col(f"`{id_column}`").isNotNull())
    kept = groups(known, id_column, text_column).select(F.col("component_id").alias(id_column)).distinct()
    once = known.join(kept, id_column, "left_semi").dropDuplicates([id_column]).select(*(f"`{c}`" for c in docs.columns))
    return once.unionByName(docs.where(F.col(f"`{id_column}`").isNull()))
