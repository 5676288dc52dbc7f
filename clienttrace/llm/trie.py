"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A turn is known by a digest of role and text that carries the text's length, so
texts are read once and never moved. Turns get their position by a range
repartition and counts of earlier partitions, hence a conversation of any
length is spread over tasks. Eight positions are the columns of a block; a block
is keyed by the prior block's node, that is the digest of all turns before it,
so the blocks of all conversations are rolled up together and not one after the
other. Digests of prefixes are exclusive ors of hashes of (position, turn),
twice 64 bits, which running windows over blocks give.

Sums over subtrees double the distance to the ancestor they are sent to, so the
rounds grow with the logarithm of the depth. The ids that end at a node are
hashed while they stream by in order; no list of members is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clienttrace.llm.common import columns, written
from clienttrace.operators.ranks import bucketed_rank

#: Positions of a block; turns a conversation takes from another are fewer than ``SHARED``; ids of one family differ
#: by less than ``FAMILY``.
WIDTH = 8
SHARED = 9
FAMILY = 5
#: Blocks whose digests are summed in one window before their total is carried on.
STRETCH = 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, tid``: turns numbered from 1 by turn, nulls first, rows of one turn by digest."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    size = F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0"))
    rows = columns(turns, "conv_id", "turn", "role", "text").where("conv_id is not null").select(
        "conv_id", "turn", F.concat(F.unhex(F.md5(F.concat_ws(":", F.length(role), role, text))), size).alias("tid"))
    order = [F.col("turn").asc_nulls_first(), F.col("tid")]
    laid = written(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    return bucketed_rank(laid, ["conv_id"], F.col("part"), order, "pos", "turns").select("conv_id", "pos", "tid", "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids with their rebuilt number of turns (``conv_id, n``), and those turns (``conv_id, pos, tid``).

    A conversation takes the first turns of the first of its family instead of its own. A turn goes to the few
    members of a family, so the join cannot multiply rows beyond that.
    """
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    ids = turns.groupBy("conv_id").agg(F.max("turns").alias("own")).select(
        "conv_id", "own", first.alias("base"),
        F.crc32(F.col("conv_id").cast("string").cast("binary")).alias("h")).withColumn("h", F.col("h") % SHARED)
    lengths = ids.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    ids = ids.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
    ids = written(ids.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "ids")
    own = turns.select("conv_id", "pos", "tid").join(ids.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "tid")
    heads = turns.where(F.col("pos") < SHARED).select(F.col("conv_id").alias("base"), "pos", "tid")
    taken = heads.join(ids.select("conv_id", "base", "h"), "base").where("pos <= h").select("conv_id", "pos", "tid")
    return ids.select("conv_id", "n"), own.unionByName(taken)


def _hashes(position: Column, tid: Column) -> list[Column]:
    return [F.xxhash64(position, tid), F.xxhash64(tid, position, F.lit(1))]


def blocked(turns: DataFrame) -> DataFrame:
    """``conv_id, block, t1.., k1, k2``: turn ids in columns, and the digest of all turns before the block."""
    slot = F.col("slot")
    block = F.floor((F.col("pos") - 1) / WIDTH)
    rows = turns.select("conv_id", "tid", "pos", block.alias("block"), ((F.col("pos") - 1) % WIDTH).alias("slot"))
    one, two = _hashes(F.col("pos"), F.col("tid"))
    wide = rows.groupBy("conv_id", "block").agg(
        *(F.max(F.when(slot == i, F.col("tid"))).alias(f"t{i + 1}") for i in range(WIDTH)),
        F.bit_xor(one).alias("h1"), F.bit_xor(two).alias("h2"))
    wide = wide.withColumn("stretch", F.floor(F.col("block") / STRETCH))
    # Digests of what lies before: whole stretches first, then blocks inside one.
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = wide.groupBy("conv_id", "stretch").agg(F.bit_xor("h1").alias("f1"), F.bit_xor("h2").alias("f2"))
    far = far.select("conv_id", "stretch", *(F.bit_xor(f"f{i}").over(before).alias(f"b{i}") for i in (1, 2)))
    near = wide.select("*", *(F.bit_xor(f"h{i}").over(inside).alias(f"a{i}") for i in (1, 2)))
    none = F.lit(0).cast("long")
    return near.join(far, ["conv_id", "stretch"]).select("conv_id", "block", *(f"t{i + 1}" for i in range(WIDTH)), *(
        F.coalesce(f"a{i}", none).bitwiseXOR(F.coalesce(f"b{i}", none)).alias(f"k{i}") for i in (1, 2)))


def nodes(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """``depth, k1, k2, p1, p2, conv_id, n_convs, size``: one row per distinct prefix, the root included.

    ``k`` is the node's digest, ``p`` its parent's, ``size`` the bytes of its last text.
    """
    names = [f"t{i + 1}" for i in range(WIDTH)]
    rolled = turns.sparkSession.sql(f"""
        SELECT block, k1, k2, {', '.join(names)}, grouping_id() AS rolled,
          min(conv_id) AS conv_id, count(*) AS n_convs
        FROM {{blocks}} GROUP BY block, k1, k2, ROLLUP ({', '.join(names)})""", blocks=blocked(turns))
    # grouping_id has a bit for each column left out; the block and its key never are.
    level = WIDTH - F.bit_count("rolled").cast("int")
    rolled = rolled.withColumn("level", level).where("level > 0")
    last = F.element_at(F.array(*names), F.col("level"))
    start = F.col("block") * WIDTH

    def upto(key: str, which: int, levels: Column) -> Column:
        out = F.col(key)
        for i, n in enumerate(names):
            out = out.bitwiseXOR(F.when(levels > i, _hashes(start + (i + 1), F.col(n))[which]).otherwise(F.lit(0).cast("long")))
        return out

    found = rolled.withColumn("last", last).where(F.col("last").isNotNull()).select(
        (start + F.col("level")).alias("depth"),
        *(upto(f"k{i + 1}", i, F.col("level")).alias(f"n{i + 1}") for i in (0, 1)),
        *(upto(f"k{i + 1}", i, F.col("level") - 1).alias(f"p{i + 1}") for i in (0, 1)),
        "conv_id", "n_convs", F.conv(F.hex(F.substring("last", 17, 4)), 16, 10).cast("long").alias("size"),
    ).withColumnsRenamed({"n1": "k1", "n2": "k2"})
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), null.alias("p1"), null.alias("p2"), "conv_id", "n_convs",
        zero.alias("size"))
    return found.unionByName(root)


def subtree_sums(tree: DataFrame, values: list[str], depth: int) -> DataFrame:
    """``k1, k2`` and ``values`` summed over each node's subtree, by sending sums 1, 2, 4, ... levels up."""
    sums = written(tree.select("k1", "k2", F.col("p1").alias("j1"), F.col("p2").alias("j2"), *values), "sums")
    reach = 1
    while reach <= depth:
        sent = sums.where("j1 is not null").groupBy(F.col("j1").alias("s1"), F.col("j2").alias("s2")).agg(
            *(F.sum(v).alias(f"_{v}") for v in values))
        # Nothing lies above the root, so whoever already points to it needs no lookup there.
        far = sums.where("j1 is not null").select(F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.col("j1").alias("o1"), F.col("j2").alias("o2"))
        sums = written(
            sums.join(sent, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left")
            .join(far, (F.col("j1") == F.col("m1")) & (F.col("j2") == F.col("m2")), "left")
            .select("k1", "k2", F.col("o1").alias("j1"), F.col("o2").alias("j2"),
                    *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)), "sums")
        reach *= 2
    return sums.select("k1", "k2", *values)


def ends(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """``e1, e2, ends_sha256``: the ids whose turns end at a node, in order, hashed as they stream by."""
    one, two = _hashes(F.col("pos"), F.col("tid"))
    whole = turns.groupBy("conv_id").agg(F.bit_xor(one).alias("e1"), F.bit_xor(two).alias("e2"))
    zero = F.lit(0).cast("long")
    rows = whole.unionByName(ids.where("n = 0").select("conv_id", zero.alias("e1"), zero.alias("e2")))
    rows = rows.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "conv_id").select("e1", "e2", F.col("conv_id").cast("string").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None

        def made(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))],
                                              ["e1", "e2", "ends_sha256"])

        for batch in batches:
            done = []
            for e1, e2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if now == (e1, e2):
                    sha.update(b"," + conv.encode())
                    continue
                if now:
                    done.append((*now, sha.hexdigest()))
                now, sha = (e1, e2), hashlib.sha256(conv.encode())
            if done:
                yield made(done)
        if now:
            yield made([(*now, sha.hexdigest())])

    return rows.mapInArrow(run, "e1 long, e2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, as the contract of ``op13_`` names them.

    Rows without a ``conv_id`` belong to no conversation and are left out; null
    roles and texts are empty, null turns come first, rows of one turn go by
    their digest, repeated rows are turns of their own. No conversations give no
    rows; other columns are not read.
    """
    ids, turns = rebuilt(numbered(conversations))
    turns = written(turns, "rebuilt")
    tree = written(nodes(ids, turns), "nodes")
    depth = tree.agg(F.max("depth")).first()[0] or 0
    children = tree.where("p1 is not null").groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    tree = tree.join(children, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left").drop("c1", "c2").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0)))
    tree = written(tree.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn(
        "saved_tokens", (F.col("n_convs") - 1) * F.col("size")), "tree")
    sums = subtree_sums(tree, ["n_leaves", "saved_tokens"], depth)
    tops = tree.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    full = tree.drop("n_leaves", "saved_tokens").join(sums, ["k1", "k2"]).join(
        tops, (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")), "left").join(
        ends(ids, turns), (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")), "left")
    longs = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return full.select(*(F.col(n).cast("long").alias(n) for n in longs),
                       F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
