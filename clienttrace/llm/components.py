"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clienttrace.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Neighbours of each node are tied to the smallest of them.

    The minimum is combined map side and joined back, so a node with very many
    neighbours is never gathered in one place.
    """
    if large:
        edges = _both(edges)
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    low = low.select("a", F.least("a", "low").alias("low"))
    tied = edges.join(low, "a")
    if large:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    down = tied.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return down.unionByName(low.where("a != low").select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node each node of ``edges`` (``a``, ``b``, long) is connected to.

    Only nodes with an edge are listed; the root itself is not. Every round is
    written to the shared folder, which cuts the lineage; the number of rounds
    grows with the logarithm of the largest component. Edges with a null end, of
    a node to itself and repeated ones change nothing; no edges give no rows.
    """
    edges = edges.select("a", "b").where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = written(edges, "edges"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        edges = written(_star(_star(edges, large=True), large=False), "edges")
