"""Client vectors learned from event sequences, without labels.

Events are tokens (category and size of the amount). Tokens that occur within a
few events of each other are counted as pairs, map side; positive pointwise
mutual information weighs them. The leading eigenvectors of that symmetric matrix
are the token vectors. They are found by multiplying a block of fixed random
signs with the matrix a few times: a product is one join and one sum per token,
the only numbers on the driver are ``width x width`` sums of outer products. A
client is the mean of its tokens' vectors, weighted by their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clienttrace.session import written

WINDOW = 5
DIM = 64
#: Columns beyond the wanted ones, and multiplications with the matrix.
SPARE = 8
PASSES = 4


def keys_of(records: DataFrame) -> list[str]:
    return [c for c, kind in records.dtypes if not kind.startswith("array") and c != "chunk"]


def tokens(category: str, amount: str) -> Column:
    """An array of ``category:floor(log2(|amount| + 1))``; without amount just ``category:``."""
    return F.zip_with(category, amount, lambda c, a: F.concat(
        F.coalesce(c.cast("string"), F.lit("")), F.lit(":"),
        F.coalesce(F.floor(F.log2(F.abs(a) + 1)).cast("string"), F.lit(""))))


def token_pairs(records: DataFrame, category: str, amount: str, window: int = WINDOW) -> DataFrame:
    """``a, b, n``: how often two tokens lie at most ``window`` events apart in a client, in both orders.

    Pairs across the chunks of a long history are counted too: a chunk takes the first tokens of the next.
    """
    rows = records.select(*keys_of(records), *(c for c in ("chunk",) if c in records.columns), tokens(category, amount).alias("_t"))
    here = F.size("_t")
    if "chunk" in records.columns:
        after = F.lead(F.slice("_t", 1, window)).over(Window.partitionBy(*keys_of(records)).orderBy("chunk"))
        rows = rows.select("_t", after.alias("_after")).select(
            here.alias("_here"), F.concat("_t", F.coalesce("_after", F.array().cast("array<string>"))).alias("_t"))
    else:
        rows = rows.select(here.alias("_here"), "_t")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda o: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.col("_here"), F.lit(1))), lambda i: i + o <= F.size("_t")),
        lambda i: F.struct(F.element_at("_t", i.cast("int")).alias("a"), F.element_at("_t", (i + o).cast("int")).alias("b")))))
    one = rows.where("_here > 0").select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def mutual_information(pairs: DataFrame) -> DataFrame:
    """``a, b, w``: positive pointwise mutual information of token pairs."""
    of_token = pairs.groupBy("a").agg(F.sum("n").alias("_n"))
    total = pairs.agg(F.sum("n").alias("_total"))
    rows = pairs.join(of_token.withColumnRenamed("_n", "_na"), "a").join(
        of_token.select(F.col("a").alias("b"), F.col("_n").alias("_nb")), "b")
    w = F.log(F.col("n") * F.lit(1.0) * total.scalar() / (F.col("_na") * F.lit(1.0) * F.col("_nb")))
    return rows.select("a", "b", w.alias("w")).where("w > 0")


def signs(token: Column, width: int) -> Column:
    """``width`` signs that a token always has: by the first digit of ``md5(token-place)``."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.when(
        F.substring(F.md5(F.concat(token, F.lit("-"), j.cast("string"))), 1, 1) < "8", 1.0).otherwise(-1.0))


def product(matrix: DataFrame, vectors: DataFrame) -> DataFrame:
    """``a, v``: rows of the matrix times ``vectors`` (``a, v``), summed map side per token."""
    right = vectors.select(F.col("a").alias("b"), "v")
    rows = matrix.join(right, "b").select("a", array_to_vector("v").alias("_v"), "w")
    return rows.groupBy("a").agg(vector_to_array(Summarizer.metrics("sum").summary(F.col("_v"), F.col("w"))["sum"]).alias("v"))


def _outer(rows: DataFrame, left: str, right: str, width: int) -> np.ndarray:
    """Sum over rows of ``left`` times ``right``: one small matrix per task, added up per line."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                out += np.stack(pdf["l"]).T @ np.stack(pdf["r"])
        yield pd.DataFrame({"i": range(width), "line": list(out)})

    lines = rows.select(F.col(left).alias("l"), F.col(right).alias("r")).mapInPandas(run, "i int, line array<double>")
    found = lines.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("line"))).alias("line")).collect()
    out = np.zeros((width, width))
    for r in found:
        out[r["i"]] = r["line"]
    return out


def _turned(rows: DataFrame, column: str, matrix: np.ndarray) -> DataFrame:
    """``a, v``: each row's vector times a small matrix."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"a": pdf["a"], "v": list(np.stack(pdf["v"]) @ matrix)})

    return rows.select("a", F.col(column).alias("v")).mapInPandas(run, "a string, v array<double>")


def token_vectors(matrix: DataFrame, dim: int = DIM, passes: int = PASSES) -> DataFrame:
    """``token, vector``: leading eigenvectors of a symmetric matrix (``a, b, w``), times the root of their size.

    With fewer tokens than ``dim`` the rest are zeros. Signs are set so that a component's third moment is positive.
    """
    width = dim + SPARE
    matrix = written(matrix, "matrix")
    now = written(matrix.select("a").distinct().select("a", signs(F.col("a"), width).alias("v")), "vectors")
    for _ in range(passes):
        now = written(product(matrix, now), "vectors")
        size, axes = np.linalg.eigh(_outer(now, "v", "v", width))
        used = size > size.max(initial=0) * 1e-12
        now = written(_turned(now, "v", np.where(used, axes / np.sqrt(np.where(used, size, 1)), 0)), "vectors")
    both = written(now.join(product(matrix, now).withColumnRenamed("v", "mv"), "a"), "vectors")
    small = _outer(both, "v", "mv", width)
    size, axes = np.linalg.eigh((small + small.T) / 2)
    lead = np.argsort(-np.abs(size), kind="stable")[:dim]
    size, axes = size[lead], axes[:, lead]
    strong = np.abs(size) > np.abs(size).max(initial=0) * 1e-9
    turned = _turned(both, "v", np.where(strong, axes * np.sqrt(np.abs(size)), 0))
    cubes = turned.select(F.transform("v", lambda x: x * x * x).alias("c")).groupBy(F.lit("all")).agg(
        vector_to_array(Summarizer.sum(array_to_vector("c"))).alias("c")).first()
    side = np.where(np.array(cubes["c"] if cubes else [1.0] * dim) < 0, -1.0, 1.0)
    return _turned(turned, "v", np.diag(side)).select(F.col("a").alias("token"), F.col("v").alias("vector"))


def client_means(records: DataFrame, category: str, amount: str, vectors: DataFrame) -> DataFrame:
    """Keys and ``embedding``: the mean of the vectors of a client's tokens, weighted by their counts.

    Tokens without a vector do not count; a client with none of the others gets no row.
    """
    keys = keys_of(records)
    counts = records.select(*keys, F.explode(tokens(category, amount)).alias("token")).groupBy(*keys, "token").agg(
        F.count(F.lit(1)).cast("double").alias("_n"))
    mean = Summarizer.metrics("mean").summary(F.col("_v"), F.col("_n"))["mean"]
    return (counts.join(vectors.select("token", array_to_vector("vector").alias("_v")), "token")
            .groupBy(*keys).agg(vector_to_array(mean).alias("embedding")))
