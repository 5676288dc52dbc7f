"""Scaling, joining and pooling of client vectors, and learned vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clienttrace.operators import embedding
from clienttrace.session import written


def _per_dimension(train: DataFrame, column: str, *stats: Callable[[Column], Column]) -> DataFrame:
    """One row: an array per statistic, in dimension order.

    Values are combined per dimension map side, so the shuffle carries one row
    per dimension and task.
    """
    dims = (train.select(F.posexplode(column).alias("_dim", "_x"))
            .groupBy("_dim").agg(*[s(F.col("_x").cast("double")).alias(f"_s{i}") for i, s in enumerate(stats)]))
    packed = dims.agg(F.sort_array(F.collect_list(F.struct("_dim", *[f"_s{i}" for i in range(len(stats))]))).alias("_all"))
    return packed.select(*[F.col("_all")[f"_s{i}"].alias(f"_s{i}") for i in range(len(stats))])


def max_abs_scale(train: DataFrame, other: DataFrame, column: str = "embedding", out: str | None = None) -> DataFrame:
    """Divides by the largest absolute train value of each dimension; zero columns stay."""
    fitted = _per_dimension(train, column, lambda x: F.max(F.abs(x)))
    return _scale(other, fitted, ["_s0"], column, out,
                  lambda x, top: F.when(top > 0, x.cast("double") / top).otherwise(x.cast("double")))


def standardize(train: DataFrame, other: DataFrame, column: str = "embedding", out: str | None = None) -> DataFrame:
    """Mean 0 and population std 1 by the train part; constant columns are only centred."""
    fitted = _per_dimension(train, column, F.avg, F.stddev_pop)
    return _scale(other, fitted, ["_s0", "_s1"], column, out, lambda x, mean, std: (
        (x.cast("double") - mean) / F.when(std > 0, std).otherwise(F.lit(1.0))))


def _scale(other: DataFrame, fitted: DataFrame, stats: Sequence[str], column: str, out: str | None,
           rule: Callable[..., Column]) -> DataFrame:
    params = fitted.select(F.arrays_zip(*stats)).scalar()
    rows = other.withColumn("_p", params)
    scaled = F.zip_with(column, "_p", lambda x, p: rule(x, *[p[s] for s in stats]))
    return rows.withColumn(out or column, scaled).drop("_p")


def concat_vectors(df: DataFrame, a: str, b: str, out: str = "joined") -> DataFrame:
    return df.withColumn(out, F.concat(F.col(a).cast("array<double>"), F.col(b).cast("array<double>")))


def masked_mean_pool(df: DataFrame, key: str, layer: str, token: str, vector: str, mask: str,
                     last_layers: int) -> DataFrame:
    """Mean over the last layers of each token, then over the unmasked tokens.

    Input is one row per (id, layer, token). Both means are vector sums
    combined map side, so a vector is never cut into rows and a long text is
    spread over tasks.
    """
    top = df.groupBy(key).agg(F.max(layer).alias("_top"))
    values = (df.where(F.col(mask) == 1).join(top, key)
              .where(F.col(layer) > F.col("_top") - last_layers)
              .select(key, token, array_to_vector(F.col(vector).cast("array<double>")).alias("_x")))
    tokens = values.groupBy(key, token).agg(Summarizer.mean(F.col("_x")).alias("_x"))
    pooled = tokens.groupBy(key).agg(Summarizer.mean(F.col("_x")).alias("_x"))
    return pooled.select(key, vector_to_array("_x").alias(vector))


def embed_sequences(records: DataFrame, category: str, amount: str, dim: int = embedding.DIM,
                    window: int = embedding.WINDOW) -> DataFrame:
    """A vector per client learned from its event tokens, without labels; see ``embedding``.

    The result does not depend on partitioning or on how a long history is cut in chunks.
    """
    matrix = embedding.mutual_information(written(embedding.token_pairs(records, category, amount, window), "pairs"))
    return embedding.client_means(records, category, amount, embedding.token_vectors(matrix, dim)).withColumn(
        "embedding", F.col("embedding").cast("array<float>"))


def embed_texts(df: DataFrame, text: str = "text", key: str = "customer_id", dim: int = 256,
                embed_fn: Callable[[list[str]], Sequence[Sequence[float]]] | None = None) -> DataFrame:
    """``(key, embedding)`` of a text column.

    By default hashed TF-IDF. ``embed_fn`` takes a list of texts and returns
    vectors; it is called per Arrow batch in the executors.
    """
    if embed_fn is not None:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                vectors = [[float(x) for x in v] for v in embed_fn(pdf[text].tolist())]
                yield pd.DataFrame({key: pdf[key], "embedding": vectors})
        kind = df.schema[key].dataType.simpleString()
        return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")
    found = hashed_terms(df.select(key, text), text, key, dim)
    entries = F.map_from_entries(F.collect_list(F.struct("place", "value")))
    vectors = found.groupBy(key).agg(entries.alias("_v"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("_v", i), F.lit(0.0)).cast("float"))
    # A text without words has only zeros.
    ids = df.select(F.col(key).alias("_id")).distinct()
    return ids.join(vectors, F.col("_id").eqNullSafe(F.col(key)), "left").select(F.col("_id").alias(key), filled.alias("embedding"))


def hashed_terms(df: DataFrame, text: str, key: str, dim: int) -> DataFrame:
    """``key, place, value``: counts of a text's words by hash place, times the place's inverse document frequency.

    A word's place is from its md5; ``value`` is ``n * ln((texts + 1) / (texts with the place + 1))``. The frequencies
    are ``dim`` rows.
    """
    words = F.explode(F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    place = F.conv(F.substring(F.md5("_w"), 1, 8), 16, 10).cast("long") % dim
    counts = df.select(key, words.alias("_w")).select(key, place.cast("int").alias("place")).groupBy(key, "place").agg(
        F.count(F.lit(1)).alias("_n"))
    texts = df.select(key).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    seen = counts.groupBy("place").agg(F.count(F.lit(1)).alias("_texts"))
    return counts.join(F.broadcast(seen), "place").select(
        key, "place", (F.col("_n") * F.log((texts + 1.0) / (F.col("_texts") + 1.0))).alias("value"))
