"""Splits, folds, samples and batches that depend on the seed and the ids only.

Order inside a stratum is ``md5(id-seed)``, so results do not change with the
partitioning, and strata are ranked in hash buckets: a class with most of the
rows is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clienttrace.operators.ranks import hash_order, hash_rank, join_groups


def stratified_split(df: DataFrame, target: str = "target", test_fraction: float = 0.1, seed: int = 42,
                     key: str = "customer_id") -> DataFrame:
    """Adds ``split``: per class the first ``round(fraction * n)`` go to test."""
    quota = F.round(F.lit(test_fraction) * F.col("_size"))
    return (hash_rank(df, [target], key, seed, "_rank", "_size")
            .withColumn("split", F.when(F.col("_rank") <= quota, "test").otherwise("train"))
            .drop("_rank", "_size"))


def train_validation_test(df: DataFrame, target: str = "target", test_fraction: float = 0.1,
                          validation_fraction: float = 0.1, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """A second stratified split takes the validation part out of train."""
    first = stratified_split(df, target, test_fraction, seed, key)
    train = first.where(F.col("split") == "train").drop("split")
    second = stratified_split(train, target, validation_fraction, seed, key).withColumn(
        "split", F.when(F.col("split") == "test", "validation").otherwise("train"))
    return second.unionByName(first.where(F.col("split") == "test"))


def stratified_kfold(df: DataFrame, target: str = "target", k: int = 5, seed: int = 42,
                     key: str = "customer_id") -> DataFrame:
    """Adds ``fold`` 0..k-1, balanced within every class."""
    return (hash_rank(df, [target], key, seed, "_rank", "_size")
            .withColumn("fold", ((F.col("_rank") - 1) % k).cast("int"))
            .drop("_rank", "_size"))


def sample_n(df: DataFrame, n: int = 3000, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """``n`` rows without replacement, or all if there are fewer.

    Rows are ranked in hash buckets, so that any ``n`` stays spread over the tasks.
    """
    return hash_rank(df, [], key, seed, "_rank", "_size").where(F.col("_rank") <= n).drop("_rank", "_size")


def stratified_sample_n(df: DataFrame, target: str = "target", n: int = 5000, seed: int = 42,
                        key: str = "customer_id") -> DataFrame:
    """Exactly ``n`` rows (or all), classes in proportion.

    Whole parts of the quotas first; the rows still missing go to the classes
    with the largest remainders, the smaller class value first on a tie.
    """
    sizes = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy()  # one row per class
    share = F.least(F.lit(n), F.col("_all")) * F.col("_n") / F.col("_all")
    quotas = (sizes.withColumn("_all", F.sum("_n").over(everything))
              .withColumn("_whole", F.floor(share))
              .withColumn("_rest", F.least(F.lit(n), F.col("_all")) - F.sum("_whole").over(everything))
              .withColumn("_place", F.row_number().over(
                  everything.orderBy((share - F.col("_whole")).desc(), F.col(target))))
              .select(target, (F.col("_whole") + (F.col("_place") <= F.col("_rest")).cast("int")).alias("_quota")))
    return (hash_rank(df, [target], key, seed, "_rank", "_size").transform(join_groups, quotas, [target])
            .where(F.col("_rank") <= F.col("_quota"))
            .drop("_rank", "_size", "_quota"))


def equal_per_class(df: DataFrame, target: str = "target", n: int = 500, seed: int = 42,
                    classes: int | None = None, key: str = "customer_id") -> DataFrame:
    """``n // classes`` rows of each class."""
    ranked = hash_rank(df, [target], key, seed, "_rank", "_size")
    if classes is None:
        found = df.select(target).distinct().agg(F.count(F.lit(1)).alias("_classes"))
        per_class = F.floor(F.lit(n) / found.scalar())
    else:
        per_class = F.lit(n // classes)
    return ranked.where(F.col("_rank") <= per_class).drop("_rank", "_size")


def random_demos(queries: DataFrame, base: DataFrame, k_per_class: int = 1, seed: int = 42,
                 target: str = "target", key: str = "customer_id") -> DataFrame:
    """``k_per_class`` random base clients of each class for every query.

    Base clients are numbered in hash order within their class. A query hashes
    to a start number per class and takes the next ``k`` numbers around the
    circle, so the lookup is an equi join on (class, number): no query meets
    the whole base. Result: ``query_id, position, customer_id, target``, the
    positions in a random order per query.
    """
    numbered = hash_rank(base.select(key, target), [target], key, seed, "_number", "_size")
    sizes = numbered.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    # One value for all classes: (class, size) pairs, bounded by the class count.
    menu = sizes.agg(F.sort_array(F.collect_list(F.struct(target, "_n"))).alias("_menu")).scalar()
    start = F.conv(F.substring(hash_order(F.concat_ws("-", F.col("query_id"), F.col(target)), seed), 1, 8), 16, 10)
    wanted = (queries.select(F.col(key).alias("query_id"), menu.alias("_menu"))
              .select("query_id", F.inline("_menu"))
              .withColumn("_start", start.cast("long") % F.col("_n"))
              .withColumn("_step", F.explode(F.sequence(F.lit(0), F.least(F.lit(k_per_class), F.col("_n")) - 1)))
              .withColumn("_number", (F.col("_start") + F.col("_step")) % F.col("_n") + 1)
              .select("query_id", target, "_number"))
    shuffled = Window.partitionBy("query_id").orderBy(
        hash_order(F.concat_ws("-", F.col("query_id"), F.col(key)), seed), F.col(key))
    return (wanted.join(numbered.select(target, "_number", key), [target, "_number"])
            .withColumn("position", F.row_number().over(shuffled))
            .select("query_id", "position", key, target))


def assign_batches(df: DataFrame, size: int, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """Adds ``batch_id``: a random permutation cut into runs of ``size`` rows."""
    return (hash_rank(df, [], key, seed, "_rank", "_size")
            .withColumn("batch_id", F.floor((F.col("_rank") - 1) / size))
            .drop("_rank", "_size"))


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first rows in a fixed order, for candidate lists and trial runs."""
    return df.orderBy(*order).limit(n)


def first_per_class(df: DataFrame, order: str, target: str = "target", keep: Sequence[str] = ("customer_id",),
                    within: int | None = None) -> DataFrame:
    """The first row of each class in a fixed order, optionally within the first rows."""
    source = df.orderBy(order).limit(within) if within else df
    return source.groupBy(target).agg(*[F.min_by(c, order).alias(c) for c in keep])


def extreme_examples(preds: DataFrame, prob: str = "pred_prob", key: str = "customer_id") -> DataFrame:
    """The ids with the highest and the lowest probability (the smaller id on a tie)."""
    highest = F.max_by(key, F.struct(F.col(prob), -F.col(key)))
    lowest = F.min_by(key, F.struct(F.col(prob), F.col(key)))
    return preds.agg(F.array(F.struct(F.lit("highest").alias("end"), highest.alias(key)),
                             F.struct(F.lit("lowest").alias("end"), lowest.alias(key))).alias("_ends")
                     ).select(F.inline("_ends"))
