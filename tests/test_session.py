import time

import pytest
from pyspark.sql import functions as F

from clienttrace.session import CLEANUP, side_by_side, written


def _shuffled(spark):
    """Names of the shuffle files on this machine."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f}


def test_written_tables_leave_no_shuffle_files(spark):
    before = _shuffled(spark)
    table = written(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("v")), "sums")
    for _ in range(50):
        left = _shuffled(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert table.count() == 100 and table.agg(F.sum("v")).first()[0] == sum(range(10_000))


def test_the_session_is_left_as_it_was(spark, monkeypatch):
    was = spark.conf.get(CLEANUP)
    tables = side_by_side([lambda i=i: written(spark.range(1_000).groupBy((F.col("id") % (i + 2)).alias("k")).count(), "counts")
                           for i in range(4)])
    assert [t.count() for t in tables] == [2, 3, 4, 5] and spark.conf.get(CLEANUP) == was
    with pytest.raises(Exception):
        written(spark.range(3).select(F.raise_error(F.lit("no"))), "failed")
    assert spark.conf.get(CLEANUP) == was
