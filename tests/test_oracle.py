"""Every registered query against its SQL on the smallest tables."""

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries

NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, sf_dir, name):
    assert oracle.compare(spark, con, sf_dir, queries()[name], oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["gbt_eval", "shapley", "text_embedding", "sequence_embedding"])
def test_runs(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["customer_id", "profile"]
