"""Every registered query against its SQL twin, or for rows where it has none."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir, con):
    if name in ORACLES:
        assert compare(spark, con, QUERIES[name], ORACLES[name], sf_dir) is None
    else:
        assert QUERIES[name](spark, sf_dir).limit(1).count() == 1
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
