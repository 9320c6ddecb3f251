"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, mismatch

import __spark_entry__ as entry
from logitblend.workload import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.keys() <= entry.queries().keys()
    assert ORACLES.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:4] == ["run", "example_id", "step", "token"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert mismatch(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None
