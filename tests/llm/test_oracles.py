"""Every registered operator with SQL against it, on the smallest tables."""

import pytest
from compare import connect, mismatch

from logitblend.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_operator_equals_sql(spark, con, name):
    assert mismatch(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None
