"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from parity import connect, difference

from tamiz.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", [k for k in QUERIES if k in SQL])
def test_equal(spark, con, small, name):
    assert difference(spark, con, small, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", [k for k in QUERIES if k not in SQL])
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)
