"""Every registered query against its SQL twin, and what its plan must not hold."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_point
from tests.oracle import connect, differences
from voxcart.plans import catalog

QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) - set(ORACLES) == set()
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    # Python sees columns of Arrow batches, never rows one by one.
    assert not re.search("BatchEvalPython", plan)
    if name in ORACLES:
        assert differences(df, duck, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).columns[0] == "review_id"
