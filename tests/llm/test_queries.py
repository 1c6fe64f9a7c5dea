"""Every registered query against its SQL twin, where SQL can express it."""

from __future__ import annotations

import pytest

from tests.oracle import connect, differences
from voxcart.llm.oracles import ORACLES
from voxcart.llm.queries import QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, folder, name):
    folder = folder.replace("sf0.001", "sf0.01")
    assert differences(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) is None
