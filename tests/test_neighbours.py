from __future__ import annotations

import numpy as np
import pytest

from voxcart.operators import neighbours


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    data = rng.normal(size=(900, 8))
    data[300:600] = data[7]  # a third of all rows is one vector
    data[899] = 0.0
    return [(i, [float(x) for x in v]) for i, v in enumerate(data)]


def exact(rows, queries, top):
    names = np.array([r[0] for r in rows])
    data = neighbours._unit(np.array([r[1] for r in rows]))
    out = {}
    for q in queries:
        near = np.round(data[q] @ data.T, 9) + 0.0
        order = np.lexsort((names, -near))[:top]
        out[q] = [(int(names[i]), float(near[i])) for i in order]
    return out


@pytest.mark.parametrize("group_rows", [50_000, 40])
def test_all_lists_are_exact(spark, rows, group_rows):
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    index = neighbours.build_index(df, "id", "v", lists=16, group_rows=group_rows)
    assert index.rows.count() == 900 and (group_rows > 40 or max(index.parts.values()) > 5)
    found = neighbours.search(index, df.where("id % 100 = 0 OR id = 899"), "id", "v", top=5)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.similarity))
    assert got == exact(rows, [*range(0, 900, 100), 899], 5)


def test_few_lists_have_a_measured_recall(spark, rows):
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = neighbours.build_index(df, "id", "v", lists=16)
    asked = df.where("id % 50 = 0")
    whole = neighbours.search(index, asked, "id", "v")
    few = neighbours.search(index, asked, "id", "v", probes=8)
    row = neighbours.recall(few, whole).first()
    assert row.queries == 18 and 0.6 < row.recall <= 1
    assert neighbours.recall(whole, whole).first().recall == 1


def test_null_vectors_and_fewer_rows_than_asked(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, v array<double>")
    index = neighbours.build_index(df, "id", "v")
    got = [tuple(r) for r in neighbours.search(index, df, "id", "v").orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1, 1.0), (1, 2, 3, 0.0), (3, 1, 3, 1.0), (3, 2, 1, 0.0)]
