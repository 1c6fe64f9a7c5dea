"""Nearest stored vectors by an inverted file of centres, with exact similarity at the end.

Every row is in the list of its nearest centre.  A query looks into the lists of its nearest
centres and ranks all rows there by their cosine; with all lists the result is exact.  Centres
are fitted on a bounded sample; they decide how good a guess few lists are, never which
rows there are.  ``recall`` measures the guess against all rows.

Lists are cut into groups of ``GROUP_ROWS`` rows by their counts, so a list that holds a third
of all vectors is compared in many tasks; queries go to the groups, a block of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcart.session import materialize

SAMPLE = 20_000
LISTS = 64
ROUNDS = 10
GROUP_ROWS = 50_000
BLOCK = 256
# Similarities are told apart to so many digits; below that the lower id comes first.
DIGITS = 9
SEED = 7


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


@dataclass(frozen=True)
class Index:
    """Rows ``list, part, id, vector`` in a written table, and the centres of the lists."""

    rows: DataFrame
    centres: np.ndarray
    parts: dict[int, int]


def fit_centres(vectors: DataFrame, column: str, lists: int = LISTS, sample: int = SAMPLE) -> np.ndarray:
    """Centres of a sample of at most ``sample`` rows, taken by a hash of the vectors."""
    rows = (
        vectors.where(F.col(column).isNotNull())
        .select(F.col(column).cast("array<double>").alias("v"))
        .orderBy(F.xxhash64("v", F.lit(SEED)), "v")
        .limit(sample)
        .collect()
    )
    if not rows:
        return np.zeros((1, 1))
    data = _unit(np.array([r.v for r in rows], dtype=float))
    data = np.unique(data, axis=0)
    rng = np.random.default_rng(SEED)
    centres = data[rng.choice(len(data), size=min(lists, len(data)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (data @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, data)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres = np.where(filled[:, None], _unit(sums), centres)
    return centres


def _lists(column: Column, centres: Broadcast, probes: int) -> Column:
    """The numbers of the ``probes`` nearest centres of each vector."""

    def run(vectors: pa.Array) -> pa.Array:
        known = centres.value
        near = _unit(_matrix(vectors, known.shape[1])) @ known.T
        order = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
        offsets = pa.array(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(order.ravel()))

    return F.arrow_udf(run, "array<int>")(column)


def build_index(
    vectors: DataFrame, id_col: str, column: str, lists: int = LISTS, group_rows: int = GROUP_ROWS
) -> Index:
    """Index all rows with a vector; vectors all have the same length."""
    centres = fit_centres(vectors, column, lists)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    rows = vectors.where(F.col(column).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("vector")
    )
    listed = materialize(rows.withColumn("list", _lists(F.col("vector"), shared, 1)[0]))
    # One row per list.
    counts = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}
    parts = {k: -(-n // group_rows) for k, n in counts.items()}
    cut = F.lit(1)
    for number, n in parts.items():
        if n > 1:
            cut = F.when(F.col("list") == number, F.lit(n)).otherwise(cut)
    return Index(
        listed.withColumn("part", F.pmod(F.xxhash64("id"), cut).cast("int")), centres, parts
    )


def _best(top: int):
    """Rows ``list, part, is_query, id, vector`` in that order: the best rows for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held = None, [], []
        matrix: np.ndarray | None = None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            for low, high in zip(starts, [*starts[1:], len(keys)], strict=True):
                *group, is_query = keys[low]
                if group != at:
                    at, ids, held, matrix = group, [], [], None
                part = batch.slice(low, high - low)
                vectors = part.column(4)
                width = len(vectors[0].values)
                rows = _unit(_matrix(vectors, width))
                names = np.array(part.column(3).to_pylist())
                if not is_query:
                    ids.append(names)
                    held.append(rows)
                    continue
                if not held:
                    continue
                if matrix is None:
                    matrix, own = np.concatenate(held), np.concatenate(ids)
                    order = np.argsort(own, kind="stable")
                    matrix, own = matrix[order], own[order]
                for first in range(0, len(rows), BLOCK):
                    near = np.round(rows[first : first + BLOCK] @ matrix.T, DIGITS) + 0.0
                    best = np.argsort(-near, axis=1, kind="stable")[:, :top]
                    queries = np.repeat(names[first : first + BLOCK], best.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(queries),
                            pa.array(own[best.ravel()]),
                            pa.array(np.take_along_axis(near, best, axis=1).ravel()),
                        ],
                        ["query_id", "id", "similarity"],
                    )

    return run


def search(
    index: Index, queries: DataFrame, id_col: str, column: str, top: int = 10, probes: int | None = None
) -> DataFrame:
    """``query_id, rank, id, similarity``: the ``top`` rows for each query by cosine.

    Without ``probes`` all lists are searched, which is exact.  Ties go to the lower id.
    """
    spark = queries.sparkSession
    centres = spark.sparkContext.broadcast(index.centres)
    id_type = dict(index.rows.dtypes)["id"]
    asked = queries.where(F.col(column).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("vector")
    )
    probes = min(probes or len(index.centres), len(index.centres))
    pairs = [(k, p) for k, n in index.parts.items() for p in range(n)]
    groups = spark.createDataFrame(pairs, "list int, part int")
    wanted = asked.withColumn("list", F.explode(_lists(F.col("vector"), centres, probes))).join(
        groups, "list"
    )
    columns = ["list", "part", "is_query", "id", "vector"]
    together = wanted.withColumn("is_query", F.lit(True)).select(*columns).unionByName(
        index.rows.withColumn("is_query", F.lit(False)).select(*columns)
    )
    found = (
        together.repartition("list", "part")
        .sortWithinPartitions("list", "part", "is_query")
        .mapInArrow(_best(top), f"query_id {id_type}, id {id_type}, similarity double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "id", "similarity")
    )


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``queries, recall``: the part of the exact neighbours that were found."""
    hits = exact.join(
        found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left"
    )
    return hits.agg(
        F.count_distinct("query_id").alias("queries"),
        (F.count("hit") / F.count("*")).alias("recall"),
    )
