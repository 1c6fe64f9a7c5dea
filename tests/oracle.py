"""Compare a Spark result with the same query run by DuckDB."""

from __future__ import annotations

import math
from datetime import datetime
from pathlib import Path

import duckdb


def connect(folder: str):
    connection = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    """Values in a form in which equal results are equal."""
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    return value


def rows(names: list[str], tuples) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(t[i]) for i in order) for t in tuples), key=repr)


KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def differences(df, connection, sql: str) -> str | None:
    """None if schema and rows agree, else what differs first."""
    relation = connection.sql(sql)
    ours = {name: KINDS.get(kind, kind) for name, kind in df.dtypes}
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    if ours != theirs:
        return f"schema: {sorted(set(ours.items()) ^ set(theirs.items()))}"
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    other = rows(relation.columns, relation.fetchall())
    if len(mine) != len(other):
        return f"{len(mine)} rows, expected {len(other)}"
    for a, b in zip(mine, other):
        if a != b:
            return f"first difference:\n  {str(a)[:700]}\n  {str(b)[:700]}"
    return None
