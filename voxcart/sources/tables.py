"""Parquet tables with a declared schema, and tables built from a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxcart import schemas
from voxcart.session import materialize
from voxcart.sources.versions import VersionedTable


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the columns of ``schema`` to their declared types.

    Ids stay text, so leading zeros survive; timestamps without a zone become
    UTC instants.  Columns the file lacks read as NULL.
    """
    have = set(df.columns)
    return df.select(
        [
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One of the declared input tables; only columns a query uses are read."""
    return conform(spark.read.parquet(path), schemas.TABLES[table])


def _versions(spark: SparkSession, name: str) -> VersionedTable:
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return VersionedTable(spark, f"{root}/{name}")


def save_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Create or replace table ``name`` from a query and read it back.

    The new version is written beside the old one and one commit points to it, so readers
    never find half a table, queries that run keep the version they began with, and a table
    may be built from itself.  In this session ``name`` is a view of the new version.
    """
    _versions(df.sparkSession, name).replace(df, **options)
    return open_table(df.sparkSession, name)


def open_table(spark: SparkSession, name: str, number: int | None = None) -> DataFrame:
    """The current version of a saved table, or the one at a commit."""
    table = _versions(spark, name).read(number)
    if number is None:
        table.createOrReplaceTempView(name)
    return table


def expire_versions(spark: SparkSession, name: str, keep: int = 2) -> list[str]:
    """Delete the files of all but the last ``keep`` versions of a saved table."""
    return _versions(spark, name).expire(keep)


def temp_table(df: DataFrame, name: str) -> DataFrame:
    """Session-scoped named result: computed once, however often it is used."""
    kept = materialize(df)
    kept.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def run_query(spark: SparkSession, query: str, tables: dict, **values) -> DataFrame:
    """SQL text with ``{table}`` slots for DataFrames and ``:name`` for values."""
    return spark.sql(query, args=values, **tables)
