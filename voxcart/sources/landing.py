"""Message landing tables: hour partitions, exactly-once batches, pruned read."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxcart.functions.measures import instant
from voxcart.schemas import METADATA, payload_schema
from voxcart.sources.once import OnceTable

HOUR = "publish_hour"


def decode(messages: DataFrame, landing: T.StructType) -> DataFrame:
    """JSON body to columns by name, plus the transport's metadata columns.

    Works on a batch or on a stream.  Keys the schema lacks are ignored, missing
    keys are NULL, and a body that is no JSON object gives NULL fields.
    """
    body = F.from_json("data", payload_schema(landing))
    have = set(messages.columns)
    columns = []
    for field in landing.fields:
        if field.name not in METADATA:
            value = body[field.name]
        else:
            value = F.col(field.name) if field.name in have else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return messages.select(columns)


def with_hour(df: DataFrame) -> DataFrame:
    return df.withColumn(HOUR, F.date_trunc("hour", "publish_time"))


def write_hourly(df: DataFrame, path: str, mode: str = "append") -> None:
    """Batch write, one folder per hour.

    The rebalance hint sizes output files: it splits an hour that holds far more rows
    than the others over as many tasks as its size asks for, and packs small hours.
    """
    with_hour(df).hint("rebalance", HOUR).write.mode(mode).partitionBy(HOUR).parquet(path)


def read_hourly(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Landed rows with ``start <= publish_time < end``; whole hours are pruned.

    With the landing ``schema`` no file is opened to find the columns.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField(HOUR, T.TimestampType())]))
    df = reader.parquet(path)
    if start is not None:
        first = start.replace(minute=0, second=0, microsecond=0)
        df = df.where((F.col(HOUR) >= instant(first)) & (F.col("publish_time") >= instant(start)))
    if end is not None:
        last = end - timedelta(microseconds=1)
        df = df.where((F.col(HOUR) <= instant(last)) & (F.col("publish_time") < instant(end)))
    return df.drop(HOUR)


def identity(fields: list[str], key: str = "message_id") -> Column:
    """What tells messages apart: the id, or the whole content where there is none.

    Without an id only copies are equal in all they hold, so different messages stay apart.
    """
    content = F.sha2(F.to_json(F.struct(*fields)), 256)
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("content:"), content))


def dedupe(messages: DataFrame, key: str = "message_id") -> DataFrame:
    """One row per message under at-least-once delivery: its earliest copy.

    The aggregate is combined on the map side, so a message delivered many times
    leaves each task once.
    """
    sortable = [
        f.name
        for f in messages.schema.fields
        if f.name not in (key, "publish_time") and not isinstance(f.dataType, T.VariantType)
    ]
    copies = messages.groupBy(identity(messages.columns, key).alias("message")).agg(
        F.min_by(F.struct("*"), F.struct("publish_time", *sortable)).alias("first")
    )
    return copies.select("first.*")


# Names of the parts of a landed table, in order of time.
HOUR_FORMAT, HOUR_NAME = "yyyy-MM-dd-HH", "%Y-%m-%d-%H"


def landing_table(spark: SparkSession, path: str, landing: T.StructType) -> OnceTable:
    """The landing table of one topic: messages by the hour of their publish time.

    A message is known by its id within that hour, which all its copies share; messages
    without a publish time share a part of their own.
    """
    return OnceTable(
        spark,
        path,
        landing,
        F.date_format("publish_time", HOUR_FORMAT),
        identity(landing.fieldNames()),
    )


def read_landed(
    spark: SparkSession,
    path: str,
    landing: T.StructType,
    start: datetime | None = None,
    end: datetime | None = None,
    number: int | None = None,
) -> DataFrame:
    """Landed rows with ``start <= publish_time < end``; other hours are not even listed.

    ``number`` reads the table as it was at that commit.
    """
    if start is None and end is None:
        return landing_table(spark, path, landing).read(number=number)
    first = start.strftime(HOUR_NAME) if start else ""
    last = (end - timedelta(microseconds=1)).strftime(HOUR_NAME) if end else "9"
    rows = landing_table(spark, path, landing).read(
        lambda part: part != "none" and first <= part <= last, number
    )
    if start is not None:
        rows = rows.where(F.col("publish_time") >= instant(start))
    return rows if end is None else rows.where(F.col("publish_time") < instant(end))
