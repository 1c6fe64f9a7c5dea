"""Message streams: source, decoding, at-least-once dedupe, hourly landing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from voxcart.sources.commits import Files
from voxcart.sources.landing import decode, landing_table

# Fixed value: how long a broker keeps an unread message.
RETENTION = "86600 seconds"


def message_stream(
    spark: SparkSession,
    schema: T.StructType,
    path: str | None = None,
    file_format: str = "json",
    **kafka_options: str,
) -> DataFrame:
    """Envelope stream (``data`` plus metadata) from files or from Kafka."""
    if path is not None:
        return spark.readStream.schema(schema).format(file_format).load(path)
    raw = spark.readStream.format("kafka").options(**kafka_options).load()
    position = F.concat_ws("-", "topic", F.col("partition"), F.col("offset"))
    return raw.select(
        F.col("value").cast("string").alias("data"),
        position.alias("message_id"),
        F.col("timestamp").alias("publish_time"),
        F.col("topic").alias("subscription_name"),
        F.to_json("headers").alias("attributes") if "headers" in raw.columns
        else F.lit(None).cast("string").alias("attributes"),
    )


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint."""
    return json.loads(Files(spark).read(f"{checkpoint}/metadata"))["id"]


def land_new(
    batch: DataFrame,
    path: str,
    landing: T.StructType,
    source: str | None = None,
    batch_id: int | None = None,
) -> None:
    """Land the messages of a batch that the table lacks, in one commit.

    Nothing is dropped for being late.  A batch that fails before its commit leaves nothing
    to be seen, and one that is run again after it does nothing.
    """
    landing_table(batch.sparkSession, path, landing).admit(
        decode(batch, landing),
        source,
        batch_id,
        order=[F.col("publish_time"), F.xxhash64(*_plain(landing))],
    )


def _plain(landing: T.StructType) -> list[str]:
    return [f.name for f in landing if not isinstance(f.dataType, T.VariantType)]


def land_messages(
    messages: DataFrame,
    landing: T.StructType,
    path: str,
    checkpoint: str,
    once: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Envelope stream to the flat landing table of one topic, one copy of each message."""

    def land(batch: DataFrame, batch_id: int) -> None:
        source = query_id(batch.sparkSession, checkpoint)
        land_new(batch, path, landing, source, batch_id)

    return (
        messages.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"availableNow": True} if once else {"processingTime": interval}))
        .start()
    )
