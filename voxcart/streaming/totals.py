"""Windowed streams over the landing data, and the refund stream itself.

The hourly totals and the exchange summary are derived from the purpose of the
streams; they add watermarks and windows of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from voxcart.operators.outbox import outbox
from voxcart.sources.landing import landing_table
from voxcart.sources.versions import MergedTable
from voxcart.streaming.landing import RETENTION, query_id


def hourly_refunds(refunds: DataFrame, delay: str = RETENTION) -> DataFrame:
    """Number and amount of refunds per hour of publishing (batch or stream)."""
    if refunds.isStreaming:
        refunds = refunds.withWatermark("publish_time", delay)
    return refunds.groupBy(F.window("publish_time", "1 hour").alias("hour")).agg(
        F.count("*").alias("refunds"), F.sum("refund_amount").alias("amount")
    ).select(F.col("hour.start").alias("publish_hour"), "refunds", "amount")


TOTALS = (
    T.StructType()
    .add("publish_hour", T.TimestampType())
    .add("refunds", T.LongType())
    .add("amount", T.DoubleType())
)


def totals_table(spark: SparkSession, path: str) -> MergedTable:
    """Totals by hour, in parts of a day."""
    day = F.date_format("publish_hour", "yyyy-MM-dd")
    return MergedTable(spark, path, TOTALS, day, ("publish_hour",))


def publish_totals(
    totals: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Keep the totals of a windowed stream as a table that readers find whole.

    A micro-batch gives the windows that it changed; only the days of these are written
    again, in one commit.  Windows leave the state when the watermark has passed them, and
    what comes later than that is put right by ``correct_totals``.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        source = query_id(batch.sparkSession, checkpoint)
        totals_table(batch.sparkSession, path).merge(batch, source, batch_id)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        totals.writeStream.outputMode("update")
        .foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def correct_totals(
    spark: SparkSession, landed: str, landing: T.StructType, path: str, after: int = 0
) -> int:
    """Count again the hours that landing commits after number ``after`` have touched.

    The landing table takes every message however late, so its hours are what totals ought
    to be.  Returns the number of the last commit seen, for the next call.
    """
    table = landing_table(spark, landed, landing)
    state = table.log.state()
    touched = {
        part
        for commit in table.log.history(after)
        for entry in commit["add"]
        for part in entry["rows"]
    }
    if touched:
        rows = table.read(touched.__contains__, state.number).where("publish_time IS NOT NULL")
        totals_table(spark, path).merge(
            hourly_refunds(rows), source=f"corrected:{landed}", batch_id=state.number
        )
    return state.number


def hourly_usage_stream(prompts: DataFrame, delay: str = RETENTION) -> DataFrame:
    """Prompts per hour and model version as a stream."""
    return (
        prompts.withWatermark("publish_time", delay)
        .groupBy(F.window("publish_time", "1 hour").alias("hour"), "model_version")
        .agg(F.count("*").alias("prompts"))
        .select(F.col("hour.start").alias("publish_hour"), "model_version", "prompts")
    )


def exchange_summary(
    prompts: DataFrame,
    responses: DataFrame,
    keys: tuple[str, ...] = ("review_id",),
    delay: str = RETENTION,
) -> DataFrame:
    """Prompts and responses per key and hour: counts and first times.

    A union and a windowed aggregate instead of a stream-stream join, so a key
    with many messages keeps one row of state instead of all its pairs.
    """
    both = prompts.select(*keys, "publish_time", F.lit(True).alias("is_prompt")).unionByName(
        responses.select(*keys, "publish_time", F.lit(False).alias("is_prompt"))
    )
    if both.isStreaming:
        both = both.withWatermark("publish_time", delay)
    prompt_time = F.when(F.col("is_prompt"), F.col("publish_time"))
    response_time = F.when(~F.col("is_prompt"), F.col("publish_time"))
    grouped = both.groupBy(*keys, F.window("publish_time", "1 hour").alias("hour")).agg(
        F.count(prompt_time).alias("prompts"),
        F.count(response_time).alias("responses"),
        F.min(prompt_time).alias("first_prompt"),
        F.min(response_time).alias("first_response"),
    )
    return grouped.select(
        *keys,
        F.col("hour.start").alias("publish_hour"),
        "prompts",
        "responses",
        "first_prompt",
        "first_response",
    )


def decide_refund_stream(
    requests: DataFrame,
    decide_batch: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Refund requests as a stream: decide each micro-batch, admit its events to the outbox.

    ``decide_batch`` turns request rows into refund messages (``key``, ``value``), for
    instance eligibility, model answer and decision in a row.  The outbox at ``path`` takes
    one event for a key, across batches and however often one is run.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        source = query_id(batch.sparkSession, checkpoint)
        outbox(batch.sparkSession, path).admit(
            decide_batch(batch).select("key", "value"), source, batch_id
        )

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        requests.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
