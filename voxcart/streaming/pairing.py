"""Prompts and responses paired while they arrive, with state that has a bound in time.

The rule is that of ``operators.pairing``: within a key prompts wait in a queue, a response
goes to the one that has waited longest.  Events wait until the watermark has passed them,
so order of arrival does not matter; then they are taken in order of time.  A prompt leaves
the queue unanswered when no response has come within ``timeout``.  An event that arrives
behind the watermark can no longer be put in order; it goes to a side table as it is.

The engine drops late rows before an operator sees them.  So the query's own watermark lies
``FAR`` behind, and the operator's lies at ``FAR - delay`` after that: timers and late rows
are decided by the latter.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from voxcart.sources.versions import MergedTable
from voxcart.streaming.landing import RETENTION, query_id

FAR_MS = 10 * 366 * 86_400_000
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

PAIR, UNANSWERED, LATE = "pair", "unanswered", "late"
# Times in microseconds.
EVENT = (
    T.StructType()
    .add("at", T.LongType())
    .add("is_prompt", T.BooleanType())
    .add("id", T.StringType())
    .add("body", T.StringType())
)
OUTPUT = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("key", T.StringType()),
            ("kind", T.StringType()),
            ("is_prompt", T.BooleanType()),
            ("at", T.TimestampType()),
            ("id", T.StringType()),
            ("body", T.StringType()),
            ("response_time", T.TimestampType()),
            ("response_id", T.StringType()),
            ("response", T.StringType()),
        )
    ]
)


def _time(micros: int | None) -> datetime | None:
    if micros is None:
        return None
    return datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=micros)


class Pairing(StatefulProcessor):
    """Events of one key: those ahead of the watermark, and prompts that wait."""

    def __init__(self, delay_ms: int, timeout_ms: int):
        self.ahead_ms = FAR_MS - delay_ms
        self.timeout = timeout_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", EVENT)
        self.waiting = handle.getListState("waiting", EVENT)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = self._now(timerValues)
        new = []
        for row in rows:
            event = (row.micros, row.is_prompt, row.id, row.body)
            if row.micros < now:
                yield self._out(key, LATE, event)
            else:
                new.append(event)
        if new:
            yield from self._advance(key, now, new)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = self._now(timerValues)
        yield from self._advance(key, now, [])

    def _now(self, timerValues: Any) -> int:
        """The watermark of this operator, in microseconds."""
        return (timerValues.getCurrentWatermarkInMs() + self.ahead_ms) * 1000

    def _advance(self, key: Any, now: int, new: list[tuple]) -> Iterator[Row]:
        """Take the events that the watermark has passed, and let prompts leave."""
        # Each call of the state store is a round trip: what stays as it is, is not written.
        kept = [tuple(r) for r in self.events.get()]
        waited = [tuple(r) for r in self.waiting.get()]
        events, waiting = kept + new, list(waited)
        # Prompts before responses of the same time.
        events.sort(key=lambda e: (e[0], not e[1], e[2] or ""))
        taken = 0
        for event in events:
            at, is_prompt = event[:2]
            if at >= now:
                break
            taken += 1
            while waiting and waiting[0][0] + self.timeout < at:
                yield self._out(key, UNANSWERED, waiting.pop(0))
            if is_prompt:
                waiting.append(event)
            elif waiting:
                yield self._out(key, PAIR, waiting.pop(0), event)
        while waiting and waiting[0][0] + self.timeout < now:
            yield self._out(key, UNANSWERED, waiting.pop(0))
        events = events[taken:]
        self._keep(self.events, kept, events)
        self._keep(self.waiting, waited, waiting)
        # The millisecond after what is next: then the watermark has passed it.
        next_times = [e[0] for e in events[:1]] + [e[0] + self.timeout for e in waiting[:1]]
        wanted = {min(next_times) // 1000 + 1 - self.ahead_ms} if next_times else set()
        # Without kept events no timer has been set.
        set_before = set(self.handle.listTimers()) if kept or waited else set()
        for timer in set_before - wanted:
            self.handle.deleteTimer(timer)
        for timer in wanted - set_before:
            self.handle.registerTimer(timer)

    @staticmethod
    def _keep(state: Any, before: list[tuple], events: list[tuple]) -> None:
        if events and events != before:
            state.put(events)
        elif before and not events:
            state.clear()

    @staticmethod
    def _out(key: Any, kind: str, event: tuple, response: tuple | None = None) -> Row:
        at, is_prompt, name, body = event
        answer = response or (None, None, None, None)
        return Row(
            key=key[0], kind=kind, is_prompt=is_prompt, at=_time(at), id=name, body=body,
            response_time=_time(answer[0]), response_id=answer[2], response=answer[3],
        )


def _milliseconds(spark: SparkSession, interval: str) -> int:
    seconds = F.expr(f"unix_millis(TIMESTAMP'1970-01-02 00:00:00' + INTERVAL '{interval}')")
    start = F.expr("unix_millis(TIMESTAMP'1970-01-02 00:00:00')")
    return int(spark.range(1).select(seconds - start).first()[0])


def stream_events(
    df: DataFrame, keys: tuple[str, ...], is_prompt: bool, name: str, body: str, time: str
) -> DataFrame:
    """One side of the exchange as events; rows with a NULL key or time are left out."""
    text = F.to_json(F.array(*(F.col(k).cast("string") for k in keys)))
    # One condition and not a chain of them, in which each would parse its message anew.
    usable = F.least(*(F.col(k).isNotNull() for k in (time, *keys)))
    return df.where(usable).select(
        text.alias("key"),
        F.col(time).alias("at"),
        F.unix_micros(time).alias("micros"),
        F.lit(is_prompt).alias("is_prompt"),
        F.col(name).cast("string").alias("id"),
        F.col(body).cast("string").alias("body"),
    )


def pair_stream(
    prompts: DataFrame,
    responses: DataFrame,
    keys: tuple[str, ...] = ("review_id",),
    delay: str = "1 hour",
    timeout: str = RETENTION,
    time: str = "publish_time",
    name: str = "message_id",
) -> DataFrame:
    """Streams of prompts and responses to rows of pairs, unanswered prompts and late events."""
    spark = prompts.sparkSession
    spark.conf.set(PROVIDER, ROCKS_DB)
    events = stream_events(prompts, keys, True, name, "prompt", time).unionByName(
        stream_events(responses, keys, False, name, "response", time)
    )
    processor = Pairing(_milliseconds(spark, delay), _milliseconds(spark, timeout))
    return (
        events.withWatermark("at", f"{FAR_MS} milliseconds")
        .groupBy("key")
        .transformWithState(
            statefulProcessor=processor,
            outputStructType=OUTPUT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def exchange_tables(spark: SparkSession, path: str) -> tuple[MergedTable, MergedTable]:
    """The table of prompts that have left the queue, and the side table of late events."""
    day = F.date_format("at", "yyyy-MM-dd")
    keys = ("key", "is_prompt", "at", "id")
    return (
        MergedTable(spark, f"{path}/exchanges", OUTPUT, day, keys),
        MergedTable(spark, f"{path}/late", OUTPUT, day, keys),
    )


def keep_pairs(
    pairs: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Write what ``pair_stream`` gives to its two tables; a batch that is run again counts once."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        source = query_id(batch.sparkSession, checkpoint)
        done, late = exchange_tables(batch.sparkSession, path)
        batch.persist()
        done.merge(batch.where(F.col("kind") != LATE), source, batch_id)
        late.merge(batch.where(F.col("kind") == LATE), source, batch_id)
        batch.unpersist()

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        pairs.writeStream.outputMode("append")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
