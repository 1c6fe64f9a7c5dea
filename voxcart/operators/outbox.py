"""An outbox of events: each key is admitted once, across batches, retries and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxcart.sources.commits import State
from voxcart.sources.once import OnceTable

EVENTS = T.StructType().add("key", T.StringType()).add("value", T.StringType())
# Parts of an outbox: a batch looks only into those that its keys fall into.
BUCKETS = 64


def outbox(spark: SparkSession, path: str, buckets: int = BUCKETS) -> OnceTable:
    """Events ``key, value``, known by their key.  ``buckets`` is fixed for a folder.

    An event without a key is known by what it says.
    """
    known = F.coalesce("key", F.concat(F.lit("value:"), F.sha2(F.coalesce("value", F.lit("")), 256)))
    bucket = F.format_string("%05d", F.pmod(F.xxhash64(known), F.lit(buckets)))
    return OnceTable(spark, path, EVENTS, bucket, known)


def admit(
    spark: SparkSession,
    path: str,
    events: DataFrame,
    source: str | None = None,
    batch_id: int | None = None,
) -> State:
    """Put the events whose keys are new into the outbox, in one commit.

    Of several events with one key in a batch the first by its text is admitted.
    """
    return outbox(spark, path).admit(
        events.select("key", "value"), source, batch_id, order=[F.col("value")]
    )


def sent_after(spark: SparkSession, path: str, number: int) -> tuple[DataFrame, int]:
    """Events admitted by the commits after ``number``, for a sender, and the last number."""
    box = outbox(spark, path)
    state = box.log.state()
    new = {e["folder"] for c in box.log.history(number) for e in c["add"]}
    fresh = State(live={f: e for f, e in state.live.items() if f in new})
    return box._rows(fresh).select(*EVENTS.fieldNames()), state.number
