"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical after each run of white space became one
blank.  A Misra-Gries sketch over the digests names the few that may be frequent;
their exact counts and winners are computed by a map-side combined aggregate and
broadcast (at most ``counters`` rows), so that frequent copies are decided where
they are read.  All other digests, each with a bounded number of copies, meet in
an ordinary shuffle.

Defined results: a NULL text counts as empty; a NULL doc_id comes after all
others; of rows with equal text and equal doc_id exactly one is kept; an empty
table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcart.llm.common import even_space, fresh, written

# Counters of the sketch.  A digest with more than 1/COUNTERS of all rows is
# treated as frequent; the broadcast table has at most COUNTERS rows.
COUNTERS = 1024
# No digest with fewer copies is worth a place in the broadcast table.
LEAST_COPIES = 64
# Sketches are merged in two steps so that no task reads those of all tasks.
MERGERS = 64


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with even white space."""
    return F.sha2(even_space(text), 256)


def frequent_winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``text_sha256, winner_id, copies`` of the verified frequent digests.

    ``digests`` has ``doc_id, text_sha256`` and is read twice.
    """
    key = F.xxhash64("text_sha256")
    sketched = (
        digests.select(key.alias("item"))
        .groupBy((F.spark_partition_id() % MERGERS).alias("merger"))
        .agg(
            F.expr(f"approx_top_k_accumulate(item, {counters})").alias("state"),
            F.count("*").alias("rows"),
        )
        # A key, so that partitions without rows send no empty sketch.
        .groupBy(F.lit(0).alias("all"))
        .agg(
            F.expr(f"approx_top_k_combine(state, {counters})").alias("state"),
            F.sum("rows").alias("rows"),
        )
    )
    bound = F.greatest(F.lit(LEAST_COPIES), F.expr(f"rows div {counters}"))
    candidates = (
        sketched.select(
            bound.alias("bound"),
            F.explode(F.expr(f"approx_top_k_estimate(state, {counters})")).alias("top"),
        )
        .where("top.count >= bound")
        .select(F.col("top.item").alias("item"), "bound")
    )
    return (
        digests.withColumn("item", key)
        .join(F.broadcast(candidates), "item")
        .groupBy("text_sha256")
        .agg(
            F.min("doc_id").alias("winner_id"),
            F.count("*").alias("copies"),
            F.max("bound").alias("bound"),
        )
        .where("copies >= bound")
        .drop("bound")
    )


def mark(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    digests = written(
        docs.select("doc_id", text_digest(F.col("text")).alias("text_sha256")), "digests"
    )
    winners = written(frequent_winners(digests, counters), "winners")
    seen = digests.join(F.broadcast(winners), "text_sha256", "left")
    lost = F.col("copies").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("winner_id"))
    removed = seen.where(lost).select(
        "doc_id",
        F.col("winner_id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.lit(False).alias("kept"),
        "text_sha256",
    )
    group = Window.partitionBy("text_sha256")
    ordinary = (
        seen.where(~lost)
        .withColumn("place", F.row_number().over(group.orderBy(F.col("doc_id").asc_nulls_last())))
        .select(
            "doc_id",
            F.min("doc_id").over(group).alias("keep_id"),
            F.coalesce("copies", F.count("*").over(group)).alias("group_size"),
            (F.col("place") == 1).alias("kept"),
            "text_sha256",
        )
    )
    return removed.unionByName(ordinary)


def keep_first(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns."""
    sha, place = fresh(docs, "text_sha256"), fresh(docs, "place_in_group")
    winner, copies = fresh(docs, "winner_id"), fresh(docs, "copies")
    digests = written(
        docs.select("doc_id", text_digest(F.col("text")).alias("text_sha256")), "digests"
    )
    winners = written(frequent_winners(digests, counters), "winners").select(
        F.col("text_sha256").alias(sha),
        F.col("winner_id").alias(winner),
        F.col("copies").alias(copies),
    )
    group = Window.partitionBy(sha).orderBy(F.col("doc_id").asc_nulls_last())
    return (
        docs.withColumn(sha, text_digest(F.col("text")))
        .join(F.broadcast(winners), sha, "left")
        .where(F.col(copies).isNull() | F.col("doc_id").eqNullSafe(F.col(winner)))
        .withColumn(place, F.row_number().over(group))
        .where(F.col(place) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
