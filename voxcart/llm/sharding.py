"""Contiguous shards of near equal size, by global prefix sums of byte sizes.

Rows are dealt into ranges of (digest of the text, doc_id).  Each range yields
one total; running sums of those totals give every range its offset, and running
sums inside a range give every row its place in the whole.  Shard ``k`` holds the
rows that begin in the ``k``-th of equal cuts of all bytes.

Equal texts are neighbours in that order, so a shard's border cuts at most one group of
them, wherever it falls; a group that holds a third of all rows is cut like any others.

Defined results: a NULL text has no bytes and counts as empty for its checksum; a
NULL doc_id comes first among equal texts; repeated rows get a slot each; an empty
table gives no rows; further columns are not looked at, and kept by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcart.llm.common import fresh, scratch, written

SHARDS = 40
ROW_OVERHEAD = 16


def _sized(docs: DataFrame) -> list[Column]:
    text = F.coalesce(docs["text"], F.lit(""))
    return [
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(text).alias("text_md5"),
    ]


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``shard``, ``place`` (rows before it) and ``start`` (bytes before it)."""
    ranged = written(
        rows.repartitionByRange("text_md5", "doc_id").withColumn("range", F.spark_partition_id()),
        "ranges",
    )
    # One row per range: as many as there are shuffle partitions.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("range")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select(
            "range",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("total"),
        )
    )
    inside = Window.partitionBy("range").orderBy("text_md5", "doc_id")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(F.broadcast(offsets), "range").select(
        *(F.col(c) for c in rows.columns),
        "total",
        (F.col("bytes_before") + F.sum("size").over(upto) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("place"),
    )
    # Sizes stay below 2^63 / shards; ``div`` keeps the cut exact.
    cut = F.expr(f"CAST(least((start * {shards}) div total, {shards - 1}) AS INT)")
    return placed.withColumn("shard", cut).drop("total")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, start`` per row.

    ``start`` counts the bytes before the row in the order of the shards.
    """
    placed = written(_placed(docs.select(*_sized(docs)), shards), "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "start",
    )


def write_shards(docs: DataFrame, folder: str | None = None, shards: int = SHARDS) -> str:
    """Write ``docs`` as one folder per shard (``shard=k``), each row in full, in order.

    Rows carry their columns through the ranges, so none is looked up by its doc_id.  If
    ``docs`` has a column ``shard`` the folders are named ``_shard=k``.  Returns the folder.
    """
    folder = folder or scratch(docs.sparkSession, "shards")
    whole = F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("whole")
    name = fresh(docs, "shard")
    (
        _placed(docs.select(*_sized(docs), whole), shards)
        .select("whole.*", F.col("shard").alias(name))
        .write.partitionBy(name)
        .parquet(folder)
    )
    return folder
