"""Aggregates that are joined on their keys, and rows that a later join can use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of 64 bits in a table of keys: 4 MB of bits, whatever the input.
WORDS = 1 << 19


def aggregate_for_join(
    df: DataFrame, keys: dict[str, Column | str], *aggregates: Column
) -> DataFrame:
    """One row per key, for a join on the same keys with a side that may have hot ones.

    Grouped by the plain columns, the aggregate and the join would share a shuffle,
    and AQE splits a hot key only in a shuffle that feeds the join directly.  Grouped
    by a struct of them, the reduced rows are shuffled once more and the join can be
    split.  Without aggregates the rows are the distinct keys.
    """
    parts = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in keys.items()]
    key = F.struct(*parts).alias("join_key")
    grouped = df.groupBy(key).agg(*aggregates) if aggregates else df.select(key).distinct()
    return grouped.select("join_key.*", *[c for c in grouped.columns if c != "join_key"])


def _bit(key: str) -> tuple[Column, Column]:
    """The word that a key falls into, and its bit there."""
    h = F.xxhash64(key)
    place = F.shiftrightunsigned(h, 58).cast("int")
    return h.bitwiseAND(F.lit(WORDS - 1)), F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def may_match(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Rows whose ``key`` may be among those of ``known``, for an inner join on it that follows.

    Rows without a match are dropped before they are shuffled, most of them, and all others
    stay.  The keys become bits of a table that has at most ``WORDS`` rows, so it is small
    enough to send to all tasks; once it is full it only drops less.
    """
    if rows.schema[key].dataType != known.schema[key].dataType:
        return rows
    word, bit = _bit(key)
    table = known.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(
        F.bit_or("_bit").alias("_bits")
    )
    hit = (word == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0)
    return rows.join(F.broadcast(table), hit, "left_semi")
