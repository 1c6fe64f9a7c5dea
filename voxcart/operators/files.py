"""Models over the content of files: images to text, images to embeddings.

Files are packed into tasks by their sizes, so a task reads about as many bytes as any
other, however the sizes differ.  A task opens its files one after another and hands them to
the provider in batches of a bounded number of bytes and of files, as answers may be far
larger than what they answer; content never travels between tasks.

A provider is ``provider(contents: list[bytes], **options) -> list``.  The files have to be
on a file system that pyarrow reaches from every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxcart.operators.inference import CallControl, Provider, _ask_part, _file_system

PACK_BYTES = 256 << 20
BATCH_BYTES = 32 << 20
BATCH_FILES = 64
# What opening a file counts for.
OPEN_BYTES = 1 << 20
# Fixed value: numbers of an image embedding.
IMAGE_DIMENSIONS = 1408


def packed(listing: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """``listing`` with ``pack``: files in order of URI, cut at equal sums of bytes.

    Sums run inside ranges of URIs, and one row per range carries them on.
    """
    ranged = listing.select("uri", "size").repartitionByRange("uri").withColumn(
        "range", F.spark_partition_id()
    )
    weight = F.col("size") + OPEN_BYTES
    inside = Window.partitionBy("range").orderBy("uri").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.sum(weight).alias("bytes")).select(
        F.col("range").alias("of"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset")
    )
    summed = ranged.withColumn("upto", F.sum(weight).over(inside))
    return summed.join(offsets, F.col("range") == F.col("of")).select(
        "uri", "size", F.expr(f"(offset + upto - size - {OPEN_BYTES}) div {pack_bytes}").alias("pack")
    )


def map_files(
    listing: DataFrame,
    provider: Provider,
    kind: str = "string",
    pack_bytes: int = PACK_BYTES,
    batch_bytes: int = BATCH_BYTES,
    batch_files: int = BATCH_FILES,
    control: CallControl = CallControl(),
    **options: Any,
) -> DataFrame:
    """``uri, size, answer, rating, status`` of every file; ``kind`` is the type of answers.

    A file that cannot be read, and one whose call fails, has its error as status.
    """
    arrow = {"string": pa.string(), "array<double>": pa.list_(pa.float64())}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answered(rows: list[tuple]) -> pa.RecordBatch:
            good = [r for r in rows if r[2] is not None]
            found = iter(_ask_part(provider, [r[2] for r in good], options, control) if good else [])
            out = [next(found) if r[2] is not None else (None, None, r[3]) for r in rows]
            answers, ratings, states = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array(answers, arrow),
                    pa.array(ratings, pa.string()),
                    pa.array(states, pa.string()),
                ],
                ["uri", "size", "answer", "rating", "status"],
            )

        waiting: list[tuple] = []
        held = 0
        for batch in batches:
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if waiting and (held + size > batch_bytes or len(waiting) >= batch_files):
                    yield answered(waiting)
                    waiting, held = [], 0
                try:
                    system, place = _file_system(uri)
                    with system.open_input_stream(place) as stream:
                        waiting.append((uri, size, stream.read(), ""))
                    held += size
                except OSError as error:
                    waiting.append((uri, size, None, f"{type(error).__name__}: {error}"))
        if waiting:
            yield answered(waiting)

    # With a number of its own the shuffle is not coalesced by the few bytes of the listing.
    tasks = int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = packed(listing, pack_bytes).repartition(tasks, "pack").select("uri", "size")
    return dealt.mapInArrow(
        run, f"uri string, size long, answer {kind}, rating string, status string"
    )


def embed_files(
    listing: DataFrame, provider: Provider, dimensions: int = IMAGE_DIMENSIONS, **settings: Any
) -> DataFrame:
    """``uri, size, embedding, status``; an embedding of another length is an error."""
    found = map_files(listing, provider, "array<double>", **settings)
    right = F.size("answer") == dimensions
    return found.select(
        "uri",
        "size",
        F.when(right, F.col("answer")).alias("embedding"),
        F.when((F.col("status") == "") & ~right, F.concat(F.size("answer").cast("string"), F.lit(" numbers")))
        .otherwise(F.col("status"))
        .alias("status"),
    )


def write_files(files: DataFrame) -> int:
    """Write each ``uri, content`` row as a file; the number written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, content in zip(batch.column(0), batch.column(1), strict=True):
                system, place = _file_system(uri.as_py())
                system.create_dir(place.rpartition("/")[0], recursive=True)
                with system.open_output_stream(place) as sink:
                    sink.write(content.as_py())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return files.select("uri", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
