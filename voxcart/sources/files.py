"""File listings as tables: one row per file under a prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the listings hold PNG files.
FILE_GLOB = "*.png"


def list_files(spark: SparkSession, prefix: str, glob: str = FILE_GLOB) -> DataFrame:
    """Listing with ``uri``, size, time and content.

    A query that does not select ``content`` never opens a file.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(prefix)
    )
    return listing.select(
        F.col("path").alias("uri"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("updated"),
        "content",
    )


def png_only(listing: DataFrame, uri: str = "uri") -> DataFrame:
    """The same glob for a listing that is already a table of URIs."""
    suffix: Column = F.col(uri).endswith(FILE_GLOB.lstrip("*"))
    return listing.where(suffix)
