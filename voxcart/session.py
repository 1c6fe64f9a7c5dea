"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# What every job here counts on.  Joins carry no unconditional broadcast hint:
# a side is broadcast only when its statistics or its measured shuffle size say
# it is small, and a hot join key is split by the skew-join rule.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of ids and short texts take some ten times their shuffled bytes in a sort or an
    # aggregate; the default of 64 MB lets one task hold a large part of an executor.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # Else each field of a message becomes a parse of its own, in filters as well.
    "spark.sql.optimizer.enableJsonExpressionOptimization": "false",
}


def build_session(
    app_name: str = "voxcart",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Session with the settings above; cluster sizing stays with the caller."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, read from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; elsewhere a missing
    setting is an error because executors could not reach the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="voxcart-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read on from there.

    Used where recomputation would be wrong or dear: model answers with two
    consumers, and inputs of iterative training.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
