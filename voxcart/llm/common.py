"""What the operators of this package share: white space, scratch tables, names."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

import voxcart
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcart.session import checkpoint_root

# Send the task code along with the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(voxcart)

# White space in the contracts' sense: blank, tab, line feed, vertical tab,
# form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
# Runs that differ from one blank; single blanks need no replacement.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def even_space(text: Column) -> Column:
    """``text`` with each run of white space as one blank; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACE, " ")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Folders made since the innermost scope began.
_FOLDERS: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("folders", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    folder = f"{checkpoint_root(spark)}/voxcart-{name}-{uuid.uuid4()}"
    folders = _FOLDERS.get()
    if folders is not None:
        folders.append(folder)
    return folder


class Scope:
    """The working tables made while a scope is open."""

    def __init__(self) -> None:
        self.folders: list[str] = []
        self.kept: list[str] = []

    def keep(self, table: DataFrame) -> DataFrame:
        """``table``, which ``written`` gave, outlives the scope."""
        self.kept.append(table.scratch_folder)
        return table


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Scope]:
    """Delete the working tables of what runs inside, at the end, also after an error.

    Results are lazy: what is still to be read has to be written elsewhere before the end,
    or kept; kept tables then belong to the scope around this one.
    """
    scope, outer = Scope(), _FOLDERS.get()
    token = _FOLDERS.set(scope.folders)
    try:
        yield scope
    finally:
        _FOLDERS.reset(token)
        if outer is not None:
            outer.extend(scope.kept)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in set(scope.folders).difference(scope.kept):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send at most ``rows`` rows at once to Python.

    For rows with whole texts: a batch is held by the JVM and by the worker at the same time.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read on from there.

    Cuts lineage, so a lost executor costs one task and not the whole history,
    and gives the planner the true size of what follows.
    """
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table.scratch_folder = folder  # for Scope.keep
    return table


def fresh(df: DataFrame, name: str) -> str:
    """A column name based on ``name`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
