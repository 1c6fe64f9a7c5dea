"""Rows in parts under the folders of a commit log.

A write puts its rows into ``data/commit=<id>`` in order of their parts, with the part as a
column, so a batch is a few files however many parts it touches.  The log names the folders,
how many rows of which part each has, and which of them are live.  A reader opens only
folders with a part that it wants, and of these only row groups whose range of parts fits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxcart.sources.commits import CommitLog, State

PART, COMMIT = "part", "commit"
DATA = "data"


@dataclass(frozen=True)
class PartedTable:
    """A folder of rows with ``schema``, in parts that ``part`` names."""

    spark: SparkSession
    path: str
    schema: T.StructType
    part: Column

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, self.path)

    def read(
        self, wanted: Callable[[str], bool] | None = None, number: int | None = None
    ) -> DataFrame:
        """Live rows, of the parts whose names are wanted, now or at a commit."""
        return self._rows(self.log.state(number), wanted).select(*self.schema.fieldNames())

    def _typed(self, rows: DataFrame) -> DataFrame:
        """The columns of the table, in its types."""
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))

    def _part(self) -> Column:
        return F.coalesce(self.part.cast("string"), F.lit("none"))

    def _rows(self, state: State, wanted: Callable[[str], bool] | None = None) -> DataFrame:
        """Live rows with ``commit`` and ``part``."""
        folders, gone, parts = [], [], set()
        for folder, entry in state.live.items():
            if entry["kind"] != DATA:
                continue
            own = [p for p in entry["rows"] if wanted is None or wanted(p)]
            if own:
                folders.append(folder)
                parts.update(own)
                gone += [f"{folder.rpartition('=')[2]}/{p}" for p in entry["gone"]]
        whole = T.StructType([*self.schema.fields]).add(PART, "string").add(COMMIT, "string")
        if not folders:
            return self.spark.createDataFrame([], whole)
        rows = (
            self.spark.read.schema(whole)
            .option("basePath", f"{self.path}/{DATA}")
            .parquet(*(f"{self.path}/{f}" for f in folders))
        )
        if wanted is not None:
            rows = rows.where(F.col(PART).isin(*sorted(parts)))
        if gone:
            rows = rows.where(~F.concat_ws("/", COMMIT, PART).isin(*gone))
        return rows

    def _write(self, rows: DataFrame) -> dict | None:
        """Rows with ``part`` to a new folder; its entry, or None if there are no rows."""
        folder = f"{DATA}/{COMMIT}={uuid.uuid4()}"
        rows.sortWithinPartitions(PART).write.parquet(f"{self.path}/{folder}")
        return self._entry(folder)

    def _entry(self, folder: str) -> dict | None:
        counts = self.spark.read.schema(f"{PART} string").parquet(f"{self.path}/{folder}")
        rows = {r[PART]: r["count"] for r in counts.groupBy(PART).count().collect()}
        return {"folder": folder, "kind": DATA, "rows": rows, "gone": []} if rows else None

    @staticmethod
    def _without(state: State, parts: set[str]) -> tuple[list[dict], list[str]]:
        """What to add and to remove so that the live folders no longer hold some parts."""
        add, remove = [], []
        for folder, entry in state.live.items():
            rest = {p: n for p, n in entry["rows"].items() if p not in parts}
            if not rest:
                remove.append(folder)
            elif len(rest) < len(entry["rows"]):
                gone = sorted({*entry["gone"], *entry["rows"]}.difference(rest))
                add.append({**entry, "rows": rest, "gone": gone})
        return add, remove

    def _folder(self, entry: dict) -> DataFrame:
        """The rows of one folder, whether committed or not, with ``commit`` and ``part``."""
        return self._rows(State(live={entry["folder"]: entry}))

    def vacuum(self, keep: int = 1, older_than: float = 86_600.0) -> list[str]:
        """Delete folders of lost attempts and of versions before the last ``keep``."""
        return self.log.vacuum(keep, older_than)
