"""Tables that are replaced or merged as a whole version, while readers keep theirs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxcart.sources.commits import CommitLog, Conflict, State
from voxcart.sources.parts import PART, PartedTable


@dataclass(frozen=True)
class VersionedTable:
    """A table that a query replaces: a folder per version, and a commit that points to it.

    A new version is written beside the old one, so a table may be built from itself, and a
    reader's files stay until ``expire`` takes versions away.
    """

    spark: SparkSession
    path: str

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, self.path)

    def replace(self, df: DataFrame, **options: str) -> State:
        log = self.log
        top = f"data/{uuid.uuid4()}"
        df.write.options(**options).parquet(f"{self.path}/{top}")
        entry = {"folder": top, "kind": "version", "schema": df.schema.jsonValue()}
        while True:
            state = log.state()
            try:
                return log.commit(state, [entry], list(state.live))
            except Conflict:
                continue  # the last writer's version counts

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the current version, or of the one at ``number``."""
        state = self.log.state(number)
        if not state.live:
            raise FileNotFoundError(f"{self.path} has no version yet")
        ((folder, entry),) = state.live.items()
        schema = T.StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def expire(self, keep: int = 2, older_than: float = 0.0) -> list[str]:
        """Delete all versions but the last ``keep``, and what failed writers left."""
        return self.log.vacuum(keep, older_than)


@dataclass(frozen=True)
class MergedTable(PartedTable):
    """Rows by key in parts: a batch of changed rows rewrites only the parts that it touches."""

    keys: tuple[str, ...]

    def merge(
        self, changed: DataFrame, source: str | None = None, batch_id: int | None = None
    ) -> State:
        """Put ``changed`` in the place of the rows with the same keys; NULL keys are equal.

        A batch of ``source`` that is not after the last committed one does nothing.
        """
        log, columns = self.log, self.schema.fieldNames()
        staged = self._write(self._typed(changed).select("*", self._part().alias(PART)))
        while True:
            state = log.state()
            if source is not None and batch_id <= state.batches.get(source, -1):
                return state
            add, remove = [], []
            if staged is not None:
                parts = set(staged["rows"])
                add, remove = self._without(state, parts)
                entry = staged
                if any(parts.intersection(e["rows"]) for e in state.live.values()):
                    new = self._folder(staged)
                    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
                    kept = self._rows(state, parts.__contains__).alias("o").join(
                        new.alias("n"), same, "left_anti"
                    )
                    entry = self._write(kept.unionByName(new).select(*columns, PART))
                add.append(entry)
            try:
                return log.commit(state, add, remove, source, batch_id)
            except Conflict:
                continue  # what others changed is merged into their rows

    def expire(self, keep: int = 2, older_than: float = 0.0) -> list[str]:
        return self.log.vacuum(keep, older_than)
