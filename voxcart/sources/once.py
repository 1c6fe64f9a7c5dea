"""Append-only tables that take a row once, whatever is delivered, retried or replayed.

Rows have an identity and lie in parts (an hour, a bucket).  ``admit`` writes a batch aside,
learns which of its identities the table may hold already, drops those that it does hold,
and commits the folders in one step.  A batch that ended before its commit has left nothing
that readers see; a batch of a source that was committed before is not run again.

What a part may hold is known by Bloom filters, written beside the rows: about ten bits for
an identity, in pieces of a bounded number of identities.  Only identities that hit a filter
are looked up in the rows, so a batch without copies reads no row of the table.

Batches leave small files with rows of few parts each.  ``compact`` packs them into files of
about a target size that hold neighbouring parts; the commit that adds the new ones takes
out the old ones, so every reader sees each row once.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import voxcart
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxcart.session import materialize
from voxcart.sources.commits import Conflict, State
from voxcart.sources.parts import COMMIT, DATA, PART, PartedTable

# Send the task code along with the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(voxcart)

FILTERS = "filters"
HASHES = 7
BITS_EACH = 10
# Identities in one piece of a filter, and slots of a part that are checked apart.
PIECE = 1 << 20
SLOTS = 16
TARGET_BYTES = 128 << 20

_PIECES = "part string, slot int, h long, bits binary"


def _positions(hashes: np.ndarray, size: int) -> np.ndarray:
    """``HASHES`` places for each hash in a filter of ``size`` bits, a power of two."""
    whole = hashes.view(np.uint64)
    step = (whole >> np.uint64(32)) | np.uint64(1)
    turns = np.arange(HASHES, dtype=np.uint64)[:, None]
    return ((whole + turns * step) & np.uint64(size - 1)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    """A filter of 64-bit hashes; its size follows from their number."""
    size = 1 << max(10, int(BITS_EACH * len(hashes) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[_positions(hashes, size)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(filter_bytes: bytes, hashes: np.ndarray) -> np.ndarray:
    data = np.frombuffer(filter_bytes, dtype=np.uint8)
    places = _positions(hashes, 8 * len(data))
    return ((data[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``part, slot, h`` to filters of at most ``PIECE`` identities."""
    held: dict[tuple, list[np.ndarray]] = {}
    counts: dict[tuple, int] = {}

    def piece(key: tuple) -> pa.RecordBatch:
        hashes = np.concatenate(held.pop(key))
        counts.pop(key)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key[0]], pa.string()),
                pa.array([key[1]], pa.int32()),
                pa.array([None], pa.int64()),
                pa.array([bloom(hashes)], pa.binary()),
            ],
            ["part", "slot", "h", "bits"],
        )

    for batch in batches:
        for key, hashes in _runs(batch):
            held.setdefault(key, []).append(hashes)
            counts[key] = counts.get(key, 0) + len(hashes)
            if counts[key] >= PIECE:
                yield piece(key)
    for key in list(held):
        yield piece(key)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    """The hashes of each part and slot of a batch."""
    parts = batch.column(0).dictionary_encode()
    slots = batch.column(1).to_numpy()
    codes = parts.indices.to_numpy().astype(np.int64) * SLOTS + slots
    hashes = batch.column(2).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    codes, hashes = codes[order], hashes[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    for low, high in zip(starts, [*starts[1:], len(codes)], strict=True):
        name = parts.dictionary[int(codes[low]) // SLOTS].as_py()
        yield (name, int(codes[low]) % SLOTS), hashes[low:high]


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part and slot, filters before hashes: the hashes that hit."""
    at, filters = None, []
    for batch in batches:
        known = batch.column(3)
        rows = pa.RecordBatch.from_arrays(batch.columns[:3], batch.schema.names[:3])
        is_filter = known.is_valid().to_numpy(zero_copy_only=False)
        parts, slots = batch.column(0), batch.column(1)
        # Runs of hashes of one part and slot; each filter is a run of its own.
        codes = parts.dictionary_encode().indices.to_numpy().astype(np.int64) * SLOTS + slots.to_numpy()
        changes = np.diff(codes, prepend=-1) != 0
        changes |= is_filter
        changes[1:] |= is_filter[:-1]
        starts = np.flatnonzero(changes).tolist()
        for place, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = parts[place].as_py(), slots[place].as_py()
            if key != at:
                at, filters = key, []
            if is_filter[place]:
                filters.append(known[place].as_py())
                continue
            hashes = rows.column(2).slice(place, end - place).to_numpy(zero_copy_only=False)
            hit = np.zeros(len(hashes), dtype=bool)
            for known_bits in filters:
                hit |= may_hold(known_bits, hashes)
            if hit.any():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key[0]] * int(hit.sum()), pa.string()),
                        pa.array(hashes[hit], pa.int64()),
                    ],
                    ["part", "h"],
                )


@dataclass(frozen=True)
class OnceTable(PartedTable):
    """Rows known by ``identity``, which like ``part`` is made of their columns."""

    identity: Column

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("row_identity", self.identity)

    def _hashes(self, entry: dict) -> DataFrame:
        """``part, slot, h`` of the rows of a folder."""
        h = F.xxhash64("row_identity")
        return self._keyed(self._folder(entry)).select(
            PART, F.pmod(h, F.lit(SLOTS)).cast("int").alias("slot"), h.alias("h")
        )

    def _write_filters(self, entry: dict) -> dict:
        folder = f"{FILTERS}/{uuid.uuid4()}"
        built = self._hashes(entry).mapInArrow(_build, _PIECES)
        built.sortWithinPartitions(PART).write.parquet(f"{self.path}/{folder}")
        return {"folder": folder, "kind": FILTERS, "rows": entry["rows"], "gone": []}

    def _hits(self, state: State, entry: dict) -> DataFrame | None:
        """``part, h`` of identities that the table may hold; None if no filter can know them."""
        parts = set(entry["rows"])
        filters = [
            f"{self.path}/{folder}"
            for folder, e in state.live.items()
            if e["kind"] == FILTERS and parts.intersection(e["rows"])
        ]
        if not filters:
            return None
        known = (
            self.spark.read.schema(_PIECES).parquet(*filters).where(F.col(PART).isin(*sorted(parts)))
        )
        rows = self._hashes(entry).select(PART, "slot", "h", F.lit(None).cast("binary").alias("bits"))
        together = (
            known.unionByName(rows)
            .repartition(PART, "slot")
            .sortWithinPartitions(PART, "slot", F.col("bits").isNull())
        )
        return together.mapInArrow(_probe, "part string, h long")

    def _held(self, state: State, hits: DataFrame) -> DataFrame | None:
        """``part, row_identity`` of rows that the table holds, among the hits; None if none hit."""
        found = materialize(hits.distinct())
        parts = {r.part for r in found.select(PART).distinct().collect()}
        if not parts:
            return None
        rows = self._keyed(self._rows(state, parts.__contains__))
        held = rows.select(PART, "row_identity", F.xxhash64("row_identity").alias("h"))
        return held.join(found, [PART, "h"], "left_semi").select(PART, "row_identity").distinct()

    def admit(
        self,
        batch: DataFrame,
        source: str | None = None,
        batch_id: int | None = None,
        order: list[Column] | None = None,
    ) -> State:
        """Append the rows of ``batch`` that the table lacks; of equal identities the first stays.

        ``order`` says which copy is the first.  A batch of ``source`` that is not after the
        last committed one does nothing.
        """
        log, columns = self.log, self.schema.fieldNames()
        state = log.state()
        if source is not None and batch_id <= state.batches.get(source, -1):
            return state
        first = F.struct(*order) if order else F.xxhash64(*self._sortable())
        rows = self._typed(batch).select("*", self._part().alias(PART))
        entry = self._write(
            self._keyed(rows)
            .groupBy(PART, "row_identity")
            .agg(F.min_by(F.struct(*columns), first).alias("row"))
            .select("row.*", PART)
        )
        checked = 0
        while True:
            # After a conflict only what others have added meanwhile is new.
            later = State(live={f: e for f, e in state.live.items() if e["number"] > checked})
            hits = self._hits(later, entry) if entry else None
            held = None if hits is None else self._held(state, hits)
            if held is not None:
                fresh = self._keyed(self._folder(entry)).join(held, [PART, "row_identity"], "left_anti")
                entry = self._write(fresh.select(*columns, PART))
            add = [entry, self._write_filters(entry)] if entry else []
            try:
                return log.commit(state, self._stamped(add, state), (), source, batch_id)
            except Conflict:
                checked, state = state.number, log.state()
                if source is not None and batch_id <= state.batches.get(source, -1):
                    return state

    @staticmethod
    def _stamped(entries: list[dict], state: State) -> list[dict]:
        """Entries with the number of the commit that brings them."""
        return [{**e, "number": state.number + 1} for e in entries]

    def _sortable(self) -> list[str]:
        return [f.name for f in self.schema if not isinstance(f.dataType, T.VariantType)]

    # Upkeep

    def compact(self, target_bytes: int = TARGET_BYTES, least_folders: int = 2) -> State:
        """Pack the rows of small folders into files of about ``target_bytes``.

        Small are folders whose files have on average less than half of that.  Their parts go
        into packs in order, each pack up to the target, by what their rows take on average;
        a part that is larger than a pack is dealt over several.  Filters are built anew.
        """
        log, columns = self.log, self.schema.fieldNames()
        while True:
            state = log.state()
            small, total = self._small(state, target_bytes)
            if len(small) < least_folders:
                return state
            rows: Counter = Counter()
            for folder in small:
                rows.update(state.live[folder]["rows"])
            packs = self._packs(rows, total / sum(rows.values()), target_bytes)
            places = self.spark.createDataFrame(packs, "part string, first int, packs int")
            chosen = State(live={f: state.live[f] for f in small})
            spread = F.pmod(F.xxhash64(*self._sortable()), F.col("packs")).cast("int")
            packed = (
                self._rows(chosen)
                .join(places, PART)
                .withColumn("pack", F.col("first") + spread)
                # The pack is the task: by its hash several packs would meet in one.
                .repartitionById(max(f + n for _, f, n in packs), F.col("pack"))
                .sortWithinPartitions("pack", PART)
            )
            entry = self._write_sorted(packed.select(*columns, PART))
            add = self._stamped([entry, self._write_filters(entry)], state)
            # Filters of folders that are packed go when nothing else they know of is left.
            others = [e for f, e in state.live.items() if e["kind"] == DATA and f not in chosen.live]
            remove = list(small)
            if not others:
                remove += [f for f, e in state.live.items() if e["kind"] == FILTERS]
            try:
                return log.commit(state, add, remove)
            except Conflict:
                continue

    def _write_sorted(self, rows: DataFrame) -> dict:
        folder = f"{DATA}/{COMMIT}={uuid.uuid4()}"
        rows.write.parquet(f"{self.path}/{folder}")
        return self._entry(folder)

    def _small(self, state: State, target_bytes: int) -> tuple[list[str], int]:
        """Folders of small files, and their bytes."""
        data = [f for f, e in state.live.items() if e["kind"] == DATA]
        if not data:
            return [], 0
        listing = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet")
            .load([f"{self.path}/{f}" for f in data])
            .groupBy(F.element_at(F.split("path", "/"), -2).alias("folder"))
            .agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))
        )
        small = {
            f"{DATA}/{r.folder}": r.bytes
            for r in listing.collect()
            if r.bytes < r.files * target_bytes / 2
        }
        return [f for f in data if f in small], sum(small.values())

    @staticmethod
    def _packs(rows: dict[str, int], each: float, target_bytes: int) -> list[tuple[str, int, int]]:
        """``part, first pack, packs``: parts in order, next fit."""
        out, pack, room = [], 0, float(target_bytes)
        for part in sorted(rows):
            size = rows[part] * each
            if size > room and room < target_bytes:
                pack, room = pack + 1, float(target_bytes)
            needed = max(1, -(-int(size) // target_bytes))
            out.append((part, pack, needed))
            if needed > 1:
                pack, room = pack + needed, float(target_bytes)
            else:
                room -= size
        return out
