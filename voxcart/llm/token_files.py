"""Token ids as Arrow files of equal-length sequences.

Documents are dealt into ranges of doc_id, sorted inside a range, encoded, and ended
by an end id.  The ids of a range run on without gaps through sequences of ``LENGTH``
ids.  A range becomes two files in the Arrow file format (record batches with a
footer of their offsets):

* ``*.ids.arrow``: ``ids`` and ``mask``, fixed-size lists of ``LENGTH`` numbers and of
  ``LENGTH`` bits; every batch but the last has ``BATCH`` sequences, so sequence ``i``
  lies in batch ``i // BATCH`` at row ``i % BATCH`` and is a slice of the mapped file.
  Only the last sequence of a file has padding, where the mask is false.  Ids take two
  bytes if the vocabulary allows, else four.
* ``*.index.arrow``: ``doc_id, start, n_tokens`` of each document in the file.

File names are new for each attempt of a task.  The manifest, a table that Spark
commits, names the files of the attempts that succeeded; those of lost attempts are
never read.  A document's place in the whole is its place in the file plus the ids of
all files before it, a running sum over one row per file.

The folder has to be one that pyarrow's file systems reach from every executor.

Defined results: a NULL text counts as empty and gives the end id alone; rows without
doc_id come first; repeated rows are written each; an empty table gives no rows;
further columns are not looked at.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxcart.llm.common import scratch, written

LENGTH = 2048
BATCH = 64
PAD = 0
# Words whose ids a task remembers.
KEPT = 1_000_000
LONGEST_KEPT = 64

# The rules of word vocabularies of this kind, as their files state them.
# For words of printable ASCII signs they come to lower case and ``ASCII_WORD``.
WORD_RULES = (
    {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {
                    "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
                },
                "behavior": "Removed",
                "invert": True,
            },
            {
                "type": "ByteLevel",
                "add_prefix_space": False,
                "trim_offsets": True,
                "use_regex": False,
            },
        ],
    },
)
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class WordEncoder:
    """The library's normalizer, pre-tokenizer and model, each asked once for what is new.

    Right for vocabularies whose pieces never hold white space: the ids of a text are then
    those of its words, one after another, and those of a word are those of its pre-tokens.
    Ids are kept by word and by pre-token, so ``Word``, ``word,`` and ``word`` share the
    model's answer.
    """

    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        top = max(vocabulary.values())
        self.type = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.code = "H" if top < 1 << 16 else "I"
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        spec = json.loads(self.library.to_str())
        self.plain = (spec["normalizer"], spec["pre_tokenizer"]) == WORD_RULES
        self.kept = kept
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def pre_tokens(self, word: str) -> list[str]:
        if self.plain and word.isascii() and word.isprintable():
            return ASCII_WORD.findall(word.lower())
        library = self.library
        if library.normalizer:
            word = library.normalizer.normalize_str(word)
        return [p for p, _ in library.pre_tokenizer.pre_tokenize_str(word)]

    def of_piece(self, piece: str) -> bytes:
        ids = self.ids_of(t.id for t in self.library.model.tokenize(piece))
        if len(piece) <= LONGEST_KEPT:
            self.pieces[piece] = ids
        return ids

    def ids_of(self, numbers: Iterable[int]) -> bytes:
        return array.array(self.code, numbers).tobytes()

    def ask(self, data: bytes) -> bytes:
        """The ids of a word that is not known."""
        word = data.decode("utf-8")
        if self.added and self.added.search(word):
            return self.ids_of(self.library.encode(word, add_special_tokens=False).ids)
        known = self.pieces
        return b"".join([known.get(p) or self.of_piece(p) for p in self.pre_tokens(word)])

    def encode(self, texts: list[str]) -> list[bytes]:
        # bytes.split() cuts at ASCII white space only.
        words = [t.encode("utf-8").split() for t in texts]
        if len(self.known) > self.kept:
            self.known.clear()
        if len(self.pieces) > self.kept:
            self.pieces.clear()
        answers = {w: self.ask(w) for w in set().union(*words).difference(self.known)}
        long = {w: ids for w, ids in answers.items() if len(w) > LONGEST_KEPT}
        self.known.update(answers)
        out = [b"".join(map(self.known.__getitem__, w)) for w in words]
        for w in long:
            del self.known[w]
        return out


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def ids_schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema(
        [
            ("ids", pa.list_(pa.from_numpy_dtype(kind), length)),
            ("mask", pa.list_(pa.bool_(), length)),
        ]
    )


class SequenceWriter:
    """Cuts a run of ids into sequences and writes them batch by batch."""

    def __init__(self, sink, kind: np.dtype, length: int):
        self.kind, self.length = kind, length
        self.schema = ids_schema(kind, length)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[bytes] = []
        self.size = 0
        self.total = 0

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.size += len(ids) // self.kind.itemsize
        self.total += len(ids) // self.kind.itemsize
        if self.size >= BATCH * self.length:
            self.flush(self.size - self.size % (BATCH * self.length))

    def flush(self, count: int) -> None:
        flat = np.frombuffer(b"".join(self.waiting), dtype=self.kind)
        for at in range(0, count, BATCH * self.length):
            self.write(flat[at : min(count, at + BATCH * self.length)])
        rest = flat[count:]
        self.waiting, self.size = [rest.tobytes()], len(rest)

    def write(self, ids: np.ndarray) -> None:
        padding = -len(ids) % self.length
        mask = np.ones(len(ids) + padding, dtype=bool)
        if padding:
            mask[len(ids) :] = False
            ids = np.concatenate([ids, np.full(padding, PAD, dtype=self.kind)])
        lists = [
            pa.FixedSizeListArray.from_arrays(pa.array(values), self.length)
            for values in (ids, mask)
        ]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.size:
            self.flush(self.size)
        self.file.close()


def write(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, length: int = LENGTH
) -> DataFrame:
    """Write the files; returns the manifest: ``part, ids_file, index_file, n_ids, n_docs``."""
    folder = folder or scratch(docs.sparkSession, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        base = f"{folder}/part-{part:06d}-{uuid.uuid4()}"
        names = f"{base}.ids.arrow", f"{base}.index.arrow"
        system, place = _place(folder)
        system.create_dir(place, recursive=True)
        index_schema = pa.schema(
            [("doc_id", first.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())]
        )
        encoder, n_docs = word_encoder(tokenizer), 0
        end = np.array([end_id], dtype=encoder.type).tobytes()
        with (
            system.open_output_stream(_place(names[0])[1]) as ids_sink,
            system.open_output_stream(_place(names[1])[1]) as index_sink,
            pa.ipc.new_file(index_sink, index_schema) as index,
        ):
            out = SequenceWriter(ids_sink, encoder.type, length)
            batch = first
            while batch is not None:
                for at in range(0, batch.num_rows, 256):
                    rows = batch.slice(at, 256)
                    encoded = encoder.encode([t or "" for t in rows.column(1).to_pylist()])
                    starts = []
                    for ids in encoded:
                        starts.append(out.total)
                        out.add(ids + end)
                    index.write_batch(
                        pa.RecordBatch.from_arrays(
                            [
                                rows.column(0),
                                pa.array(starts, pa.int64()),
                                pa.array(
                                    [len(e) // encoder.type.itemsize + 1 for e in encoded], pa.int64()
                                ),
                            ],
                            schema=index_schema,
                        )
                    )
                    n_docs += rows.num_rows
                batch = next(batches, None)
            out.close()
        yield pa.RecordBatch.from_pydict(
            {
                "part": [part],
                "ids_file": [names[0]],
                "index_file": [names[1]],
                "n_ids": [out.total],
                "n_docs": [n_docs],
            }
        )

    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return written(
        ordered.mapInArrow(
            run, "part long, ids_file string, index_file string, n_ids long, n_docs long"
        ),
        "token-manifest",
    )


class TokenFile:
    """Random access to the sequences of one file; local files are mapped, not read."""

    def __init__(self, path: str):
        system, place = _place(path)
        local = isinstance(system, pyarrow.fs.LocalFileSystem)
        self.source = pa.memory_map(place) if local else system.open_input_file(place)
        self.reader = pa.ipc.open_file(self.source)

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids (a view) and mask of each batch, flat."""
        for k in range(self.reader.num_record_batches):
            ids, mask = self.reader.get_batch(k).columns
            yield ids.flatten().to_numpy(), mask.flatten().to_numpy(zero_copy_only=False)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``i``, both views of the file."""
        ids, mask = self.reader.get_batch(i // BATCH).columns
        row = i % BATCH
        return ids.slice(row, 1).flatten().to_numpy(), mask.slice(row, 1).flatten()

    def close(self) -> None:
        self.source.close()


def _document_sums(ids_file: str, index_file: str) -> Iterator[pa.RecordBatch]:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents in one pair of files."""
    ids, index = TokenFile(ids_file), TokenFile(index_file)
    stream = (values[mask].astype("<u4") for values, mask in ids.batches())
    block, used = np.empty(0, dtype="<u4"), 0
    for k in range(index.reader.num_record_batches):
        batch = index.reader.get_batch(k)
        sums = []
        for left in batch.column(2).to_pylist():
            crc = 0
            while left:
                if used == len(block):
                    block, used = next(stream), 0
                taken = block[used : used + left]
                crc = zlib.crc32(taken, crc)
                used += len(taken)
                left -= len(taken)
            sums.append(crc)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )
    ids.close()
    index.close()


def read_documents(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, from the files alone."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = written(
        manifest.select(
            "ids_file",
            "index_file",
            F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("ids_before"),
        ),
        "token-offsets",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for found in _document_sums(row["ids_file"], row["index_file"]):
                    starts = pa.compute.add(found.column(1), row["ids_before"])
                    yield found.set_column(1, "start", starts)

    # A task for each file.
    return files.repartition(max(1, files.count())).mapInArrow(
        run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    )
