"""Token counts from distinct pre-tokens, without any ids.

A byte-level tokenizer cuts a text into pre-tokens and encodes each by itself, so a
document's count is the sum, over its different pre-tokens, of how often each occurs times
how many tokens it has.

1. Vocabulary.  Tasks count the pre-tokens of their documents; an aggregate leaves one row
   per distinct pre-token of the corpus, and the library is asked once for each.
2. Split.  The ``FREQUENT`` pre-tokens of most occurrences go to all tasks as a small
   table: the bound is a number of rows, and keys have at most ``LONGEST`` bytes.  No other
   pre-token can have more than one in ``FREQUENT`` of all occurrences.
3. Join.  Tasks form each document's pre-token frequencies and join them to the small table;
   frequencies of other pre-tokens are shuffled to the table of all.
4. Sum per row.  Rows get a number of their own before the join, so repeated doc_ids and
   rows without one stay apart.

Pre-tokens longer than ``LONGEST`` bytes are known by a digest of 16 bytes; their text is
carried only as far as step 1 needs it.

Texts are first cut before each blank that a visible character follows, which is a border of
pre-tokens whatever stands around it; the vocabulary's own rule then runs once for each
different part that a task meets.

Defined results: a NULL text counts as empty; an empty text has no tokens; the strings of
added tokens inside a text are one token each, as the library has it by default; repeated
rows get a row each; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcart.llm.bpe import PIECES
from voxcart.llm.common import written

LIMIT = 1024
FREQUENT = 100_000
LONGEST = 64
# Different parts that a task remembers, and different pre-tokens that it gathers.
KEPT = 1_000_000
# Pre-tokens that the library gets at once.
ASKED = 4096
# No UTF-8 text begins with this byte.
DIGEST_MARK = b"\xff"

# A blank between a visible character and another; both sides are cut there at once.
_UNEVEN = re.compile(r"  | [^\S ]| \Z")
_BORDER = re.compile(r"(?= \S)")


def parts(text: str) -> list[str]:
    """The text cut before each blank that a visible character follows."""
    if _UNEVEN.search(text):
        return [p for p in _BORDER.split(text) if p]
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + p for p in rest]


def key_of(piece: str) -> bytes:
    data = piece.encode("utf-8")
    if len(data) <= LONGEST:
        return data
    return DIGEST_MARK + hashlib.blake2b(data, digest_size=16).digest()


class PreTokenizer:
    """Cuts texts as a byte-level vocabulary does, with its added tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pattern = regex.compile(PIECES)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        added.sort(key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """How often each part occurs, and the number of added tokens."""
        if not self.added or not self.added.search(text):
            return Counter(parts(text)), 0
        found, stretches = Counter(), self.added.split(text)
        for stretch in stretches:
            found.update(parts(stretch))
        return found, len(stretches) - 1

    def sizes(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        encodings = self.library.encode_batch_fast(pieces, add_special_tokens=False)
        return list(map(len, encodings))


@functools.lru_cache(maxsize=2)
def pre_tokenizer(path: str) -> PreTokenizer:
    return PreTokenizer(path)


def _texts(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[str]:
    for batch in batches:
        for value in batch.column(column):
            yield value.as_py() or ""


def _occurrences(counts: Counter, pattern: regex.Pattern) -> pa.RecordBatch:
    """``key, piece, n``: ``piece`` is NULL where the key is the text itself."""
    pieces: Counter = Counter()
    for part, n in counts.items():
        for piece in pattern.findall(part):
            pieces[piece] += n
    keys = [key_of(p) for p in pieces]
    long = [p if k[:1] == DIGEST_MARK else None for p, k in zip(pieces, keys, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array(long, pa.string()), pa.array(pieces.values(), pa.int64())],
        ["key", "piece", "n"],
    )


def vocabulary(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``key, n, size``: each distinct pre-token, its occurrences and its tokens."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, held = pre_tokenizer(tokenizer), Counter(), 0
        for text in _texts(batches, 0):
            counts.update(own.frequencies(text)[0])
            held += len(text)
            if len(counts) > KEPT // 2 or held > 1 << 28:
                yield _occurrences(counts, own.pattern)
                counts, held = Counter(), 0
        if counts:
            yield _occurrences(counts, own.pattern)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pre_tokenizer(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, ASKED):
                rows = batch.slice(at, ASKED)
                keys, pieces = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                asked = [k.decode("utf-8") if p is None else p for k, p in zip(keys, pieces)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array(own.sizes(asked), pa.int64())],
                    ["key", "n", "size"],
                )

    distinct = (
        docs.select("text")
        .mapInArrow(occurrences, "key binary, piece string, n long")
        .groupBy("key")
        .agg(F.max("piece").alias("piece"), F.sum("n").alias("n"))
        .select("key", "piece", "n")
    )
    return distinct.mapInArrow(sizes, "key binary, n long, size long")


def count(docs: DataFrame, tokenizer: str, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row."""
    spark = docs.sparkSession
    (id_type,) = [f.dataType.simpleString() for f in docs.schema if f.name == "doc_id"]
    sizes = written(vocabulary(docs, tokenizer), "piece-sizes")
    # At most ``frequent`` rows of at most ``LONGEST`` bytes and a number.
    top = sizes.orderBy(F.desc("n"), "key").limit(frequent).select("key", "size").toArrow()
    small = spark.sparkContext.broadcast(
        dict(zip(map(bytes, top.column(0).to_pylist()), top.column(1).to_pylist(), strict=True))
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = pre_tokenizer(tokenizer), small.value
        # Part -> tokens of its frequent pre-tokens, and the keys of the others.
        known: dict[str, tuple[int, tuple[bytes, ...]]] = {}

        def look_up(part: str) -> tuple[int, tuple[bytes, ...]]:
            keys = [key_of(p) for p in own.pattern.findall(part)]
            answer = (
                sum(table[k] for k in keys if k in table),
                tuple(k for k in keys if k not in table),
            )
            if len(part) <= LONGEST:
                if len(known) > KEPT:
                    known.clear()
                known[part] = answer
            return answer

        for batch in batches:
            n_bytes, tokens, keys, times, offsets = [], [], [], [], [0]
            for text in _texts([batch], 2):
                found, total = own.frequencies(text)
                rare: Counter = Counter()
                for part, n in found.items():
                    size, others = known.get(part) or look_up(part)
                    total += n * size
                    for key in others:
                        rare[key] += n
                n_bytes.append(len(text.encode("utf-8")))
                tokens.append(total)
                keys.extend(rare)
                times.extend(rare.values())
                offsets.append(len(keys))
            places = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.ListArray.from_arrays(places, pa.array(keys, pa.binary())),
                    pa.ListArray.from_arrays(places, pa.array(times, pa.int64())),
                ],
                ["row", "doc_id", "n_bytes", "tokens", "keys", "times"],
            )

    rows = written(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
            join,
            f"row long, doc_id {id_type}, n_bytes long, tokens long, "
            "keys array<binary>, times array<long>",
        ),
        "piece-frequencies",
    )
    rare = (
        rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x"))
        .select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
        .join(sizes.select("key", "size"), "key")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("size")).alias("more"))
    )
    n_tokens = F.col("tokens") + F.coalesce("more", F.lit(0))
    return rows.join(rare, "row", "left").select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
