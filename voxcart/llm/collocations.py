"""Phrase collocations by stripes.

A prefix of words keys a stripe: a counter of the words that follow it, with one entry for
all that is not told apart (ends of pieces, and words that cannot make a frequent phrase).
Stripes of one prefix are merged element by element, and everything comes from them:

* extensions: entries of at least ``LEAST`` are the frequent phrases one word longer;
* prefix totals: the sum of a stripe is how often its prefix occurs; the stripe of the
  empty prefix has the word counts, and its total is the number of words of a language;
* subsumption maxima: the largest entry that a phrase has as a part of a frequent phrase
  one word longer.  Longer ones need no look, as each holds one of these that is at least
  as frequent.

Levels go from the empty prefix to three words.  A phrase can only be frequent if both
phrases without its last and without its first word are, so each level knows the frequent
phrases of the one before by a bit table of fixed size.  A wrong hit there costs an entry
that counting then finds to be rare; nothing frequent is ever missed.

Tasks count whole portions of text by numbers of words, so a stripe leaves a task once per
portion; stripes of one first word travel in one row.  Where a first word has more than one
in ``SPLIT`` of all words, its rows are split by a hash of their entries, in as many parts as
keep each below that share, and so are those of the empty prefix.  Parts hold different
entries and never meet.  When a part is merged, entries that are too rare for a phrase go
into the one that is not told apart, so tables hold frequent phrases and totals alone.

Defined results: a NULL text counts as empty, a NULL lang as ``und``; repeated rows and rows
without doc_id count like others; an empty table gives no rows; further columns are not
looked at.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxcart.llm.common import arrow_rows, written

LONGEST_PHRASE = 4
LEAST = 30
TOP = 2000
SUBSUMED = 80
SCALE = 2_000_000
# A part of a first word's stripes has about this share of all words, or less; at most so
# many words can have more than one part.
SPLIT = 4096
# Parts of the empty prefix's stripe of a language, and the most that a first word has.
PARTS = 1024
# Bits of the table of frequent phrases; it is sent to all tasks.
BITS = 1 << 24
# Bytes of text that a task counts at once.
PORTION = 6 << 20
# Rows that go to Python at once.
TEXT_ROWS = 1000
# Bytes of text that are cut into words at once.
CUT = 1 << 20

# Lower case for A-Z, a byte that no text has for signs that end a piece.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256)
)
_BORDER = b"\xff"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its beginning and of its last word."""
    return _mix(left * _MULTIPLIER + right)


def _word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64)


class BitTable:
    """Phrases by the bits of their hashes."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes % np.uint64(BITS)
        word = self.words[(slot >> np.uint64(6)).astype(np.int64)]
        return (word >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _bits(frequent: DataFrame) -> np.ndarray:
    """The bit table of phrases of one length: at most ``BITS / 64`` numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases = [p.encode("utf-8").split(b" ") for p in batch.column(0).to_pylist()]
            if phrases:
                whole, *others = (_word_hashes(words) for words in zip(*phrases, strict=True))
                for hashes in others:
                    whole = _joined(whole, hashes)
                slots = (whole % np.uint64(BITS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slots)], ["slot"])

    rows = (
        frequent.select("phrase")
        .mapInArrow(run, "slot long")
        .groupBy(F.shiftright("slot", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits"))
        .toArrow()
    )
    table = np.zeros(BITS // 64, dtype=np.uint64)
    table[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return table


def _numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different words and, for all texts in a row, the number of each word; -1 at borders."""
    numbers: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    numbers[_BORDER]
    flats: list[np.ndarray] = []
    waiting: list[bytes] = []

    def cut() -> None:
        data = b"\n".join(waiting).translate(_TABLE).replace(_BORDER, b" \xff ") + b" \xff"
        # What is left of ASCII white space is blanks and tabs.
        flats.append(np.fromiter(map(numbers.__getitem__, data.split()), dtype=np.int32))
        waiting.clear()

    held = 0
    for text in texts:
        waiting.append(text)
        held += len(text)
        if held > CUT:
            cut()
            held = 0
    cut()
    return list(numbers)[1:], np.concatenate(flats) - 1


def _stripes(
    hashes: np.ndarray, flat: np.ndarray, length: int, table: BitTable | None
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Prefixes (one array of word numbers for each place), next words (-1: any) and counts."""
    if length == 0:
        count = np.bincount(flat[flat >= 0], minlength=len(hashes))
        return [], np.arange(len(hashes)), count
    flat = np.concatenate([flat, np.full(length, -1, dtype=np.int32)])
    # Hash and frequency of the phrase of ``length`` words at each place.
    whole = np.ones(len(flat) - length, dtype=bool)
    for i in range(length):
        whole &= flat[i : len(flat) - length + i] >= 0
    starts = np.flatnonzero(whole)
    phrase = hashes[flat[starts]]
    for i in range(1, length):
        phrase = _joined(phrase, hashes[flat[starts + i]])
    starts = starts[table.holds(phrase)]
    columns = [flat[starts + i] for i in range(length)]
    # The next word counts by itself if the phrase without the first word is frequent too.
    frequent_at = np.zeros(len(flat), dtype=bool)
    frequent_at[starts] = True
    following = np.where(frequent_at[starts + 1], flat[starts + length], np.int32(-1))
    base = len(hashes) + 1
    keys = columns[0].astype(np.int64)
    for c in columns[1:]:
        # Numbers of phrases stay below the number of places.
        _, keys = np.unique(keys * base + c, return_inverse=True)
    _, place, count = np.unique(
        keys * base + following + 1, return_index=True, return_counts=True
    )
    return [c[place] for c in columns], following[place], count


def _as_rows(
    lang: str, words: list[bytes], hashes: np.ndarray, stripes, parts: dict[str, int]
) -> pa.RecordBatch | None:
    """One row per first word and part: ``lang, head, part, entries, counts``.

    An entry has the other words of a prefix and the next word, empty for any; entries of a
    row are lines of one text.
    """
    prefix, following, counts = stripes
    if not len(following):
        return None
    entry = np.zeros(len(following), dtype=np.uint64)
    for c in (*prefix[1:], following):
        entry = _joined(entry, np.where(c >= 0, hashes[c], np.uint64(0)))
    if prefix:
        head = prefix[0].astype(np.int64)
        many = np.ones(len(words), dtype=np.uint64)
        for i, word in enumerate(words):
            n = parts.get(word)
            if n:
                many[i] = n
        part = (entry % many[head]).astype(np.int64)
    else:
        head = np.zeros(len(following), dtype=np.int64)
        part = (entry % np.uint64(PARTS)).astype(np.int64)
    keys = head * PARTS + part
    order = np.argsort(keys, kind="stable")
    keys, following, counts = keys[order], following[order], counts[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
    names = pa.array([w.decode("utf-8") for w in words] + [""], pa.string())
    columns = [
        names.take(pa.array(np.where(c >= 0, c, len(words))))
        for c in (*(p[order] for p in prefix[1:]), following)
    ]
    entries = columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, " ")
    heads = names.take(pa.array(keys[starts] // PARTS if prefix else np.full(len(starts), len(words))))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(starts), pa.string()),
            heads,
            pa.array((keys[starts] % PARTS).astype(np.int32)),
            pc.binary_join(pa.ListArray.from_arrays(offsets, entries), "\n"),
            pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))),
        ],
        ["lang", "head", "part", "entries", "counts"],
    )


def _portions(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about ``PORTION`` bytes at a time."""
    waiting: defaultdict[str, list[bytes]] = defaultdict(list)
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            data = (text.as_py() or "").encode("utf-8")
            waiting[lang.as_py()].append(data)
            held += len(data) + 64
            if held > PORTION:
                while waiting:
                    yield waiting.popitem()
                held = 0
    while waiting:
        yield waiting.popitem()


def stripes(
    docs: DataFrame,
    length: int,
    least: int,
    table: np.ndarray | None = None,
    parts: dict[str, dict[bytes, int]] | None = None,
) -> DataFrame:
    """``lang, prefix, following, n``: merged stripes of prefixes of ``length`` words.

    ``following`` is NULL for all that is not told apart, which a prefix has once per part.
    """
    shared = docs.sparkSession.sparkContext.broadcast((table, parts or {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, many = shared.value
        frequent = None if bits is None else BitTable(bits)

        # A function of its own, so that nothing of a portion is held while the next is counted.
        def rows_of(lang: str, texts: list[bytes]) -> pa.RecordBatch | None:
            words, flat = _numbered(texts)
            hashes = _word_hashes(words)
            counted = _stripes(hashes, flat, length, frequent)
            return _as_rows(lang, words, hashes, counted, many.get(lang, {}))

        for portion in _portions(batches):
            found = rows_of(*portion)
            del portion
            if found is not None:
                yield from (found.slice(at, 2048) for at in range(0, found.num_rows, 2048))
            del found

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(
        run, "lang string, head string, part int, entries string, counts array<long>"
    )
    # Stripes travel whole; their elements are merged where all of a part have met.
    entries = F.arrays_zip(F.split("entries", "\n", -1).alias("entry"), "counts")
    keys = ["lang", "head", "part"]
    merged = (
        rows.repartition(*keys)
        .select(*keys, F.explode(entries).alias("e"))
        .groupBy(*keys, F.col("e.entry").alias("entry"))
        .agg(F.sum("e.counts").alias("n"))
    )
    following = F.substring_index("entry", " ", -1)
    rest = F.expr("left(entry, length(entry) - length(substring_index(entry, ' ', -1)))")
    told_apart = (F.col("n") >= least) & (following != "")
    return (
        merged.select(
            *keys,
            F.rtrim(F.concat("head", F.lit(" "), rest)).alias("prefix"),
            F.when(told_apart, following).alias("following"),
            "n",
        )
        .groupBy(*keys, "prefix", "following")
        .agg(F.sum("n").alias("n"))
        .select("lang", "prefix", "following", "n")
    )


def _parts(words: DataFrame) -> dict[str, dict[bytes, int]]:
    """Parts of the first words that need several; fewer than ``SPLIT`` words do."""
    total = words.agg(F.sum("n")).first()[0] or 0
    many: dict[str, dict[bytes, int]] = {}
    for row in words.where(
        F.col("following").isNotNull() & (F.col("n").cast("decimal(38,0)") * SPLIT > total)
    ).collect():
        n = min(PARTS, -(-row.n * SPLIT // total))
        many.setdefault(row.lang, {})[row.following.encode("utf-8")] = n
    return many


def merged_stripes(docs: DataFrame, longest: int, least: int) -> list[DataFrame]:
    """The stripes of prefixes of 0 to ``longest - 1`` words, each level in a table."""
    levels: list[DataFrame] = []
    table, parts = None, None
    for length in range(longest):
        with arrow_rows(docs.sparkSession, TEXT_ROWS):
            levels.append(written(stripes(docs, length, least, table, parts), f"stripes-{length}"))
        if length == 0:
            parts = _parts(levels[0])
        if length + 1 < longest:
            table = _bits(extensions(levels[length], length, least))
    return levels


def extensions(merged: DataFrame, length: int, least: int) -> DataFrame:
    """``lang, phrase, words, f``: the frequent phrases of ``length + 1`` words."""
    phrase = F.col("following") if length == 0 else F.concat_ws(" ", "prefix", "following")
    return merged.where(F.col("following").isNotNull() & (F.col("n") >= least)).select(
        "lang", phrase.alias("phrase"), F.lit(length + 1).alias("words"), F.col("n").alias("f")
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language."""
    merged = merged_stripes(docs, LONGEST_PHRASE, least)
    totals = merged[0].groupBy("lang").agg(F.sum("n").alias("n"))
    # Prefix totals: how often each phrase of one to three words occurs.
    known = (
        _union(merged[1:])
        .groupBy("lang", "prefix")
        .agg(F.sum("n").alias("f"))
        .where(F.col("f") >= least)
    )
    levels = [extensions(merged[i], i, least) for i in range(1, LONGEST_PHRASE)]
    candidates = _union(levels)

    # The largest entry of a longer phrase: after the phrase, or with a word before it.
    longer = [
        level.select("lang", F.col("f").alias("longer"), shorter.alias("phrase"))
        for level in levels[1:]
        for shorter in (
            F.expr("substring_index(phrase, ' ', words - 1)"),
            F.expr("substring_index(phrase, ' ', 1 - words)"),
        )
    ]
    maxima = _union(longer).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = "decimal(38,0)"
    kept = candidates.join(maxima, ["lang", "phrase"], "left").where(
        F.col("longer").isNull()
        | (F.col("longer").cast(wide) * 100 < F.col("f").cast(wide) * subsumed)
    )

    cuts = kept.select(
        "lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k")
    ).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.expr("substring_index(phrase, ' ', k)").alias("first"),
        F.expr("substring_index(phrase, ' ', k - words)").alias("rest"),
    )
    left = known.toDF("lang", "first", "l")
    right = known.toDF("lang", "rest", "r")
    scored = (
        cuts.join(left, ["lang", "first"])
        .join(right, ["lang", "rest"])
        .withColumn(
            "score",
            F.expr(
                f"(CAST(a AS DECIMAL(20,0)) * {SCALE}) div "
                "(CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"
            ),
        )
    )
    lowest = scored.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (
        lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
    )
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
