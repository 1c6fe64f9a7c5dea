"""How far the sources of a language diverge, and by which terms.

Every (lang, source) group, and every language, gives each kept term of the language (one in
at least ``LEAST_DOCS`` of its documents) a smoothed share of its terms in billionths.  Two
questions are answered: how far a group is from each other source of its language (sum of
differences over all kept terms), and which terms it has most in excess of its language.

Terms by a dominance skyband.  The excess of a term rises with its count in the group and
falls with its count in the language, and ties go to the earlier term in UTF-8.  So a term
that ``TERMS`` others dominate (at least its group count, at most its language count, an
earlier name) is not among the first ``TERMS``, whatever the shares turn out to be.  Tasks
retain the terms of each group that fewer others dominate; what they retain is merged in the
same way, in slots of a group, and only what is left is ranked exactly.  Members of a
skyband are dominated by members alone often enough, so dropping others early is safe.
Tasks hold at most ``HELD`` rows, and hand on what they cannot hold.

Differences by blocks.  A kept term has one row with its counts by source, as a sparse list;
a task lays such rows out as numbers by term and source, with the share of a count of
zero elsewhere, and adds up differences of a block of sources against all sources of the
language.  The result has a row for each two sources of a language, so their number is
taken to fit a list.

Counts go to decimals before they are multiplied, so no product overflows.

Defined results: NULL texts, languages and sources count as empty strings; a group without
kept terms has the shares of counts of zero; a language without kept terms has differences of
zero; repeated rows and rows without doc_id count like others; an empty table gives no
rows; further columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcart.llm.common import written

LEAST_DOCS = 30
TERMS = 50
SMOOTH = 5
BILLION = 1_000_000_000
# Sources of a block, and tasks that share the terms of a language and block.
BLOCK = 512
SLOTS = 64
# Distinct terms that a task gathers, rows of a group that are compared at once, rows held.
KEPT = 500_000
CHUNK = 8192
HELD = 500_000
# Rows against which all others are compared first.
STRONG = 512

# Lower case for A-Z, blank for all other ASCII signs but a-z.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents with the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: defaultdict[tuple, Counter] = defaultdict(Counter)
        documents: defaultdict[tuple, Counter] = defaultdict(Counter)
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in occurrences.items():
                size = len(counts)
                terms = [t.decode("utf-8") for t in counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * size, pa.string()),
                        pa.array([source] * size, pa.string()),
                        pa.array(terms, pa.string()),
                        pa.array(counts.values(), pa.int64()),
                        pa.array(map(documents[lang, source].__getitem__, counts), pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
            occurrences.clear()
            documents.clear()

        for batch in batches:
            for lang, source, text in zip(*batch.columns, strict=True):
                group = lang.as_py(), source.as_py()
                words = text.as_py().encode("utf-8").translate(_TABLE).split()
                mine = occurrences[group]
                held -= len(mine)
                mine.update(words)
                held += len(mine)
                documents[group].update(set(words))
                if held > KEPT:
                    yield from rows()
                    held = 0
        yield from rows()

    return (
        docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def share(count: str, total: str, terms: str = "terms") -> Column:
    """``1 + floor(10**9 * (count + 5) / (total + 5 * terms))``; NULL without terms."""
    under = f"(CAST({total} AS DECIMAL(20,0)) + {SMOOTH} * CAST({terms} AS DECIMAL(20,0)))"
    over = f"(CAST({BILLION} AS DECIMAL(10,0)) * (CAST({count} AS DECIMAL(20,0)) + {SMOOTH}))"
    return F.expr(f"1 + {over} div nullif({under}, 0)")


def skyband(
    group_counts: np.ndarray, lang_counts: np.ndarray, terms: list[bytes], k: int = TERMS
) -> np.ndarray:
    """Places of the rows that fewer than ``k`` others dominate."""
    names = np.empty(len(terms), dtype=np.int64)
    names[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
    # Whatever dominates a row comes before it in this order.
    order = np.lexsort((names, lang_counts, -group_counts))
    lows, names = lang_counts[order], names[order]
    strong = slice(0, STRONG)
    hits = np.zeros(len(order), dtype=np.int64)
    for at in range(0, len(order), 1024):
        part = slice(at, at + 1024)
        below = (lows[None, strong] <= lows[part, None]) & (names[None, strong] < names[part, None])
        before = np.arange(len(lows[strong]))[None, :] < np.arange(at, at + len(lows[part]))[:, None]
        hits[part] = (below & before).sum(axis=1)
    left = np.flatnonzero(hits < k)
    lows, names = lows[left], names[left]
    kept = np.zeros(len(left), dtype=bool)
    kept_lows, kept_names = np.empty_like(lows), np.empty_like(names)
    size = 0
    for i in range(len(left)):
        above = (kept_lows[:size] <= lows[i]) & (kept_names[:size] < names[i])
        if size < k or np.count_nonzero(above) < k:
            kept[i] = True
            kept_lows[size], kept_names[size] = lows[i], names[i]
            size += 1
    return order[left[kept]]


_SKY = "lang string, source string, term string, n long, lang_n long"
_SKY_NAMES = ["lang", "source", "term", "n", "lang_n"]


def _retain(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's part: the skyband of each group, as far as it can be held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[tuple, list[tuple]] = defaultdict(list)
        total = 0

        def pruned(rows: list[tuple]) -> list[tuple]:
            terms, n, lang_n = zip(*rows, strict=True)
            stay = skyband(np.array(n), np.array(lang_n), [t.encode("utf-8") for t in terms], k)
            return [rows[i] for i in stay]

        def out(group: tuple, rows: list[tuple]) -> pa.RecordBatch:
            terms, n, lang_n = zip(*rows, strict=True)
            lang, source = ([x] * len(rows) for x in group)
            return pa.RecordBatch.from_arrays(
                [
                    *(pa.array(c, pa.string()) for c in (lang, source, terms)),
                    *(pa.array(c, pa.int64()) for c in (n, lang_n)),
                ],
                _SKY_NAMES,
            )

        for batch in batches:
            for lang, source, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = held[lang, source]
                rows.append(tuple(row))
                total += 1
                if len(rows) >= CHUNK:
                    stay = pruned(rows)
                    total -= len(rows)
                    if 2 * len(stay) > CHUNK:
                        yield out((lang, source), stay)
                        stay = []
                    held[lang, source] = stay
                    total += len(stay)
                if total > HELD:
                    for group, rows in held.items():
                        if rows:
                            yield out(group, pruned(rows))
                    held.clear()
                    total = 0
        for group, rows in held.items():
            if rows:
                yield out(group, pruned(rows))

    return run


def _sum_differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, i, j, value`` of rows ``lang, block, base, entries`` in order of lang and block."""
    at, sums, base = None, None, None

    def rows() -> Iterator[pa.RecordBatch]:
        first = at[1] * BLOCK
        for i, row in enumerate(sums):
            j = np.arange(len(row))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([at[0]] * len(row), pa.string()),
                    pa.array(np.full(len(row), first + i)),
                    pa.array(j),
                    pa.array(row),
                ],
                ["lang", "i", "j", "value"],
            )

    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        for first, last in zip(starts, [*starts[1:], len(keys)], strict=True):
            if keys[first] != at:
                if at is not None:
                    yield from rows()
                at = keys[first]
                base = np.array(batch.column(2)[first].as_py(), dtype=np.int64)
                sums = np.zeros((min(BLOCK, len(base) - at[1] * BLOCK), len(base)), dtype=np.int64)
            step = max(1, (1 << 20) // len(base))
            for low in range(first, last, step):
                part = batch.column(3).slice(low, min(step, last - low))
                shares = np.tile(base, (len(part), 1))
                for r, entries in enumerate(part):
                    values = entries.values
                    shares[r, values.field(0).to_numpy()] = values.field(1).to_numpy()
                for i in range(len(sums)):
                    mine = shares[:, at[1] * BLOCK + i, None]
                    sums[i] += np.abs(shares - mine).sum(axis=0)
    if at is not None:
        yield from rows()


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: parts ``pair`` and ``term`` of each group."""
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    all_counts = written(term_counts(texts), "audit-counts")
    kept = written(
        all_counts.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
        .where(F.col("docs") >= least_docs)
        .select("lang", "term", "lang_n"),
        "audit-terms",
    )
    counts = written(
        all_counts.select("lang", "source", "term", "n")
        .join(kept, ["lang", "term"])
        .select(*_SKY_NAMES),
        "audit-kept",
    )
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    by_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = written(
        texts.select("lang", "source")
        .distinct()
        .join(by_group, ["lang", "source"], "left")
        .join(by_lang, "lang", "left")
        .na.fill(0, ["total", "terms", "lang_total"])
        .withColumn("place", place)
        .withColumn("base", share("0", "total")),
        "audit-groups",
    )

    # Differences: every term as one row of sparse shares, every block of sources by itself.
    bases = (
        groups.where("terms > 0")
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "base"))).alias("x"))
        .select("lang", F.col("x.base").alias("base"))
    )
    rows = (
        counts.join(groups.select("lang", "source", "place", "total", "terms"), ["lang", "source"])
        .select("lang", "term", "place", share("n", "total").alias("p"))
        .groupBy("lang", "term")
        .agg(F.collect_list(F.struct("place", "p")).alias("entries"))
        .join(bases, "lang")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((size(base) - 1) div {BLOCK} AS INT)"))))
        .withColumn("slot", F.pmod(F.hash("term"), F.lit(SLOTS)))
        .repartition("lang", "block", "slot")
        .sortWithinPartitions("lang", "block")
        .select("lang", "block", "base", "entries")
    )
    names = groups.select("lang", "place", "source")
    pairs = (
        rows.mapInArrow(_sum_differences, "lang string, i long, j long, value long")
        .where("i != j")
        .groupBy("lang", "i", "j")
        .agg(F.sum("value").alias("value"))
        .join(names.toDF("lang", "i", "source"), ["lang", "i"])
        .join(names.toDF("lang", "j", "item"), ["lang", "j"])
        .select("lang", "source", "item", "value")
    )
    bare = groups.where("terms = 0").select("lang", "source")
    nothing = (
        bare.join(bare.toDF("lang", "item"), "lang")
        .where("source != item")
        .select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_part = pairs.unionByName(nothing).withColumn("rank", F.row_number().over(order))

    # Terms: skybands of tasks, merged in slots, then ranked by value.
    retained = counts.mapInArrow(_retain(terms), _SKY)
    merged = (
        retained.repartition("lang", "source", F.pmod(F.hash("term"), F.lit(8)))
        .mapInArrow(_retain(terms), _SKY)
        .join(groups.drop("base", "place"), ["lang", "source"])
    )
    own = share("n", "total")
    whole = share("lang_n", "lang_total")
    term_part = (
        merged.select("lang", "source", F.col("term").alias("item"), (own - whole).alias("value"))
        .where("value > 0")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= terms)
    )
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pair_part.withColumn("part", F.lit("pair"))
        .select(*columns)
        .unionByName(term_part.withColumn("part", F.lit("term")).select(*columns))
    )
