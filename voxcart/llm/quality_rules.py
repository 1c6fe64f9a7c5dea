"""Quality rules by divergence from language references.

A document is compared with the reference of its language by two histograms: the
characters of its words by class, and its common words.  The distance of each pair is the
Jensen-Shannon distance (base 2, so between 0 and 1).  References are counted over
all documents of a language, and hold only fixed-length arrays: one row per
language, with ``COMMON_WORDS`` words.

Guards: a document with fewer than ``LEAST_WORDS`` words is not judged by
histograms, and neither is one whose language has no reference (NULL, or fewer
than ``REFERENCE_WORDS`` words in all).  Both are judged by the base rules alone.

Everything happens inside a row but for the counting of references, so no text is
shuffled.  Repeated windows are found through 64-bit hashes of five words.

Defined results: a NULL text has no words and fails the base rules; repeated rows
are judged alike; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcart.llm.common import even_space, written

WINDOW = 5
LEAST_WORDS = 50
COMMON_WORDS = 32
REFERENCE_WORDS = 1000
# Largest Jensen-Shannon distances of a document that stays.
CLASS_DISTANCE = 0.34
WORD_DISTANCE = 0.43

SYMBOLS = "#*$%&|<>"
CLASSES = ("upper", "digit", "symbol", "punctuation", "foreign", "lower")


def _count(text: Column, others: str) -> Column:
    """Characters that are left when the runs in the class ``others`` are gone."""
    return F.length(F.regexp_replace(text, f"[{others}]+", "")).cast("long")


def _characters(flat: Column) -> Column:
    """What is left to be counted by class: all but the runs of a-z and blanks."""
    return F.regexp_replace(flat, "[a-z ]+", "")


def _class_columns(others: Column) -> list[Column]:
    return [
        _count(others, "^A-Z").alias("upper"),
        _count(others, "^0-9").alias("digit"),
        _count(others, f"^{SYMBOLS}").alias("symbol"),
        _count(others, r"\x00-\x20\x7F0-9A-Za-z#*$%&|<>\u0080-\x{10FFFF}").alias("punctuation"),
        _count(others, r"\x00-\x7F").alias("foreign"),
    ]


def _line_has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""


def _hash_window(first: Column, at: Column, hashes: Column) -> Column:
    return F.xxhash64(first, *[F.get(hashes, at + k) for k in range(1, WINDOW)])


def with_measures(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carried`` columns, ``lang`` and what the rules measure in each text."""
    empty = F.array().cast("array<string>")
    texts = docs.select(
        *carried,
        "lang",
        F.coalesce("text", F.lit("")).alias("text"),
        F.btrim(even_space(F.col("text"))).alias("flat"),
    )
    split = texts.withColumn("others", _characters(F.col("flat"))).select(
        *carried,
        "lang",
        F.when(F.col("flat") == "", empty).otherwise(F.split("flat", " ")).alias("words"),
        F.length(F.replace("flat", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        *_class_columns(F.col("others")),
        F.filter(F.split("text", "\n"), _line_has_word).alias("lines"),
    )
    hashed = split.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        }
    ).drop("lines")
    windows = hashed.withColumn(
        "windows",
        F.when(
            F.size("hashes") >= WINDOW,
            F.transform(
                F.slice("hashes", 1, F.size("hashes") - (WINDOW - 1)),
                lambda h, i: _hash_window(h, i, F.col("hashes")),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    ).drop("hashes")
    # Only texts that repeat a window pay for sorting theirs.
    ordered = windows.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(
                F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            ),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    ).drop("windows")
    repeated = ordered.withColumn(
        "starts",
        F.sort_array(
            F.transform(
                F.filter(
                    "ordered",
                    lambda w, k: (w.h == F.get("ordered", k + 1).h)
                    | ((k > 0) & (w.h == F.get("ordered", k - 1).h)),
                ),
                lambda w: w.i,
            )
        ),
    ).drop("ordered")
    # A repeated window adds the words that the one before it has not covered.
    covered = F.aggregate(
        F.transform(
            F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))),
            lambda s, k: F.least(F.lit(WINDOW), s - F.get("starts", k)),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    return repeated.withColumn(
        "n_repeat_words",
        F.when(F.size("starts") == 0, 0).otherwise(F.lit(WINDOW) + covered).cast("long"),
    ).drop("starts")


def class_counts() -> Column:
    """Characters by class, in the order of ``CLASSES``; the last takes the rest."""
    counted = [F.col(c) for c in CLASSES[:-1]]
    rest = F.col("word_chars")
    for c in counted:
        rest = rest - c
    return F.array(*counted, rest)


def references(docs: DataFrame) -> DataFrame:
    """One row per language: ``ref_lang, class_shares, common, word_shares``.

    ``word_shares`` has one more entry than ``common``, for all other words.
    """
    counts = written(
        docs.where(F.col("lang").isNotNull())
        .select("lang", F.explode(F.split(even_space(F.col("text")), " ")).alias("word"))
        .where("word != ''")
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n")),
        "words-by-language",
    )
    # Characters by class follow from the distinct words and their counts.
    classes = (
        counts.withColumn("others", _characters(F.col("word")))
        .select("lang", "n", F.length("word").alias("word_chars"), *_class_columns(F.col("others")))
        .select("lang", "n", "word_chars", class_counts().alias("counts"))
        .groupBy("lang")
        .agg(
            *[
                F.sum(F.col("n") * F.get("counts", F.lit(i))).alias(f"c{i}")
                for i in range(len(CLASSES))
            ],
            F.sum(F.col("n") * F.col("word_chars")).alias("all_chars"),
        )
        .select(
            "lang",
            F.array(*[F.col(f"c{i}") / F.col("all_chars") for i in range(len(CLASSES))]).alias(
                "class_shares"
            ),
        )
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all_words"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = (
        counts.withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= COMMON_WORDS)
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    )
    return (
        top.join(totals, "lang")
        .where(F.col("all_words") >= REFERENCE_WORDS)
        .join(classes, "lang")
        .select(
            F.col("lang").alias("ref_lang"),
            "class_shares",
            F.transform("top", lambda t: t.word).alias("common"),
            F.concat(
                F.transform("top", lambda t: t.n / F.col("all_words")),
                F.array(
                    (
                        F.col("all_words")
                        - F.aggregate("top", F.lit(0).cast("long"), lambda a, t: a + t.n)
                    )
                    / F.col("all_words")
                ),
            ).alias("word_shares"),
        )
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    total = F.aggregate(
        F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a)), F.lit(0.0), lambda a, b: a + b
    )
    return F.when(total.isNotNull(), F.sqrt(F.greatest(total / 2, F.lit(0.0))))


def judge(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carried`` columns, measures, distances and verdicts, one row per document."""
    refs = written(references(docs), "language-references")
    measured = with_measures(docs, carried).join(refs, F.col("lang") == F.col("ref_lang"), "left")
    judged = F.col("ref_lang").isNotNull() & (F.col("n_words") >= LEAST_WORDS)
    found = measured.withColumn(
        "found",
        F.when(judged, F.filter("words", lambda w: F.array_contains("common", w))),
    )
    shares = found.select(
        "*",
        F.when(
            judged,
            F.concat(
                F.transform(
                    "common",
                    lambda c: (F.size("found") - F.size(F.array_remove("found", c)))
                    / F.col("n_words"),
                ),
                F.array((F.col("n_words") - F.size("found")) / F.col("n_words")),
            ),
        ).alias("own_words"),
        F.when(judged, F.transform(class_counts(), lambda c: c / F.col("word_chars"))).alias(
            "own_classes"
        ),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    distances = shares.select(
        *carried,
        "n_words",
        "word_chars",
        F.col("symbol").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.round(js_distance(F.col("own_classes"), F.col("class_shares")), 6).alias("class_distance"),
        F.round(js_distance(F.col("own_words"), F.col("word_shares")), 6).alias("word_distance"),
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= CLASS_DISTANCE) & (
        F.coalesce("word_distance", F.lit(0.0)) <= WORD_DISTANCE
    )
    return distances.withColumn("kept", ~F.col("base_failed") & near)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    The verdict is a function of text and language, so the columns travel with it: no
    join by doc_id is needed and repeated rows or NULL ids make no difference.
    """
    names = {f"_in{i}": c for i, c in enumerate(docs.columns)}
    given = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], "lang", "text")
    # A filter would be pushed down by repeating every expression that the verdict is built
    # on; a column that is not deterministic holds it above them.
    judged = judge(given, tuple(names)).withColumn("_row", F.monotonically_increasing_id())
    kept = judged.where("kept AND _row >= 0")
    return kept.select(*[F.col(n).alias(c) for n, c in names.items()])
