"""Secret scans: three fixed patterns, and strings of high entropy.

Patterns give the base spans.  Beside them, candidate strings (long runs of key
characters) are scanned by a window of ``WINDOW`` characters.  The Shannon entropy
of each window follows from that of the one before by the counts of the character
that enters and the one that leaves.  A candidate is a finding if some window
reaches the bound of the candidate's character class, unless an allow-list pattern
matches it.

Entropy is kept in whole numbers: ``c * log2(c)`` is a table of integers in units of
2**-20 bit, so that results do not depend on the order of sums.

Everything is a projection: no shuffle, and no text leaves its row.  Spans are code
points, end exclusive.

Defined results: a NULL or empty text has no spans, and the digest of an empty
string; spans of one kind do not overlap, those of different kinds may; repeated
rows get equal results; an empty table gives no rows; further columns are not looked
at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the contract.  The key names match in either case.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
UNIT = 1 << 20
# Bits per character that a window must reach, by class; the first that fits counts.
CLASSES = (
    ("digits", r"^[0-9]+$", 9.0),  # never: telephone, account and order numbers
    ("hex", r"^[0-9a-fA-F]+$", 3.05),
    ("letters", r"^[A-Za-z_=/+-]+$", 4.15),
    ("mixed", r"", 3.75),
)
# Strings that look random and are not secret.
ALLOW = (
    r"(?i)example|sample|placeholder|dummy|changeme",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^/|//|^([A-Za-z]+[/_=-])+[A-Za-z]*[0-9]{0,4}$",
)
# Prefix sums go by blocks, so that many matches in one text cost little more.
BLOCK = 64


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _placed(found: Column, gaps: Column, widths: Column, blocks: Column) -> Column:
    """Array of ``start, stop, text`` for matches between the pieces ``gaps``."""

    def place(match: Column, i: Column) -> Column:
        whole = F.floor(i / BLOCK).cast("int")
        before = _sum(F.slice(blocks, F.lit(1), whole)) + _sum(
            F.slice(widths, whole * BLOCK + 1, i - whole * BLOCK)
        )
        start = before + F.length(F.get(gaps, i))
        return F.struct(
            start.alias("start"), (start + F.length(match)).alias("stop"), match.alias("text")
        )

    return F.transform(found, place)


def _locate(df: DataFrame, name: str, pattern: str, maybe: Column) -> DataFrame:
    """Add column ``name``: all leftmost matches of ``pattern`` with their places."""
    none = F.array().cast("array<string>")
    df = df.withColumn(
        "found",
        F.when(maybe, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none),
    )
    df = df.withColumn(
        "gaps", F.when(F.size("found") > 0, F.split("text", pattern, -1)).otherwise(none)
    )
    df = df.withColumn(
        "widths", F.zip_with("gaps", "found", lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
    )
    last = F.floor((F.size("widths") - 1) / BLOCK).cast("int")
    df = df.withColumn(
        "blocks",
        F.when(
            F.size("widths") > 0,
            F.transform(
                F.sequence(F.lit(0), last),
                lambda b: _sum(F.slice("widths", b * BLOCK + 1, BLOCK)),
            ),
        ).otherwise(F.array().cast("array<int>")),
    )
    return df.withColumn(
        name, _placed(F.col("found"), F.col("gaps"), F.col("widths"), F.col("blocks"))
    ).drop("found", "gaps", "widths", "blocks")


def table_of_terms() -> list[int]:
    """``c * log2(c)`` in units, for every count a window can hold."""
    return [0] + [round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 1)]


def most_entropy(candidate: Column) -> Column:
    """The least sum of ``c * log2(c)`` over all windows, in units.

    The lower the sum, the higher the entropy: ``log2(W) - sum / W``.
    """
    terms = F.array(*[F.lit(t) for t in table_of_terms()])
    chars = F.filter(F.split(candidate, ""), lambda c: c != "")
    letters = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c))

    def change(state: Column, letter: Column, by: int) -> Column:
        count = F.get(state.counts, letter - 1)
        return F.struct(
            F.transform(
                state.counts, lambda n, k: F.when(k == letter - 1, n + by).otherwise(n)
            ).alias("counts"),
            (state.total + F.get(terms, count + by) - F.get(terms, count)).alias("total"),
        )

    def step(state: Column, pair: Column) -> Column:
        left = F.when(pair.leaves > 0, change(state, pair.leaves, -1)).otherwise(
            F.struct(state.counts.alias("counts"), state.total.alias("total"))
        )
        # The window has lost its oldest character; bind it before the next enters.
        entered = F.get(
            F.transform(F.array(left), lambda s: change(s, pair.enters, 1)), F.lit(0)
        )
        return F.get(
            F.transform(
                F.array(entered),
                lambda s: F.struct(
                    s.counts.alias("counts"),
                    s.total.alias("total"),
                    F.when(pair.full, F.least(state.best, s.total))
                    .otherwise(state.best)
                    .alias("best"),
                ),
            ),
            F.lit(0),
        )

    pairs = F.transform(
        F.array(letters),
        lambda ls: F.transform(
            ls,
            lambda c, i: F.struct(
                c.alias("enters"),
                F.when(i >= WINDOW, F.get(ls, i - WINDOW)).otherwise(0).alias("leaves"),
                (i >= WINDOW - 1).alias("full"),
            ),
        ),
    )
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0).alias("total"),
        F.lit(table_of_terms()[-1]).alias("best"),
    )
    return F.aggregate(F.get(pairs, F.lit(0)), start, step, lambda s: s.best)


def bound_of(bits: float) -> int:
    """The largest sum of terms with which a window still reaches ``bits``."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * UNIT)


def _random(candidate: Column) -> Column:
    bound = F.lit(bound_of(CLASSES[-1][2]))
    for _, pattern, bits in reversed(CLASSES[:-1]):
        bound = F.when(candidate.rlike(pattern), F.lit(bound_of(bits))).otherwise(bound)
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | candidate.rlike(pattern)
    return ~allowed & (bound >= 0) & (most_entropy(candidate) <= bound)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and one array of ``start, stop, text`` per kind."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lower = F.lower("text")
    named = F.lit(False)
    for word in ASSIGN_WORDS:
        named = named | F.contains(lower, F.lit(word))
    always = F.lit(True)
    df = _locate(df, "assign", ASSIGN, named)
    df = _locate(df, "access", ACCESS, F.contains("text", F.lit("AKIA")))
    df = _locate(df, "hex", r"[0-9a-f]{%d,}" % LEAST["hex"], always)
    df = _locate(df, "entropy", CANDIDATE, always)
    return df.select(
        "doc_id",
        F.filter(
            "assign",
            lambda m: F.length(F.regexp_extract(m.text, ASSIGN, 2)) >= LEAST["assign"],
        ).alias("assign"),
        F.filter("access", lambda m: F.length(m.text) >= LEAST["access"]).alias("access"),
        "hex",
        F.filter("entropy", lambda m: _random(m.text)).alias("entropy"),
    )


def _ranked(kind: str, rank: int) -> Column:
    return F.transform(
        kind,
        lambda m: F.struct(
            m.start.alias("start"),
            F.lit(rank).alias("rank"),
            m.stop.alias("stop"),
            F.lit(kind).alias("kind"),
        ),
    )


def _listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans, by start and then by kind as listed."""
    spans = F.concat(*[_ranked(kind, rank) for rank, kind in enumerate(kinds)])
    return F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ","
    )


def digest_spans(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(KINDS[:3]), 256).alias("base_sha256"),
        _listed(KINDS).alias("spans"),
    )
