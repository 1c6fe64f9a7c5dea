"""Mixing sources to temperature weights under a token budget.

The share of a source in all tokens, raised to an exponent between 0 and 1 and
normalised, is its weight: 1 keeps the corpus as it is, 0 makes all sources equal.  The
exponent is the largest at which the weights' entropy reaches a target, found by
bisection; it then rises again as far as needed so that no source is repeated more often
than a limit allows.  Each pass over the table of sources evaluates the exponents of
``LEVELS`` bisection steps at once, so a pass is one small aggregate, however many
sources there are.

Weights become documents by block permutations.  A source's documents lie in ``BLOCKS``
blocks by a hash of doc_id; blocks are permuted by another hash, and so are the documents
of a block.  A source gets its weight's part of the budget: whole rounds over all its
documents, and then documents in permuted order while they fit.  Which blocks fit
follows from running sums of their totals; only a source's one block that is cut needs
the order of its documents.  So a hot source is never brought together.

Documents of one hash place are taken together or not at all, so the copies of a row follow
from its source, block and place alone: ``realise`` looks them up in a table of cuts, and
no row is matched to another by its doc_id.

Defined results: the token count of a text is its number of words; a NULL source is a
source of its own; rows without doc_id are placed by their text; rows of one doc_id, or of
none and one text, share a place; a source without tokens gets no copies; an empty table
gives no rows; further columns are kept by ``realise`` and not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcart.llm.common import even_space, fresh, written

# Target: this part of the largest entropy, which all sources being equal would have.
ENTROPY_SHARE = 0.95
# No document is taken more often than this, on average over its source.
REPEAT_LIMIT = 4.0
# Tokens of the mix, as a part of all tokens.
BUDGET_SHARE = 1.0
BLOCKS = 1024
LEVELS = 6
PASSES = 6
SEED = "mix-1"


def n_tokens(text: Column) -> Column:
    flat = F.btrim(even_space(text))
    return F.when(flat == "", 0).otherwise(
        F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1
    ).cast("long")


def _bits(key: Column) -> Column:
    """A whole number below 2**32 from a key, alike in every engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def _key() -> Column:
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return F.concat(F.lit(f"{SEED}|"), own)


def _block() -> Column:
    return (_bits(_key()) % BLOCKS).cast("int")


def _place() -> Column:
    return F.md5(F.concat(_key(), F.lit("|place")))


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, source, tokens, block, place``: all that the plan needs of a document."""
    return docs.select(
        "doc_id",
        "source",
        n_tokens(F.col("text")).alias("tokens"),
        _block().alias("block"),
        _place().alias("place"),
    )


def _bisect(shares: DataFrame, low: float, high: float, holds) -> float:
    """The largest exponent in ``low..high`` for which ``holds`` is true, which it is at ``low``.

    ``holds(sums)`` gets, for one exponent, a function from an expression of ``w`` (the
    weight before normalising) to its sum over all sources, and returns a column.
    """
    for _ in range(PASSES):
        steps = 1 << LEVELS
        tried = [low + (high - low) * i / steps for i in range(1, steps)]
        row = shares.agg(
            *[holds(F.pow("share", F.lit(t)), t).alias(f"e{i}") for i, t in enumerate(tried)]
        ).first()
        # Truth falls once from left to right; bisection over the answers finds where.
        first, last = 0, len(tried)
        while first < last:
            middle = (first + last) // 2
            if row[middle]:
                first = middle + 1
            else:
                last = middle
        low, high = ([low, *tried, high])[first : first + 2]
    return low


def exponent(
    totals: DataFrame,
    entropy_share: float = ENTROPY_SHARE,
    repeat_limit: float = REPEAT_LIMIT,
    budget_share: float = BUDGET_SHARE,
) -> float:
    """The exponent for ``source, tokens`` of all sources with tokens."""
    whole = totals.agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("sources")
    ).first()
    if not whole.tokens:
        return 1.0
    shares = totals.select((F.col("tokens") / F.lit(whole.tokens)).alias("share"))
    target = entropy_share * math.log(whole.sources)

    def spread_enough(w: Column, _: float) -> Column:
        total = F.sum(w)
        return F.log(total) - F.sum(w * F.log(w)) / total >= F.lit(target)

    def too_often(w: Column, _: float) -> Column:
        # The weight of a source over its share is how often it is repeated per budget.
        return F.max(w / F.col("share")) / F.sum(w) * F.lit(budget_share) > F.lit(repeat_limit)

    natural = shares.agg(spread_enough(F.col("share"), 1.0)).first()[0]
    found = 1.0 if natural else _bisect(shares, 0.0, 1.0, spread_enough)
    if shares.agg(too_often(F.pow("share", F.lit(found)), found)).first()[0]:
        found = _bisect(shares, found, 1.0, too_often)
        found = min(1.0, found + 2.0 ** (-LEVELS * PASSES))
    return found


def _cuts(
    rows: DataFrame, entropy_share: float, repeat_limit: float, budget_share: float
) -> DataFrame:
    """``of_source, of_block, block_rank, copies, last_place`` of every block.

    A document of the block is taken ``copies`` times, and once more if its place is not
    after ``last_place``.
    """
    blocks = written(
        rows.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens")), "mix-blocks"
    )
    totals = written(
        blocks.groupBy("source").agg(F.sum("block_tokens").alias("tokens")), "mix-sources"
    )
    alive = totals.where("tokens > 0")
    power = exponent(alive, entropy_share, repeat_limit, budget_share)
    sums = alive.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    all_tokens = sums.t or 1
    share = F.col("tokens") / F.lit(all_tokens)
    mass = alive.agg(F.sum(F.pow(share, F.lit(power))).alias("m")).first().m or 1.0
    budget = math.floor(all_tokens * budget_share)
    quotas = totals.select(
        F.col("source").alias("of_source"),
        F.col("tokens").alias("source_tokens"),
        F.when(
            F.col("tokens") > 0, F.floor(F.pow(share, F.lit(power)) / F.lit(mass) * F.lit(budget))
        )
        .otherwise(0)
        .alias("quota"),
    )
    order = Window.partitionBy("source").orderBy("shuffled", "block")
    shuffled = F.md5(
        F.concat_ws("|", F.lit(SEED), F.coalesce("source", F.lit("")), F.col("block").cast("string"))
    )
    # At most BLOCKS rows per source.
    cuts = (
        blocks.withColumn("shuffled", shuffled)
        .select(
            "source",
            "block",
            "block_tokens",
            F.row_number().over(order).alias("block_rank"),
            (
                F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
                - F.col("block_tokens")
            ).alias("tokens_before"),
        )
        .join(quotas, F.col("source").eqNullSafe(F.col("of_source")))
        .select(
            F.col("source").alias("of_source"),
            F.col("block").alias("of_block"),
            "block_rank",
            F.expr("CASE WHEN source_tokens > 0 THEN quota div source_tokens ELSE 0 END").alias(
                "rounds"
            ),
            (
                F.expr("CASE WHEN source_tokens > 0 THEN quota % source_tokens ELSE 0 END")
                - F.col("tokens_before")
            ).alias("room"),
            "block_tokens",
        )
    )
    cuts = written(cuts, "mix-cuts")
    # At most one block of a source is cut; places of it are taken while they fit.
    upto = Window.partitionBy("of_source", "of_block").orderBy("place")
    last = (
        rows.join(
            cuts.where("room > 0 AND room < block_tokens").select("of_source", "of_block", "room"),
            F.col("source").eqNullSafe(F.col("of_source")) & (F.col("block") == F.col("of_block")),
        )
        .groupBy("of_source", "of_block", "place")
        .agg(F.sum("tokens").alias("tokens"), F.max("room").alias("room"))
        .withColumn("upto", F.sum("tokens").over(upto))
        .where("upto <= room")
        .groupBy(F.col("of_source").alias("cut_source"), F.col("of_block").alias("cut_block"))
        .agg(F.max("place").alias("last_place"))
    )
    return cuts.join(
        last,
        F.col("of_source").eqNullSafe(F.col("cut_source")) & (F.col("of_block") == F.col("cut_block")),
        "left",
    ).select(
        "of_source",
        "of_block",
        "block_rank",
        F.expr("rounds + CAST(room > 0 AND room >= block_tokens AS BIGINT)").alias("rounds"),
        F.coalesce("last_place", F.lit("")).alias("last_place"),
    )


def _copies(place: Column) -> Column:
    return F.col("rounds") + (place <= F.col("last_place")).cast("long")


def plan(
    docs: DataFrame,
    entropy_share: float = ENTROPY_SHARE,
    repeat_limit: float = REPEAT_LIMIT,
    budget_share: float = BUDGET_SHARE,
) -> DataFrame:
    """``doc_id, source, n_tokens, block, block_rank, copies`` per document.

    ``copies`` says how often a document is in the mix; ``block_rank`` is the place of its
    block in the source's permutation.
    """
    rows = written(counted(docs), "mix-rows")
    return rows.join(
        _cuts(rows, entropy_share, repeat_limit, budget_share),
        F.col("source").eqNullSafe(F.col("of_source")) & (F.col("block") == F.col("of_block")),
    ).select(
        "doc_id",
        "source",
        F.col("tokens").alias("n_tokens"),
        "block",
        "block_rank",
        _copies(F.col("place")).alias("copies"),
    )


def realise(
    docs: DataFrame,
    entropy_share: float = ENTROPY_SHARE,
    repeat_limit: float = REPEAT_LIMIT,
    budget_share: float = BUDGET_SHARE,
) -> DataFrame:
    """The mix itself: each document as often as planned, with all its columns."""
    rows = written(counted(docs), "mix-rows")
    cuts = _cuts(rows, entropy_share, repeat_limit, budget_share)
    own = [fresh(docs, name) for name in ("of_source", "of_block", "rounds", "last_place")]
    cuts = cuts.select("of_source", "of_block", "rounds", "last_place").toDF(*own)
    source, block, rounds, last_place = (F.col(name) for name in own)
    copies = rounds + (_place() <= last_place).cast("long")
    return (
        docs.join(cuts, docs["source"].eqNullSafe(source) & (_block() == block))
        .where(copies > 0)
        .withColumn(own[0], F.explode(F.sequence(F.lit(1).cast("long"), copies)))
        .select(*(F.col(f"`{c}`") for c in docs.columns))
    )
