"""Which response belongs to which prompt: one-to-one in order of time.

Within a key, each prompt takes the first response at or after it that no earlier prompt has
taken; a response is used once.  In other words prompts wait in a queue, and a response goes
to the one that has waited longest.

Whether a response finds the queue empty follows from sums: count prompts up and responses
down along the key; a response that makes a new low of that sum is an orphan.  All others
are the 1st, 2nd, ... to be taken, by the 1st, 2nd, ... prompt.  Sums and lows of stretches
can be added up, so a key's line of events is cut into stretches of time: each stretch is
summed in a task of its own, one row per stretch carries its sums to the next, and then each
stretch numbers its own events.  So a key that holds a third of all events uses as many
tasks as it has stretches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = "1 hour"


def _events(df: DataFrame, keys: list[str], time: str, tie: list[str], step: int) -> DataFrame:
    """Events of one side, in one layout; ``tie`` orders those of the same time."""
    ties = F.array(*(F.col(c).cast("string") for c in tie)) if tie else F.array().cast("array<string>")
    return df.select(
        F.struct(*keys).alias("key"),
        F.col(time).alias("at"),
        F.lit(step).alias("step"),
        ties.alias("tie"),
        F.struct("*").alias("row"),
    )


def _numbered(events: DataFrame, stretch: str) -> DataFrame:
    """Events with ``turn``: the number of a prompt, or of the prompt that a response is for."""
    events = events.withColumn("stretch", F.window("at", stretch)["start"])
    within = Window.partitionBy("key", "stretch").orderBy("at", F.desc("step"), "tie")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    local = events.withColumn("level", F.sum("step").over(upto)).withColumn(
        "low", F.least(F.min("level").over(upto), F.lit(0))
    )
    # One row per key and stretch; a running sum, and the lowest of what each stretch reaches.
    before = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        local.groupBy("key", "stretch")
        .agg(
            F.sum("step").alias("rise"),
            F.min("low").alias("dip"),
            F.count_if(F.col("step") > 0).alias("prompts"),
            F.count_if(F.col("step") < 0).alias("responses"),
        )
        .withColumn("level_before", F.coalesce(F.sum("rise").over(before), F.lit(0)))
        .withColumn("reach", F.col("level_before") + F.col("dip"))
        .select(
            "key",
            "stretch",
            "level_before",
            F.least(F.coalesce(F.min("reach").over(before), F.lit(0)), F.lit(0)).alias("low_before"),
            F.coalesce(F.sum("prompts").over(before), F.lit(0)).alias("prompts_before"),
            F.coalesce(F.sum("responses").over(before), F.lit(0)).alias("responses_before"),
        )
    )
    placed = local.join(carried, ["key", "stretch"])
    low = F.least(F.col("low_before"), F.col("level_before") + F.col("low"))
    previous = F.lag("low", 1, 0).over(within)
    low_previous = F.least(F.col("low_before"), F.col("level_before") + previous)
    count = F.col("prompts_before") + F.count_if(F.col("step") > 0).over(upto)
    taken = F.col("responses_before") + F.count_if(F.col("step") < 0).over(upto) + low
    return placed.select(
        "key",
        "step",
        "row",
        # A new low is an orphan, and has no turn.
        F.when(F.col("step") > 0, count).when(low == low_previous, taken).alias("turn"),
    )


def pair_in_order(
    prompts: DataFrame,
    responses: DataFrame,
    keys: tuple[str, ...] = ("review_id",),
    time: str = "publish_time",
    prompt_tie: tuple[str, ...] = (),
    response_tie: tuple[str, ...] = (),
    answer: tuple[str, ...] = ("response",),
    stretch: str = STRETCH,
) -> DataFrame:
    """Every prompt with its own response: columns of ``prompts``, ``response_time``, ``answer``.

    Prompts and responses of the same time count as prompt first; ``*_tie`` columns order
    events of one side that share a time.  A prompt without a response has NULLs, as has one
    with a NULL in its key or without a time.
    """
    # One condition and not a chain of them, in which each would parse its message anew.
    usable = F.least(*(F.col(k).isNotNull() for k in (*keys, time)))
    asked = _events(prompts.where(usable), list(keys), time, list(prompt_tie), 1)
    given = _events(
        responses.where(usable).select(*{*keys, time, *answer, *response_tie}),
        list(keys), time, list(response_tie), -1,
    )
    names = [f.name for f in given.schema["row"].dataType]
    both = asked.select("key", "at", "step", "tie", F.col("row").alias("asked"),
                        F.lit(None).cast(given.schema["row"].dataType).alias("given")).unionByName(
        given.select("key", "at", "step", "tie", F.lit(None).cast(asked.schema["row"].dataType).alias("asked"),
                     F.col("row").alias("given"))
    )
    numbered = _numbered(
        both.select("key", "at", "step", "tie", F.struct("asked", "given").alias("row")), stretch
    )
    # A turn has one prompt and at most one response, which comes behind it.
    of_turn = Window.partitionBy("key", "turn").orderBy(F.desc("step"))
    paired = (
        numbered.where("turn IS NOT NULL")
        .select("step", F.col("row.asked").alias("asked"), F.lead("row.given").over(of_turn).alias("given"))
        .where("step > 0")
        .select(
            *(F.col(f"asked.`{c}`") for c in prompts.columns),
            F.col(f"given.`{time}`").alias("response_time"),
            *(F.col(f"given.`{c}`") for c in answer),
        )
    )
    unusable = prompts.where(~F.coalesce(usable, F.lit(False))).select(
        "*",
        F.lit(None).cast(given.schema["at"].dataType).alias("response_time"),
        *(F.lit(None).cast(given.schema["row"].dataType[names.index(c)].dataType).alias(c) for c in answer),
    )
    return paired.unionByName(unusable)


