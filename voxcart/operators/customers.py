"""Customer value: recency, frequency and spend, segments, personas."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcart.functions.measures import instant
from voxcart.functions.payload import json_text
from voxcart.functions.text import fill_template, number_text, trim_set
from voxcart.operators.inference import RESULT, Provider, apply_model
from voxcart.session import materialize

# The clustered features and the number of segments.
FEATURES = ("avg_spend", "count_orders", "days_since_order")
SEGMENTS = 3
# Rounds of moving centres.
ROUNDS = 20

PERSONA_PROMPT = (
    "You plan campaigns. Invent one persona for customer cluster {centroid_id}: "
    "average spend ${avg_spend}, {count_orders} orders per person, "
    "{days_since_order} days since the last order. "
    "Answer with a flat JSON object that has the fields persona_title and persona_description."
)


def rfm_features(
    order_items: DataFrame,
    start,
    end,
    as_of=None,
    level: str = "item",
    user_id: str | None = None,
) -> DataFrame:
    """Days since the last order, distinct orders and mean spend per user.

    Both ends of ``start``..``end`` belong to the range.  ``level="item"`` averages
    prices of order lines, ``level="order"`` averages order totals.  Spark combines
    every step on the map side and counts distinct orders by (user, order) first,
    so a user with very many lines does not load one task.
    """
    lines = order_items.where(F.col("created_at").between(instant(start), instant(end)))
    if user_id is not None:
        lines = lines.where(F.col("user_id") == user_id)
    if level == "order":
        lines = lines.groupBy("user_id", "order_id", "created_at").agg(
            F.sum("sale_price").alias("spend")
        )
    elif level == "item":
        lines = lines.withColumn("spend", F.col("sale_price"))
    else:
        raise ValueError(f"unknown level {level!r}")
    last_day = F.max("created_at").cast("date")
    return lines.groupBy("user_id").agg(
        F.date_diff(instant(as_of).cast("date"), last_day).cast("bigint").alias("days_since_order"),
        F.count_distinct("order_id").alias("count_orders"),
        F.avg("spend").alias("avg_spend"),
    )


@dataclass(frozen=True)
class Centroid:
    """One segment centre in original units; ids count from 1."""

    centroid_id: int
    values: dict[str, float]


@dataclass(frozen=True)
class Segmentation:
    """Segment centres with the mean and spread that standardise each feature.

    It holds one number per segment and feature, whatever the size of the data.
    """

    centroids: tuple[Centroid, ...]
    spread: dict[str, float]
    mean: dict[str, float]

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.spread)


def _gap(names: Sequence[str], centre: Sequence[float]) -> Column:
    """Squared distance to a centre in standardised units."""
    total = F.lit(0.0)
    for name, value in zip(names, centre, strict=True):
        gap = F.col(name) - F.lit(float(value))
        total = total + gap * gap
    return total


def chance(key: Column, seed: int, turn: int) -> Column:
    """A number above 0 and below 1 from a key, alike in every engine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|{turn}|"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def seed_centres(
    scaled: DataFrame, k: int, names: Sequence[str], seed: int, key: str = "user_id"
) -> list[tuple[float, ...]]:
    """k-means++: each centre is a row drawn with a chance like its squared distance.

    The row with the smallest ``-ln(chance) / weight`` is such a draw, so each centre is one
    aggregate over all rows, and the draw can be replayed from the keys.  Rows at a centre
    have no weight; if there are no others, the row with the smallest chance comes again.
    """
    centres: list[tuple[float, ...]] = []
    for turn in range(k):
        drawn = chance(F.col(key), seed, turn)
        weight = F.least(*(_gap(names, c) for c in centres)) if len(centres) > 1 else (
            _gap(names, centres[0]) if centres else F.lit(1.0)
        )
        wait = F.when(weight > 0, -F.ln(drawn) / weight)
        order = F.struct(wait.isNull().alias("none"), F.coalesce(wait, drawn).alias("wait"), key)
        row = scaled.agg(F.min_by(F.struct(*names), order).alias("row")).first().row
        if row is None:
            raise ValueError("no rows to segment")
        centres.append(tuple(row))
    return centres


def _nearest(names: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """Number of the nearest centre; ties go to the lower one."""
    gaps = [
        F.struct(_gap(names, c).alias("gap"), F.lit(i).alias("number")) for i, c in enumerate(centres)
    ]
    return F.array_min(F.array(*gaps))["number"]


def fit_segments(
    features: DataFrame,
    k: int = SEGMENTS,
    names: tuple[str, ...] = FEATURES,
    seed: int = 42,
    key: str = "user_id",
    rounds: int = ROUNDS,
) -> Segmentation:
    """k-means on standardised features, missing values replaced by the mean.

    Seeds by k-means++, then at most ``rounds`` rounds of assigning rows to the nearest centre
    and moving each centre to the mean of its rows; a centre without rows stays.  Every round
    is one aggregate of ``k`` rows, and the rows are read from one written table.
    """
    doubles = materialize(
        features.select(
            F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key),
            *(F.col(n).cast("double").alias(n) for n in names),
        )
    )
    stats = doubles.agg(
        F.count("*").alias("rows"),
        *(F.avg(n).alias(f"mean_{n}") for n in names),
        # Spread of the filled column: a mean in the place of a gap adds nothing.
        *((F.var_pop(n) * F.count(n) / (F.count("*") - 1)).alias(f"var_{n}") for n in names),
    ).first()
    mean = {n: stats[f"mean_{n}"] or 0.0 for n in names}
    spread = {n: (stats[f"var_{n}"] or 0.0) ** 0.5 or 1.0 for n in names}
    scaled = doubles.select(
        key, *(((F.coalesce(n, F.lit(mean[n])) - mean[n]) / spread[n]).alias(n) for n in names)
    )
    centres = seed_centres(scaled, k, names, seed, key)
    for _ in range(rounds):
        means = {
            r.number: tuple(r)[1:]
            for r in scaled.groupBy(_nearest(names, centres).alias("number"))
            .agg(*(F.avg(n).alias(n) for n in names))
            .collect()
        }
        moved = [means.get(i, c) for i, c in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    centroids = tuple(
        Centroid(i + 1, {n: float(c * spread[n] + mean[n]) for n, c in zip(names, centre, strict=True)})
        for i, centre in enumerate(centres)
    )
    return Segmentation(centroids, spread, mean)


def centroid_table(df: DataFrame, segmentation: Segmentation) -> DataFrame:
    """Centres in long form ``(centroid_id, feature, numerical_value)``."""
    rows = [
        (c.centroid_id, name, value)
        for c in segmentation.centroids
        for name, value in c.values.items()
    ]
    return df.sparkSession.createDataFrame(
        rows, "centroid_id bigint, feature string, numerical_value double"
    )


def assign_segments(features: DataFrame, segmentation: Segmentation) -> DataFrame:
    """Input columns plus the nearest centre's id and the distances to all.

    The centres are literals in one projection: no join and no shuffle.  Distances
    are in standardised units, nearest first; ties go to the lower id.
    """

    def distance(centroid: Centroid) -> Column:
        total = F.lit(0.0)
        for name in segmentation.features:
            spread = F.lit(segmentation.spread[name])
            value = F.coalesce(F.col(name).cast("double"), F.lit(segmentation.mean[name]))
            gap = (value - F.lit(centroid.values[name])) / spread
            total = total + gap * gap
        return F.sqrt(total)

    distances = F.array_sort(
        F.array(
            *[
                F.struct(
                    distance(c).alias("distance"),
                    F.lit(c.centroid_id).cast("bigint").alias("centroid_id"),
                )
                for c in segmentation.centroids
            ]
        )
    )
    return (
        features.withColumn("nearest", distances)
        .withColumn("centroid_id", F.col("nearest")[0]["centroid_id"])
        .withColumn("nearest_centroids_distance", F.expr(
            "transform(nearest, n -> struct(n.centroid_id AS centroid_id, n.distance AS distance))"
        ))
        .drop("nearest")
    )


def segment_means(assigned: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Group means of assigned rows in the long form of :func:`centroid_table`."""
    means = assigned.groupBy("centroid_id").agg(
        *[F.avg(F.col(n).cast("double")).alias(n) for n in names]
    )
    return means.unpivot("centroid_id", list(names), "feature", "numerical_value")


def pivot_centroids(centroids: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row per centre with a rounded column per feature."""
    rounded = centroids.withColumn("value", F.round("numerical_value", 2))
    return rounded.groupBy("centroid_id").pivot("feature", list(names)).agg(F.sum("value"))


def persona_prompts(pivoted: DataFrame) -> DataFrame:
    """Prompt per centre; NULL if a feature is missing."""
    return pivoted.select(
        F.col("centroid_id").alias("cluster"),
        fill_template(
            PERSONA_PROMPT,
            centroid_id=F.col("centroid_id"),
            **{n: number_text(F.col(n)) for n in FEATURES},
        ).alias("prompt"),
    )


def parse_personas(answers: DataFrame, answer_col: str = RESULT) -> DataFrame:
    """Title and description out of the JSON answer, without their quotes."""

    def field(name: str) -> Column:
        return trim_set(json_text(F.col(answer_col), f"$.{name}"), '"').alias(name)

    return answers.select("cluster", field("persona_title"), field("persona_description"))


def personas(pivoted: DataFrame, provider: Provider, **options) -> DataFrame:
    """Prompt, ask and parse: cluster, persona_title, persona_description."""
    defaults = {"max_output_tokens": 800, "temperature": 0.8, "top_k": 40, "top_p": 0.8}
    asked = apply_model(
        persona_prompts(pivoted), "prompt", provider, **{**defaults, **options}
    )
    return parse_personas(asked)
