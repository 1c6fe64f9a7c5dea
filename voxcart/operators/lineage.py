"""Lineage: cleaned prompts and responses, safety ratings, usage, pairing.

The cleaning functions are projections without a shuffle, so the same code runs
on a batch and on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcart.functions.measures import cosine, hours_since, instant
from voxcart.functions.payload import flat_vector_text, unless_container, unwrap
from voxcart.functions.text import trim_space
from voxcart.operators.joins import aggregate_for_join

# Embedding keys, published name first, then the name older
# messages use; and the order of the safety categories in a rating.
PROMPT_VECTORS = {
    "prompt_embedding": ("prompt_embedding", "text_embed"),
    "review_embedding": ("review_embedding", "review_embed"),
    "image_embedding": ("image_embedding", "image_embed"),
}
RESPONSE_VECTORS = {"response_embedding": ("response_embedding", "embedding")}
SAFETY_CATEGORIES = ("hate_speech", "dangerous_content", "harassment", "sexually_explicit")


def _open(messages: DataFrame, *keys: str) -> tuple[DataFrame, dict[str, Column]]:
    """Message rows with an ``original`` variant, and the scalar text of each key.

    An envelope is parsed once for the variant and once for all keys together.  The
    generator keeps the filter on an embedding above the parse instead of letting
    it repeat the parse below.
    """
    if "data" not in messages.columns:
        body = [c for c in messages.columns if c not in ("attributes", "subscription_name")]
        rows = messages.withColumn("original", F.to_variant_object(F.struct(*body)))
        have = [k for k in keys if k in messages.columns]
        return rows, {
            k: F.col(k).cast("string") if k in have else F.lit(None).cast("string") for k in keys
        }
    rows = messages.withColumn("original", F.try_parse_json("data")).select(
        "*", F.json_tuple("data", *keys).alias(*[f"body_{k}" for k in keys])
    )
    return rows, {
        k: unless_container(F.col(f"body_{k}"), F.col("original"), f"$.{k}") for k in keys
    }


def _vectors(values: dict[str, Column], names: dict[str, tuple[str, ...]]) -> list[Column]:
    return [
        flat_vector_text(F.coalesce(*[values[k] for k in keys])).alias(name)
        for name, keys in names.items()
    ]


def _all_keys(names: dict[str, tuple[str, ...]]) -> list[str]:
    return [k for keys in names.values() for k in keys]


def clean_prompts(messages: DataFrame, as_of=None) -> DataFrame:
    """Typed prompt rows with flat embeddings and hours since publishing.

    ``messages`` is either an envelope with the JSON body in ``data`` or the flat
    landing table.  Rows without a prompt embedding are dropped.
    """
    plain = ("review_id", "prompt", "model_version", "policy_version")
    rows, values = _open(messages, *plain, *_all_keys(PROMPT_VECTORS))
    return rows.select(
        F.col("original").alias("original_message"),
        "publish_time",
        values["review_id"].alias("review_id"),
        trim_space(values["prompt"]).alias("prompt"),
        values["model_version"].alias("model_version"),
        values["policy_version"].alias("policy_version"),
        "subscription_name",
        "attributes",
        hours_since(F.col("publish_time"), instant(as_of)).alias("hours_since_prompt"),
        *_vectors(values, PROMPT_VECTORS),
    ).where("prompt_embedding IS NOT NULL")


def clean_responses(messages: DataFrame, as_of=None) -> DataFrame:
    """Typed response rows; rows without a response embedding are dropped."""
    rows, values = _open(messages, "review_id", "response", *_all_keys(RESPONSE_VECTORS))
    if "data" in messages.columns:
        safety = F.try_variant_get("original", "$.safety_attributes", "variant")
    else:
        safety = F.col("safety_attributes")
    return rows.select(
        F.col("original").alias("original_message"),
        "publish_time",
        values["review_id"].alias("review_id"),
        values["response"].alias("response"),
        safety.alias("safety_attributes"),
        "message_id",
        "subscription_name",
        "attributes",
        hours_since(F.col("publish_time"), instant(as_of)).alias("hours_since_prompt"),
        *_vectors(values, RESPONSE_VECTORS),
    ).where("response_embedding IS NOT NULL")


def flatten_safety(responses: DataFrame) -> DataFrame:
    """The rating list as one struct per category; the list comes last.

    The rating may be a variant or text, and a list inside a JSON string.
    """
    rating = F.col("safety_attributes")
    if dict(responses.dtypes)["safety_attributes"] == "string":
        rating = F.try_parse_json(rating)
    with_rating = responses.withColumn("rating", unwrap(rating))

    def category(position: int) -> Column:
        def field(name: str, kind: str) -> Column:
            return F.try_variant_get("rating", f"$[{position}].{name}", kind).alias(name)

        return F.struct(
            field("blocked", "boolean"),
            field("probability_score", "double"),
            field("severity_score", "double"),
        )

    rest = [c for c in responses.columns if c != "safety_attributes"]
    return with_rating.select(
        *rest,
        *[category(i).alias(name) for i, name in enumerate(SAFETY_CATEGORIES)],
        "safety_attributes",
    )


def hourly_usage(prompts: DataFrame) -> DataFrame:
    """Prompts per hour and model version (derived from the lineage tables)."""
    return prompts.groupBy(
        F.date_trunc("hour", "publish_time").alias("publish_hour"), "model_version"
    ).agg(F.count("*").alias("prompts"))


def with_latest_response(
    prompts: DataFrame, responses: DataFrame, keys: tuple[str, ...] = ("review_id",)
) -> DataFrame:
    """Every prompt with the latest response of its key, whichever prompt that answers.

    Responses are reduced to one row per key on the map side first, so a key with
    many prompts and responses gives as many rows as it has prompts.  For the response that
    belongs to a prompt see ``operators.pairing``.
    """
    latest = aggregate_for_join(
        responses,
        {key: key for key in keys},
        F.max(F.struct(F.col("publish_time").alias("response_time"), "response")).alias("latest"),
        F.count("*").alias("responses"),
    )
    return prompts.join(latest, list(keys), "left").select(
        *prompts.columns,
        F.col("latest.response_time").alias("response_time"),
        F.col("latest.response").alias("response"),
        F.coalesce("responses", F.lit(0)).alias("responses"),
    )


def similarity_to(
    df: DataFrame, vector_col: str, query: Column, output: str = "similarity"
) -> DataFrame:
    """Cosine of each stored vector to one query vector: a single scan.

    ``query`` may be a scalar subquery; lambdas cannot hold one, so it becomes a
    column first.
    """
    held = df.withColumn("query_vector", query)
    return held.withColumn(output, cosine(F.col(vector_col), F.col("query_vector"))).drop(
        "query_vector"
    )
