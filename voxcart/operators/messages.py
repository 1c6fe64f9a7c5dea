"""Message bodies for the prompt, response and refund streams, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys of each message body.
REVIEW_PROMPT = (
    "review_id",
    "review_embedding",
    "prompt",
    "prompt_embedding",
    "image_embedding",
    "model_version",
    "policy_version",
)
REVIEW_RESPONSE = ("review_id", "response", "safety_attributes", "response_embedding")
REFUND_PROMPT = (
    "feedback_embedding",
    "prompt",
    "prompt_embedding",
    "request_image_uri",
    "model_version",
    "policy_version",
    "user_id",
    "order_id",
    "product_id",
)
REFUND_RESPONSE = (
    "order_id",
    "product_id",
    "user_id",
    "response",
    "safety_attributes",
    "response_embedding",
)
REFUND = ("product_id", "product_name", "refund_amount", "order_id", "email")


def _field(df: DataFrame, name: str) -> Column:
    """A body field; embeddings are JSON text inside the JSON body."""
    if name not in df.columns:
        return F.lit(None).cast("string").alias(name)
    is_array = dict(df.dtypes)[name].startswith("array")
    value = F.to_json(F.col(name)) if is_array else F.col(name)
    return value.alias(name)


def message(df: DataFrame, fields: tuple[str, ...], key: tuple[str, ...]) -> DataFrame:
    """One ``(key, value)`` message per row; ``value`` is the JSON body.

    Fields without a value are written as JSON null.
    """
    body = F.to_json(
        F.struct(*[_field(df, name) for name in fields]), {"ignoreNullFields": "false"}
    )
    return df.select(F.concat_ws("/", *key).alias("key"), body.alias("value"))


def emit(messages: DataFrame, path: str | None = None, **kafka_options: str) -> None:
    """Append messages to a folder of text files, or to Kafka if options are given."""
    if path is not None:
        messages.select("value").write.mode("append").text(path)
    else:
        messages.write.format("kafka").options(**kafka_options).save()
