"""Declared schemas of the input tables and of the message landing tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "variant": T.VariantType(),
}


def _schema(columns: str) -> T.StructType:
    """Schema from ``name type`` pairs; needs no running session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Column names and types of the interface tables.
USERS = _schema(
    "id string, first_name string, last_name string, email string, age bigint, gender string, "
    "state string, street_address string, postal_code string, city string, country string, "
    "latitude double, longitude double, traffic_source string, created_at timestamp"
)
ORDER_ITEMS = _schema(
    "id string, order_id string, user_id string, product_id string, status string, "
    "created_at timestamp, shipped_at timestamp, delivered_at timestamp, returned_at timestamp, "
    "sale_price double"
)
PRODUCTS = _schema("id string, name string, category string, description string")
RAW_REVIEWS = _schema(
    "review_id string, order_id string, user_id string, product_id string, name string, "
    "review_rating string, review_text string"
)
ISO_639_CODES = _schema(
    "iso_639_2 string, iso_639_2b string, iso_639_1 string, language_name_en string, "
    "language_name_fr string, language_name_de string"
)
REVIEWS_PROMPTS = _schema(
    "message_id string, publish_time timestamp, review_id string, prompt string, "
    "model_version string, policy_version double, subscription_name string, attributes string, "
    "prompt_embedding string, review_embedding string, image_embedding string"
)
REVIEWS_RESPONSES = _schema(
    "publish_time timestamp, review_id string, response string, safety_attributes variant, "
    "message_id string, subscription_name string, attributes string, response_embedding string"
)
REFUNDS_PROMPTS = _schema(
    "message_id string, publish_time timestamp, user_id string, order_id string, "
    "product_id string, prompt string, model_version string, policy_version double, "
    "subscription_name string, attributes string, prompt_embedding string, "
    "feedback_embedding string, request_image_uri string"
)
REFUNDS_RESPONSES = _schema(
    "publish_time timestamp, user_id string, order_id string, product_id string, "
    "response string, safety_attributes variant, message_id string, subscription_name string, "
    "attributes string, response_embedding string"
)
REFUNDS = _schema(
    "message_id string, publish_time timestamp, product_id string, product_name string, "
    "refund_amount double, order_id string, email string, subscription_name string, "
    "attributes string"
)

# Input tables by name, and landing tables by the stream that feeds them.
TABLES = {
    "users": USERS,
    "order_items": ORDER_ITEMS,
    "products": PRODUCTS,
    "raw_reviews": RAW_REVIEWS,
    "iso_639_codes": ISO_639_CODES,
}
LANDING = {
    "reviews_prompts": REVIEWS_PROMPTS,
    "reviews_responses": REVIEWS_RESPONSES,
    "refunds_prompts": REFUNDS_PROMPTS,
    "refunds_responses": REFUNDS_RESPONSES,
    "refunds": REFUNDS,
}
# Columns the transport adds to every message.
METADATA = ("message_id", "publish_time", "subscription_name", "attributes")


def payload_schema(landing: T.StructType) -> T.StructType:
    """Fields of the JSON message body: the landing schema without metadata."""
    return T.StructType([f for f in landing.fields if f.name not in METADATA])
