"""Campaign: one wide row per customer, product copy, e-mails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcart.functions.payload import json_text
from voxcart.functions.text import KEY_DIGITS, fill_template, trim_space, uri_key
from voxcart.operators.customers import Segmentation, assign_segments
from voxcart.operators.inference import RATING, RESULT, STATUS, Provider, apply_model

COPY_PROMPT = (
    "You write product texts for {company}. Describe the product in this image anew for "
    "{first_name} {last_name}, aged {age}, from {state}, {country}, who matches the persona "
    "{persona_title}: {persona_description} The present description is: {product_1_description}"
)
EMAIL_PROMPT = (
    "You write customer e-mails for {company}. Write to {first_name} {last_name}, aged {age}, "
    "from {state}, {country}, who matches the persona {persona_title}: {persona_description} "
    "{occasion} Offer {discount} off the next purchase. Tone: {tone}. "
    "Recommend {product_1_name}, described as: {output} "
    "Also recommend {product_2_name}, described as: {product_2_description} "
    "If {country} is not {home_country}, add a translation to {language}. "
    "Answer with a flat JSON object that has the fields email_english and email_translated."
)
# Settings of a campaign that a caller may replace.
CAMPAIGN = {
    "company": "our shop",
    "occasion": "Apologise for the trouble with the last order.",
    "discount": "10%",
    "tone": "warm and direct",
    "home_country": "United States",
    "language": "Portuguese",
}
CONTEXT = (
    "first_name",
    "last_name",
    "age",
    "state",
    "country",
    "persona_title",
    "persona_description",
)


def campaign_context(
    features: DataFrame,
    segmentation: Segmentation,
    products: DataFrame,
    personas: DataFrame,
    users: DataFrame,
    product_1: str,
    product_2: str,
) -> DataFrame:
    """Segment, persona, user and two chosen products on one row per customer.

    A product is chosen by name: a scalar subquery puts its name and description
    on every row, NULL if there is none, and an error if the name is not unique.
    """

    def chosen(name: str):
        return (
            products.where(F.col("name") == name).select(F.struct("name", "description")).scalar()
        )

    assigned = assign_segments(features, segmentation).drop("nearest_centroids_distance")
    people = users.select(
        F.col("id").alias("user_id"),
        "age",
        "state",
        "country",
        "first_name",
        "last_name",
        F.col("email").alias("user_email"),
    )
    titles = personas.withColumnRenamed("cluster", "centroid_id")
    joined = assigned.join(titles, "centroid_id", "inner").join(people, "user_id", "inner")
    with_products = joined.withColumn("p1", chosen(product_1)).withColumn("p2", chosen(product_2))
    return with_products.select(
        "centroid_id",
        *[c for c in features.columns],
        "persona_title",
        "persona_description",
        "age",
        "state",
        "country",
        F.col("p1.name").alias("product_1_name"),
        F.col("p1.description").alias("product_1_description"),
        F.col("p2.name").alias("product_2_name"),
        F.col("p2.description").alias("product_2_description"),
        "first_name",
        "last_name",
        "user_email",
    )


def copy_prompts(
    context: DataFrame,
    inventory_images: DataFrame,
    products: DataFrame,
    product_1: str,
    digits: int = KEY_DIGITS,
    **settings: str,
) -> DataFrame:
    """Context rows with the image of product 1 and a rewrite prompt.

    The prompt is a column, so one plan serves every customer.  The image is the
    one whose file name carries the product's id; without one there are no rows.
    """
    product_id = products.where(F.col("name") == product_1).select("id").scalar()
    images = inventory_images.select("uri", uri_key("uri", digits).alias("image_key"))
    fixed = {k: F.lit(v) for k, v in {**CAMPAIGN, **settings}.items()}
    prompt = fill_template(
        COPY_PROMPT,
        company=fixed["company"],
        product_1_description=F.col("product_1_description"),
        **{c: F.col(c) for c in CONTEXT},
    )
    return (
        context.withColumn("prompt", prompt)
        .withColumn("image_key", product_id)
        .join(images.where(F.col("image_key") == product_id), "image_key", "inner")
        .drop("image_key")
    )


def rewrite_product_copy(prompts: DataFrame, provider: Provider, **options) -> DataFrame:
    """Prompted rows with the new product text as ``output`` and its rating."""
    defaults = {"max_output_tokens": 2048, "temperature": 1.0, "top_k": 40, "top_p": 1.0}
    asked = apply_model(prompts, "prompt", provider, **{**defaults, **options})
    return asked.withColumnRenamed(RESULT, "output").drop("prompt", STATUS)


def product_descriptions(rewritten: DataFrame) -> DataFrame:
    """New product text with cluster, persona title, rating and image.

    ``user_id`` stands in front, because all customers are done at once.
    """
    return rewritten.select(
        "user_id", F.col("centroid_id").alias("cluster"), "persona_title", RATING, "output", "uri"
    )


def email_prompts(rewritten: DataFrame, **settings: str) -> DataFrame:
    """Context rows with an e-mail prompt that holds the new text of product 1.

    The rewritten rows still carry the context, so nothing is joined back.
    """
    fixed = {k: F.lit(v) for k, v in {**CAMPAIGN, **settings}.items()}
    used = (*CONTEXT, "product_1_name", "product_2_name", "product_2_description", "output")
    prompt = fill_template(EMAIL_PROMPT, **{c: F.col(c) for c in used}, **fixed)
    return rewritten.withColumn("prompt", prompt).drop("output", "uri", RATING)


def draft_emails(prompts: DataFrame, provider: Provider, **options) -> DataFrame:
    """Ask for the e-mails; ``email_english`` keeps its JSON quotes."""
    defaults = {"max_output_tokens": 4000, "temperature": 1.0, "top_k": 40, "top_p": 1.0}
    asked = apply_model(prompts, "prompt", provider, **{**defaults, **options})
    return asked.select(
        json_text(trim_space(F.col(RESULT)), "$.email_english").alias("email_english"),
        *[c for c in asked.columns if c != RESULT],
    )
