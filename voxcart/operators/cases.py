"""Cases for negative reviews: inputs, resolution by a model, lineage messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcart.functions.payload import repaired, strict_string
from voxcart.functions.text import KEY_DIGITS, MISSING, fill_template, uri_key
from voxcart.operators.documents import attach_latest_policy
from voxcart.operators.inference import RATING, RESULT, STATUS, Provider, apply_model, embed
from voxcart.operators.messages import REVIEW_PROMPT, REVIEW_RESPONSE, message

RESOLUTION_PROMPT = (
    "You work in the customer service of {company}. A customer wrote this review: {review_text} "
    "Its language is {language}. Our service policy says: {policy} "
    "State the problem and how the policy resolves it, write the customer an e-mail in the "
    "language of the review, and give that e-mail in English as well. Answer with a flat JSON "
    "object that has the fields issue_resolution, response_user_language and response_translated."
)


def negative_with_image(reviews: DataFrame) -> DataFrame:
    return reviews.where((F.col("sentiment") == "negative") & F.col("uri").isNotNull())


def review_case_inputs(
    reviews: DataFrame,
    inventory_images: DataFrame,
    policy: DataFrame,
    digits: int = KEY_DIGITS,
    review_id: str | None = None,
) -> DataFrame:
    """Review, product image and latest policy per review.

    Done for all reviews in one join; ``review_id`` restricts it to one.  A review
    whose product has no image gives no row.
    """
    if review_id is not None:
        reviews = reviews.where(F.col("review_id") == review_id)
    images = inventory_images.select(
        F.col("uri").alias("inventory_image_uri"), uri_key("uri", digits).alias("product_id")
    )
    cases = reviews.select(
        "review_id",
        "review_text",
        "review_language",
        F.col("uri").alias("review_image_uri"),
        "product_id",
    ).join(images, "product_id", "inner")
    return attach_latest_policy(cases, policy).select(
        "review_id",
        "review_text",
        "review_language",
        "review_image_uri",
        "product_id",
        "inventory_image_uri",
        "service_policy_text",
        "policy_version",
    )


def case_prompts(inputs: DataFrame, company: str = "our shop") -> DataFrame:
    """Inputs with a prompt column; a missing text or language is named as such.

    Without a policy the prompt is NULL.
    """
    return inputs.withColumn(
        "prompt",
        fill_template(
            RESOLUTION_PROMPT,
            company=F.lit(company),
            review_text=F.coalesce("review_text", F.lit(MISSING)),
            language=F.coalesce("review_language", F.lit(MISSING)),
            policy=F.col("service_policy_text"),
        ),
    )


def answer_cases(prompts: DataFrame, provider: Provider, **options) -> DataFrame:
    """Ask the model once per case.

    This is lazy: a result with several consumers is to be saved first, or kept in a store.
    """
    defaults = {"max_output_tokens": 2048, "temperature": 0.7, "top_k": 32, "top_p": 1.0}
    return apply_model(prompts, "prompt", provider, **{**defaults, **options})


def parse_resolutions(answered: DataFrame) -> DataFrame:
    """The three answer fields; NULL where the answer has no such string.

    ``parse_status`` tells a usable answer from a failed call and from text that
    is no JSON even after repair.
    """
    parsed = answered.withColumn("document", repaired(F.col(RESULT)))
    document = F.col("document")
    status = (
        F.when(F.col(STATUS) != "", F.col(STATUS))
        .when(document.isNull(), "not_json")
        .otherwise("")
    )
    return parsed.select(
        "review_id",
        strict_string(document, "$.issue_resolution").alias("issue_resolution"),
        strict_string(document, "$.response_user_language").alias("email_user_language"),
        strict_string(document, "$.response_translated").alias("email_translated"),
        status.alias("parse_status"),
    )


def review_messages(
    answered: DataFrame, model_version: str, embedders: dict[str, Provider] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Prompt messages of all cases that were asked, response messages of those answered.

    ``embedders`` may hold providers under ``text`` and ``image``; without one the
    embedding is NULL, as it is for a review without an image.
    """
    df = answered.withColumn("model_version", F.lit(model_version)).withColumn(
        "response", F.col(RESULT)
    )
    df = df.withColumn("safety_attributes", F.col(RATING))
    asked = df.where(F.col("prompt").isNotNull())
    embedders = embedders or {}
    vectors = {}
    if "text" in embedders:
        vectors["review_embedding"] = ("review_text", embedders["text"])
        vectors["prompt_embedding"] = ("prompt", embedders["text"])
        vectors["response_embedding"] = ("response", embedders["text"])
    if "image" in embedders:
        vectors["image_embedding"] = ("review_image_uri", embedders["image"])
    if vectors:
        asked = embed(asked, vectors)
    return (
        message(asked, REVIEW_PROMPT, ("review_id",)),
        message(asked.where(F.col(STATUS) == ""), REVIEW_RESPONSE, ("review_id",)),
    )


def resolve_reviews(
    reviews: DataFrame,
    inventory_images: DataFrame,
    policy: DataFrame,
    provider: Provider,
    digits: int = KEY_DIGITS,
    company: str = "our shop",
    **options,
) -> DataFrame:
    """Negative reviews with an image, answered and parsed."""
    inputs = review_case_inputs(negative_with_image(reviews), inventory_images, policy, digits)
    return parse_resolutions(answer_cases(case_prompts(inputs, company), provider, **options))
