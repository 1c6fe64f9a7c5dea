"""Customer reviews: newest snapshot, translation, sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxcart.functions.payload import scalar
from voxcart.functions.text import (
    KEY_DIGITS,
    fill_template,
    trim_space,
    unescape_apostrophes,
    uri_key,
)
from voxcart.operators.inference import RESULT, STATUS, Provider, apply_model
from voxcart.operators.joins import aggregate_for_join

# JSON paths of the translation and sentiment answers.
TRANSLATED_TEXT = "$.translations[0].translated_text"
DETECTED_LANGUAGE = "$.translations[0].detected_language_code"
SENTIMENT_SCORE = "$.document_sentiment.score"
SENTIMENT_MAGNITUDE = "$.document_sentiment.magnitude"

TRANSLATE_PROMPT = "Give the English translation of the following text: {review_text}"
SENTIMENT_PROMPT = (
    "Read this customer review and judge its sentiment: {review_text} "
    "Answer with one word out of positive, neutral and negative."
)


def latest_review_snapshot(
    reviews: DataFrame,
    order_items: DataFrame,
    review_images: DataFrame,
    digits: int = KEY_DIGITS,
    item_key: str = "id",
) -> DataFrame:
    """Newest row per review, order and product, with the review's image URI.

    Newest is by the matching order line's creation time, reviews without a line
    last; ties go to the smallest user, name, rating and text.  ``item_key`` is
    the order-line column the review's ``order_id`` refers to.

    Order lines that a review names are reduced to one creation time per join key, so
    the join never multiplies reviews.  A review's time depends on its keys alone: the
    newest user of a group is found without names and texts, which are shuffled once
    and meet the winners at the end.  ``row_number() = 1`` gives Spark a group limit
    before either shuffle: a group of many copies leaves each task as one row.
    """
    keys = ["review_id", "order_id", "product_id"]
    reviewed = aggregate_for_join(reviews, {"reviewed": "order_id"})
    lines = aggregate_for_join(
        order_items.join(reviewed, F.col(item_key) == F.col("reviewed"), "left_semi"),
        {
            "order_id": item_key,
            "user_id": "user_id",
            "product_id": F.col("product_id").cast("string"),
        },
        F.max("created_at").alias("created_at"),
    )
    newest = W.partitionBy(*keys).orderBy(F.desc_nulls_last("created_at"), "user_id")
    smallest = W.partitionBy("review_key").orderBy("name", "review_rating", "review_text")
    images = review_images.select("uri", uri_key("uri", digits).alias("review_id"))
    # A struct, as keys may be NULL and a join on the plain columns would lose those rows.
    review_key = F.struct(*keys, "user_id").alias("review_key")
    winners = (
        reviews.select(*keys, "user_id")
        .join(lines, ["user_id", "product_id", "order_id"], "left")
        .withColumn("rank", F.row_number().over(newest))
        .where("rank = 1")
        .join(images, "review_id", "left")
        .select(review_key, "uri")
    )
    texts = (
        reviews.select(review_key, "name", "review_rating", "review_text")
        .withColumn("rank", F.row_number().over(smallest))
        .where("rank = 1")
        .drop("rank")
    )
    return winners.join(texts, "review_key").select(
        "review_key.review_id",
        "review_key.order_id",
        "review_key.user_id",
        "review_key.product_id",
        "name",
        "review_rating",
        "review_text",
        "uri",
    )


def translated_reviews(reviews: DataFrame, languages: DataFrame) -> DataFrame:
    """Translated text and language name out of ``ml_translate_result``.

    The original text stays as ``review_text_raw``; a language that the code
    table lacks gives NULL.
    """
    answer = F.col("ml_translate_result")
    names = languages.select(
        F.col("iso_639_1").alias("language_code"),
        F.col("language_name_en").alias("review_language"),
    )
    prepared = reviews.withColumn("language_code", trim_space(scalar(answer, DETECTED_LANGUAGE)))
    consumed = ["review_text", "text_content", "ml_translate_result", "ml_translate_status"]
    passed = [c for c in reviews.columns if c not in consumed]
    return prepared.join(names, "language_code", "left").select(
        *passed,
        F.col("review_text").alias("review_text_raw"),
        unescape_apostrophes(trim_space(scalar(answer, TRANSLATED_TEXT))).alias("review_text"),
        "review_language",
    )


def translate(
    reviews: DataFrame, languages: DataFrame, provider: Provider, **options
) -> DataFrame:
    """Ask the translation model, then :func:`translated_reviews`."""
    asked = apply_model(
        reviews.withColumn("text_content", F.col("review_text")),
        "text_content",
        provider,
        result_col="ml_translate_result",
        rating_col=None,
        status_col="ml_translate_status",
        **{"translate_mode": "translate_text", "target_language_code": "en", **options},
    )
    return translated_reviews(asked, languages)


def sentiment_label(score: Column) -> Column:
    return (
        F.when(score > 0, "positive")
        .when(score < 0, "negative")
        .when(score == 0, "neutral")
        .otherwise("unknown")
    )


def score_sentiment(reviews: DataFrame) -> DataFrame:
    """Label, magnitude and score out of ``ml_understand_text_result``."""
    answer = F.col("ml_understand_text_result")
    score = scalar(answer, SENTIMENT_SCORE).try_cast("double")
    magnitude = scalar(answer, SENTIMENT_MAGNITUDE).try_cast("double")
    return reviews.select(
        "*",
        sentiment_label(score).alias("sentiment"),
        magnitude.alias("sentiment_magnitude"),
        score.alias("sentiment_score"),
    ).drop("text_content", "ml_understand_text_result", "ml_understand_text_status")


def analyze_sentiment(reviews: DataFrame, provider: Provider, **options) -> DataFrame:
    """Ask the sentiment model, then :func:`score_sentiment`."""
    asked = apply_model(
        reviews.withColumn("text_content", F.col("review_text")),
        "text_content",
        provider,
        result_col="ml_understand_text_result",
        rating_col=None,
        status_col="ml_understand_text_status",
        **{"nlu_option": "ANALYZE_SENTIMENT", **options},
    )
    return score_sentiment(asked)


def translate_by_prompt(reviews: DataFrame, provider: Provider, **options) -> DataFrame:
    """Translation by a general text model: raw text, answer, other columns."""
    prompted = reviews.withColumn(
        "prompt", fill_template(TRANSLATE_PROMPT, review_text=F.col("review_text"))
    )
    defaults = {"max_output_tokens": 800, "temperature": 0.8, "top_k": 40, "top_p": 0.8}
    asked = apply_model(prompted, "prompt", provider, **{**defaults, **options})
    rest = [c for c in asked.columns if c not in ("review_text", RESULT, STATUS)]
    return asked.select(
        F.col("review_text").alias("review_text_raw"),
        F.col(RESULT).alias("review_text"),
        *rest,
    )


def sentiment_by_prompt(reviews: DataFrame, provider: Provider, **options) -> DataFrame:
    """Sentiment word by a general text model, for every review row.

    The answer depends on the review text alone, and equal texts share one call,
    so the answer is attached to the rows directly.  Joining the asked reviews
    back by ``review_id`` gives the same rows for unique ids, without pairing all
    copies of a repeated id with each other.
    """
    prompted = reviews.withColumn(
        "prompt", fill_template(SENTIMENT_PROMPT, review_text=F.col("review_text"))
    )
    defaults = {"max_output_tokens": 800, "temperature": 0.3, "top_k": 40, "top_p": 0.8}
    asked = apply_model(
        prompted,
        "prompt",
        provider,
        result_col="review_sentiment",
        rating_col=None,
        status_col=None,
        **{**defaults, **options},
    )
    return asked.drop("prompt")


def sentiment_join_back(answers: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every answer with the review rows of its ``review_id``, NULL if there is none.

    A left join cannot be split on a review id that repeats on the right, an inner
    join can; so the answers without a review are added apart.  ``answers`` holds
    one row per review id.
    """
    matched = reviews.join(answers, "review_id", "inner")
    known = reviews.select("review_id").distinct()
    unmatched = answers.join(known, "review_id", "left_anti")
    return matched.select(*reviews.columns, "review_sentiment").unionByName(
        unmatched.select("review_id", "review_sentiment"), allowMissingColumns=True
    )
