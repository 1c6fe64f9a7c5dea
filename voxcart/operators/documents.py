"""Documents put together from the texts of their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcart.functions.payload import scalar
from voxcart.functions.text import (
    PAGE_PATTERN,
    clean_page_text,
    fill_template,
    page_number,
    trim_set,
    trim_space,
)
from voxcart.operators.inference import RESULT, Provider, apply_model

# Where the page text stands in the answer, the cover pages that
# are left out, and the version given to the result.
PAGE_TEXT = "$.full_text_annotation.text"
COVER_PAGES = 2
VERSION = 1.0

PARSE_PROMPT = "Write down the text that this page image shows: {uri}"


def _without_notice(text: Column, notice: str, mode: str) -> Column:
    """Take the page notice off a page.

    ``characters`` strips any character of the notice from both ends, which also
    eats into the text; ``phrase`` removes the notice as a whole.
    """
    if mode == "characters":
        return trim_set(text, notice)
    if mode == "phrase":
        return trim_space(F.replace(text, F.lit(notice), F.lit("")))
    raise ValueError(f"unknown mode {mode!r}")


def assemble_document(
    pages: DataFrame,
    notice: str,
    keys: list[str] | None = None,
    mode: str = "phrase",
    cover_pages: int = COVER_PAGES,
    version: float = VERSION,
    pattern: str = PAGE_PATTERN,
    pages_per_part: int | None = None,
    clean: bool = True,
) -> DataFrame:
    """Pages (``uri``, ``page_text``) in page order as one text per document.

    Without ``keys`` all pages are one document and the result is one row, with
    an empty text if no page is left.  A document is one cell of the result, so
    its size bounds what one task holds.  ``pages_per_part`` bounds that: a row
    takes at most so many page numbers, and a longer document goes on in further
    rows, numbered from 0 in ``part_number``.
    """
    text = clean_page_text(F.col("page_text")) if clean else F.col("page_text")
    number = page_number(F.col("uri"), pattern)
    prepared = pages.select(
        *(keys or []), "uri", number.alias("page_number"), text.alias("text_content")
    )
    kept = F.when(
        F.col("page_number") > cover_pages, _without_notice(F.col("text_content"), notice, mode)
    )
    prepared = prepared.withColumn("kept", kept)
    groups = list(keys or [])
    if pages_per_part:
        first = F.lit(cover_pages + 1)
        part = F.floor((F.col("page_number") - first) / pages_per_part)
        prepared = prepared.withColumn(
            "part_number", F.greatest(F.coalesce(part, F.lit(0)), F.lit(0)).cast("bigint")
        )
        groups.append("part_number")
    joined = F.expr("listagg(kept, ' ') WITHIN GROUP (ORDER BY page_number, uri)")
    assembled = prepared.groupBy(*groups).agg(
        F.coalesce(joined, F.lit("")).alias("service_policy_text")
    )
    return assembled.withColumn("version_number", F.lit(version))


def read_pages(images: DataFrame, provider: Provider, **options) -> DataFrame:
    """Page texts of an image listing: ask the text-detection model per URI."""
    asked = apply_model(
        images,
        "uri",
        provider,
        result_col="ml_annotate_image_result",
        rating_col=None,
        status_col="ml_annotate_image_status",
        **{"vision_features": ["DOCUMENT_TEXT_DETECTION"], **options},
    )
    return asked.withColumn("page_text", scalar(F.col("ml_annotate_image_result"), PAGE_TEXT))


def read_pages_by_prompt(images: DataFrame, provider: Provider, **options) -> DataFrame:
    """Page texts by a general text model that is given the URI in its prompt."""
    prompted = images.withColumn("prompt", fill_template(PARSE_PROMPT, uri=F.col("uri")))
    defaults = {"max_output_tokens": 1600, "temperature": 0.2, "top_k": 40, "top_p": 0.3}
    asked = apply_model(prompted, "prompt", provider, **{**defaults, **options})
    return asked.withColumnRenamed(RESULT, "page_text")


def latest_version(policy: DataFrame) -> DataFrame:
    """Rows of the highest ``version_number``; all of them if tied."""
    newest = policy.agg(F.max("version_number")).scalar()
    return policy.where(F.col("version_number") == newest)


def first_of_version(policy: DataFrame) -> DataFrame:
    """One row per version: of tied texts the first."""
    return policy.groupBy("version_number").agg(
        F.min("service_policy_text").alias("service_policy_text")
    ).select("service_policy_text", "version_number")


def attach_latest_policy(df: DataFrame, policy: DataFrame) -> DataFrame:
    """Every row of ``df`` with the text and number of the latest policy version.

    The newest number is a scalar subquery put on the rows, and the policy rows
    join on it as an ordinary key: Spark broadcasts them if its statistics or the
    measured shuffle say that they are small, else AQE splits the one hot key.
    """
    newest = policy.agg(F.max("version_number")).scalar()
    texts = latest_version(policy).select(
        "service_policy_text", F.col("version_number").alias("policy_version")
    )
    return df.withColumn("policy_version", newest).join(texts, "policy_version", "inner")
