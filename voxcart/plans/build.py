"""Build order of the tables, each from the ones before it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxcart import schemas
from voxcart.functions.measures import instant
from voxcart.functions.text import KEY_DIGITS
from voxcart.operators import (
    campaign,
    cases,
    customers,
    documents,
    lineage,
    outbox,
    refunds,
    reviews,
)
from voxcart.operators.inference import Provider
from voxcart.sources.landing import decode, landing_table
from voxcart.sources.tables import save_table


@dataclass(frozen=True)
class Inputs:
    """The tables and file listings a build starts from; steps without theirs are left out."""

    raw_reviews: DataFrame
    order_items: DataFrame
    iso_639_codes: DataFrame
    review_images: DataFrame
    inventory_images: DataFrame
    service_policy: DataFrame
    users: DataFrame | None = None
    products: DataFrame | None = None
    refund_requests: DataFrame | None = None


@dataclass(frozen=True)
class Models:
    """User-supplied providers by task."""

    translate: Provider
    sentiment: Provider
    read_page: Provider
    persona: Provider
    resolve: Provider
    rewrite: Provider | None = None
    email: Provider | None = None
    claim: Provider | None = None
    embedders: dict[str, Provider] = field(default_factory=dict)


@dataclass(frozen=True)
class Settings:
    start: str
    end: str
    as_of: object = None
    notice: str = ""
    digits: int = KEY_DIGITS
    page_pattern: str = documents.PAGE_PATTERN
    prefix: str = ""
    level: str = "item"
    product_1: str = ""
    product_2: str = ""
    image_root: str = ""
    model_version: str = "1"
    campaign: dict[str, str] = field(default_factory=dict)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}"


def land(messages: DataFrame, landing: T.StructType, path: str, as_of=None) -> DataFrame:
    """Messages to their landing table, known by their content, and the table.

    A build that is run again lands nothing twice within the hour of ``as_of``.
    """
    table = landing_table(messages.sparkSession, path, landing)
    envelope = messages.select(
        F.sha2(F.concat_ws("|", "key", "value"), 256).alias("message_id"),
        instant(as_of).alias("publish_time"),
        F.col("value").alias("data"),
    )
    table.admit(decode(envelope, landing))
    return table.read()


def build_all(inputs: Inputs, models: Models, settings: Settings) -> dict[str, DataFrame]:
    """Create or replace every table in dependency order.

    Each step reads the table the step before wrote, so no model is asked twice
    and a failed build goes on from the last table.
    """
    built: dict[str, DataFrame] = {}
    spark = inputs.raw_reviews.sparkSession

    def save(name: str, df: DataFrame) -> DataFrame:
        built[name] = save_table(df, f"{settings.prefix}{name}")
        return built[name]

    joined = save(
        "raw_reviews_joined",
        reviews.latest_review_snapshot(
            inputs.raw_reviews, inputs.order_items, inputs.review_images, settings.digits
        ),
    )
    translated = save(
        "reviews_joined_translated",
        reviews.translate(joined, inputs.iso_639_codes, models.translate),
    )
    cleaned = save("cleaned_reviews", reviews.analyze_sentiment(translated, models.sentiment))
    pages = documents.read_pages(inputs.service_policy, models.read_page)
    policy = save(
        "complete_service_policy",
        documents.assemble_document(pages, settings.notice, pattern=settings.page_pattern),
    )
    features = save(
        "rfm_features",
        customers.rfm_features(
            inputs.order_items, settings.start, settings.end, settings.as_of, settings.level
        ),
    )
    segmentation = customers.fit_segments(features)
    save("customer_segments", customers.assign_segments(features, segmentation))
    pivoted = customers.pivot_centroids(customers.centroid_table(features, segmentation))
    personas = save("customer_personas", customers.personas(pivoted, models.persona))

    case_inputs = cases.review_case_inputs(
        cases.negative_with_image(cleaned), inputs.inventory_images, policy, settings.digits
    )
    answered = save("answered_cases", cases.answer_cases(cases.case_prompts(case_inputs), models.resolve))
    save("review_resolutions", cases.parse_resolutions(answered))
    prompts, responses = cases.review_messages(answered, settings.model_version, models.embedders)
    for name, messages, landing, clean in (
        ("prompts", prompts, schemas.REVIEWS_PROMPTS, lineage.clean_prompts),
        ("responses", responses, schemas.REVIEWS_RESPONSES, lineage.clean_responses),
    ):
        path = _folder(spark, f"{settings.prefix}reviews_{name}")
        built[f"reviews_{name}"] = land(messages, landing, path, settings.as_of)
        save(f"cleaned_{name}", clean(built[f"reviews_{name}"], settings.as_of))

    if models.rewrite and models.email and inputs.users is not None and inputs.products is not None:
        context = save(
            "campaign_context",
            campaign.campaign_context(
                features, segmentation, inputs.products, personas, inputs.users,
                settings.product_1, settings.product_2,
            ),
        )
        asked = campaign.copy_prompts(
            context, inputs.inventory_images, inputs.products, settings.product_1,
            settings.digits, **settings.campaign,
        )
        rewritten = save("rewritten_copy", campaign.rewrite_product_copy(asked, models.rewrite))
        save("product_descriptions", campaign.product_descriptions(rewritten))
        save(
            "emails",
            campaign.draft_emails(
                campaign.email_prompts(rewritten, **settings.campaign), models.email
            ),
        )
    if models.claim and inputs.refund_requests is not None and inputs.users is not None:
        eligible = save(
            "refund_eligibility",
            refunds.refund_eligibility(
                inputs.refund_requests, inputs.order_items, inputs.inventory_images,
                inputs.products, inputs.users, policy, settings.as_of, digits=settings.digits,
            ),
        )
        claims = save(
            "answered_claims",
            refunds.answer_claims(refunds.claim_prompts(eligible, settings.image_root), models.claim),
        )
        decisions = save("refund_decisions", refunds.refund_decisions(claims))
        path = _folder(spark, f"{settings.prefix}refund_outbox")
        outbox.admit(spark, path, refunds.refund_events(decisions))
        sent = outbox.outbox(spark, path).read().withColumnRenamed("value", "data")
        built["refunds"] = decode(sent, schemas.REFUNDS)
    return built
