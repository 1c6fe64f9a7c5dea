"""Named queries over the test tables, one or more per operator.

Each takes ``(spark, folder)``.  Struct, array and variant columns are flattened
so that the results can be compared with another engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcart import schemas
from voxcart.functions import payload, text
from voxcart.functions.measures import days_before, hours_since, instant, whole_minutes
from voxcart.operators import (
    campaign,
    cases,
    customers,
    documents,
    files,
    lineage,
    messages,
    neighbours,
    outbox,
    pairing,
    refunds,
    reviews,
)
from voxcart.operators.inference import RESULT, STATUS, AnswerStore, apply_model, embed
from voxcart.plans import local_models as models
from voxcart.plans.standins import (
    AS_OF,
    DIGITS,
    IMAGE_ROOT,
    NOTICE,
    PAGE_PATTERN,
    PRODUCT_1,
    PRODUCT_2,
    RANGE,
    SEGMENTATION,
    STREAM_AS_OF,
    StandIns,
    key,
)
from voxcart.session import SETTINGS, checkpoint_root, materialize
from voxcart.sources.files import list_files
from voxcart.sources.landing import (
    decode,
    dedupe,
    landing_table,
    read_hourly,
    read_landed,
    with_hour,
    write_hourly,
)
from voxcart.sources.tables import open_table, run_query, save_table, temp_table
from voxcart.streaming import landing, totals
from voxcart.streaming import pairing as stream_pairing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(body: Callable[[StandIns], DataFrame]) -> Callable[[StandIns], DataFrame]:
    """Register ``body`` under its own name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        for setting, value in SETTINGS.items():
            spark.conf.set(setting, value)
        return body(StandIns(spark, folder))

    QUERIES[body.__name__] = run
    return body


def _scratch(s: StandIns, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_root(s.spark)}/voxcart-{name}-{uuid.uuid4()}"


# Reviews


@query
def latest_review_snapshot(s):
    return s.snapshot


@query
def translated_reviews(s):
    return s.translated


@query
def sentiment_labels(s):
    return s.cleaned_reviews.select(
        "review_id", "order_id", "product_id", "sentiment", "sentiment_magnitude", "sentiment_score"
    )


@query
def negative_with_image(s):
    return cases.negative_with_image(s.cleaned_reviews).select("review_id", "product_id", "uri")


@query
def translate_with_model(s):
    out = reviews.translate(s.snapshot, s.languages, models.translation)
    return out.select("review_id", "review_text_raw", "review_text", "review_language")


@query
def sentiment_with_model(s):
    out = reviews.analyze_sentiment(s.translated, models.sentiment)
    return out.select("review_id", "order_id", "sentiment", "sentiment_magnitude", "sentiment_score")


@query
def translate_by_prompt(s):
    out = reviews.translate_by_prompt(s.snapshot, models.echo_digest)
    return out.select("review_id", "order_id", "review_text_raw", "review_text")


@query
def sentiment_by_prompt(s):
    out = reviews.sentiment_by_prompt(s.translated, models.sentiment_word)
    return out.select("review_id", "order_id", "product_id", "review_text", "review_sentiment")


@query
def sentiment_join_back(s):
    answers = s.sentiment_results.select(
        "review_id",
        F.get_json_object("ml_understand_text_result", reviews.SENTIMENT_SCORE).alias(
            "review_sentiment"
        ),
    )
    out = reviews.sentiment_join_back(answers, s.translated)
    return out.select("review_id", "product_id", "review_text", "review_sentiment")


# Orders and refunds


@query
def order_items_enriched(s):
    people = s.users.select(F.col("id").alias("user_id"), "email", "state", "country")
    names = s.products.select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), "category"
    )
    return (
        s.order_items.join(people, "user_id", "inner")
        .join(names, "product_id", "left")
        .select(
            "id", "order_id", "status", "sale_price", "email", "state", "country",
            "product_name", "category", "returned_at",
        )
    )


@query
def products_in_order(s):
    return refunds.products_in_order(s.order_items, s.products)


@query
def recent_order_counts(s):
    return refunds.recent_order_counts(s.order_items, instant(AS_OF))


def _eligibility(
    s, strict_owner: bool = True, order_items: DataFrame | None = None
) -> DataFrame:
    return refunds.refund_eligibility(
        s.refund_requests,
        s.order_items if order_items is None else order_items,
        s.inventory_images,
        s.products,
        s.users,
        s.policy,
        AS_OF,
        strict_owner,
        DIGITS,
    )


@query
def refund_eligibility(s):
    return _eligibility(s)


@query
def refund_eligibility_parity(s):
    return _eligibility(s, strict_owner=False)


def _claims(s) -> DataFrame:
    return refunds.answer_claims(
        refunds.claim_prompts(_eligibility(s), IMAGE_ROOT), models.yes_or_no
    )


@query
def refund_decisions(s):
    return refunds.refund_decisions(_claims(s))


@query
def refund_decisions_parity(s):
    return refunds.refund_decisions(_claims(s), parity=True)


@query
def refund_events(s):
    """Refund messages read back through the schema of the landing table."""
    events = refunds.refund_events(refunds.refund_decisions(_claims(s)))
    landed = decode(events.withColumnRenamed("value", "data"), schemas.REFUNDS)
    return landed.select("product_id", "product_name", "refund_amount", "order_id", "email")


@query
def refund_requests_repeated(s):
    """Every order line once more as a later line: still one event per request."""
    again = s.order_items.withColumn("id", F.concat("id", F.lit("-again"))).withColumn(
        "sale_price", F.col("sale_price") + 1
    )
    rows = _eligibility(s, order_items=s.order_items.unionByName(again))
    claims = refunds.answer_claims(refunds.claim_prompts(rows, IMAGE_ROOT), models.yes_or_no)
    return refunds.refund_decisions(claims)


@query
def refund_outbox(s):
    """Events of claims that inputs repeat and that come in three batches: one for a request.

    Products have a second image and name, e-mails a second user and the policy a tied version.
    """
    second = F.replace("uri", F.lit("gs://"), F.lit("zs://"))
    rows = refunds.refund_eligibility(
        s.refund_requests.unionByName(s.refund_requests),
        s.order_items.unionByName(s.order_items.withColumn("user_id", F.concat("user_id", F.lit("z")))),
        s.inventory_images.unionByName(s.inventory_images.select(second.alias("uri"))),
        s.products.unionByName(s.products.withColumn("name", F.concat("name", F.lit(" again")))),
        s.users.unionByName(s.users.withColumn("id", F.concat("id", F.lit("z")))),
        s.policy.unionByName(
            s.policy.withColumn("service_policy_text", F.concat("service_policy_text", F.lit(" z")))
        ),
        AS_OF,
        digits=DIGITS,
    )
    claims = refunds.answer_claims(refunds.claim_prompts(rows, IMAGE_ROOT), models.yes_or_no)
    events = materialize(refunds.refund_events(refunds.refund_decisions(claims)))
    path = _scratch(s, "outbox")
    half = F.xxhash64("key") % 2 == 0
    for number, batch in enumerate((events.where(half), events.where(half), events)):
        outbox.admit(s.spark, path, batch, "claims", number)
    outbox.admit(s.spark, path, events, "claims", 1)
    sent = outbox.outbox(s.spark, path).read()
    landed = decode(sent.withColumnRenamed("value", "data"), schemas.REFUNDS)
    return landed.select("product_id", "product_name", "refund_amount", "order_id", "email")


@query
def refund_claim_messages(s):
    """Prompt messages of refund claims, read back the same way."""
    prompts, _ = refunds.claim_messages(_claims(s), "m1", models.length_vector)
    landed = decode(prompts.withColumnRenamed("value", "data"), schemas.REFUNDS_PROMPTS)
    return landed.select(
        "user_id", "order_id", "product_id", "prompt", "model_version", "policy_version",
        "prompt_embedding", "feedback_embedding", "request_image_uri",
    )


@query
def refund_response_messages(s):
    _, responses = refunds.claim_messages(_claims(s), "m1", models.length_vector)
    landed = decode(responses.withColumnRenamed("value", "data"), schemas.REFUNDS_RESPONSES)
    return landed.select("user_id", "order_id", "product_id", "response", "response_embedding")


# Documents and policy


@query
def document_assembly(s):
    return s.documents()


@query
def document_assembly_characters(s):
    return s.documents(mode="characters")


@query
def document_parts(s):
    return s.documents(pages_per_part=2)


@query
def policy_by_prompt(s):
    """Pages read by a text model, then put together per document."""
    pages = documents.read_pages_by_prompt(
        s.policy_pages.select("document_id", "uri"), models.page_text
    )
    return documents.assemble_document(
        pages,
        NOTICE,
        keys=["document_id"],
        pattern=PAGE_PATTERN,
        clean=False,
    )


@query
def document_from_images(s):
    """The same with the text-detection model, whose text is cleaned."""
    pages = documents.read_pages(s.policy_pages.select("document_id", "uri"), models.detected_text)
    return documents.assemble_document(
        pages,
        NOTICE,
        keys=["document_id"],
        pattern=PAGE_PATTERN,
    )


@query
def latest_policy(s):
    return documents.latest_version(s.policy)


@query
def latest_policy_join(s):
    attached = documents.attach_latest_policy(s.snapshot, s.policy)
    return attached.select("review_id", "product_id", "service_policy_text", "policy_version")


# Cases


def _case_inputs(s) -> DataFrame:
    return cases.review_case_inputs(s.cleaned_reviews, s.inventory_images, s.policy, DIGITS)


@query
def review_case_inputs(s):
    return _case_inputs(s)


def _answered_cases(s) -> DataFrame:
    negative = cases.negative_with_image(s.cleaned_reviews)
    inputs = cases.review_case_inputs(negative, s.inventory_images, s.policy, DIGITS)
    return cases.answer_cases(cases.case_prompts(inputs), models.resolution)


@query
def resolve_reviews(s):
    return cases.parse_resolutions(_answered_cases(s))


@query
def review_prompt_messages(s):
    embedders = {"text": models.length_vector, "image": models.length_vector}
    prompts, _ = cases.review_messages(_answered_cases(s), "m1", embedders)
    landed = decode(prompts.withColumnRenamed("value", "data"), schemas.REVIEWS_PROMPTS)
    return landed.select(
        "review_id", "prompt", "model_version", "policy_version",
        "prompt_embedding", "review_embedding", "image_embedding",
    )


@query
def review_response_messages(s):
    _, responses = cases.review_messages(
        _answered_cases(s), "m1", {"text": models.length_vector}
    )
    landed = decode(responses.withColumnRenamed("value", "data"), schemas.REVIEWS_RESPONSES)
    return landed.select("review_id", "response", "response_embedding")


# Customers and campaign


def _features(s, level: str) -> DataFrame:
    return customers.rfm_features(s.order_items, *RANGE, as_of=AS_OF, level=level)


@query
def rfm_item_level(s):
    return _features(s, "item")


@query
def rfm_order_level(s):
    return _features(s, "order")


@query
def assign_fixed_centroids(s):
    out = customers.assign_segments(_features(s, "item"), SEGMENTATION)
    distances = [
        F.round(F.col("nearest_centroids_distance")[i]["distance"], 6).alias(f"distance_{i + 1}")
        for i in range(3)
    ]
    return out.select("user_id", "centroid_id", *distances)


def _pivoted(s) -> DataFrame:
    assigned = customers.assign_segments(_features(s, "item"), SEGMENTATION)
    return customers.pivot_centroids(customers.segment_means(assigned))


@query
def centroid_pivot(s):
    return _pivoted(s)


@query
def persona_prompts(s):
    return customers.persona_prompts(_pivoted(s))


@query
def persona_parse(s):
    """Stored answers parsed: a quoted title, and a description that is a list."""
    digest = F.md5("prompt")
    answers = customers.persona_prompts(_pivoted(s)).select(
        "cluster",
        F.concat(
            F.lit('{"persona_title":"The '), digest, F.lit('","persona_description":["'), digest,
            F.lit('"]}'),
        ).alias(RESULT),
    )
    return customers.parse_personas(answers)


@query
def personas(s):
    return customers.personas(_pivoted(s), models.persona)


@query
def segment_customers_kmeans(s):
    """Fitted segments: size and feature means of each."""
    features = _features(s, "item")
    assigned = customers.assign_segments(features, customers.fit_segments(features))
    return assigned.groupBy("centroid_id").agg(
        F.count("*").alias("customers"),
        *[F.round(F.avg(name), 6).alias(name) for name in customers.FEATURES],
    )


@query
def kmeans_seeds(s):
    """The rows that k-means++ draws as first centres, in standardised units."""
    features = _features(s, "item")
    fitted = customers.fit_segments(features, rounds=0)
    return customers.centroid_table(features, fitted).select(
        "centroid_id", "feature", F.round("numerical_value", 6).alias("numerical_value")
    )


@query
def segment_invariants(s):
    """The fitted model checked over all customers against its table of centres.

    Every segment has members, everyone is at the nearest centre, and the distances
    follow from features and centres in their own units.
    """
    features = _features(s, "item")
    fitted = customers.fit_segments(features)
    names = list(fitted.features)
    centres = customers.centroid_table(features, fitted).groupBy("centroid_id").pivot(
        "feature", names
    ).agg(F.first("numerical_value"))
    centres = centres.toDF("centre_id", *[f"centre_{n}" for n in names])
    rows = customers.assign_segments(features, fitted).select(
        "user_id", F.col("centroid_id").alias("own"), *names,
        F.explode("nearest_centroids_distance").alias("to"),
    ).join(centres, F.col("to.centroid_id") == F.col("centre_id"))
    squares = F.lit(0.0)
    for name in names:
        value = F.coalesce(F.col(name).cast("double"), F.lit(fitted.mean[name]))
        squares = squares + F.pow((value - F.col(f"centre_{name}")) / fitted.spread[name], 2)
    gap = F.sqrt(squares)
    each = rows.groupBy("user_id").agg(
        F.min("own").alias("own"),
        F.min(gap).alias("least"),
        F.min(F.when(F.col("own") == F.col("centre_id"), gap)).alias("own_gap"),
        F.max(F.abs(gap - F.col("to.distance"))).alias("off"),
    )
    return each.agg(
        F.count("*").alias("customers"),
        F.countDistinct("own").alias("segments"),
        F.count_if(F.col("own_gap") > F.col("least") + 1e-9).alias("not_nearest"),
        F.count_if(F.col("off") > 1e-9).alias("other_distances"),
    )


def _context(s) -> DataFrame:
    return campaign.campaign_context(
        _features(s, "order"),
        SEGMENTATION,
        s.products,
        customers.personas(_pivoted(s), models.persona),
        s.users,
        PRODUCT_1,
        PRODUCT_2,
    )


@query
def campaign_context(s):
    return _context(s)


def _rewritten(s) -> DataFrame:
    prompts = campaign.copy_prompts(
        _context(s), s.inventory_images, s.products, PRODUCT_1, DIGITS
    )
    return campaign.rewrite_product_copy(prompts, models.echo_digest)


@query
def product_copy(s):
    return campaign.product_descriptions(_rewritten(s)).drop("ml_generate_text_rai_result")


def _email_prompts(s) -> DataFrame:
    return campaign.email_prompts(_rewritten(s))


@query
def email_prompts(s):
    return _email_prompts(s).select("user_id", "user_email", "prompt")


@query
def draft_emails(s):
    out = campaign.draft_emails(_email_prompts(s), models.email)
    return out.select("user_id", "user_email", "centroid_id", "email_english")


# Lineage


@query
def clean_prompts(s):
    out = lineage.clean_prompts(s.prompt_messages, STREAM_AS_OF)
    return out.withColumn("version_inside", F.expr(
        "try_variant_get(original_message, '$.policy_version', 'double')"
    )).drop("original_message")


@query
def clean_responses(s):
    out = lineage.clean_responses(s.response_messages, STREAM_AS_OF)
    return out.withColumn("rating_is_text", F.to_json("safety_attributes").startswith('"').cast(
        "string"
    )).drop("original_message", "safety_attributes")


@query
def clean_prompts_flat(s):
    """The flat landing layout gives the published embedding names."""
    flat = decode(s.prompt_messages.withColumn(
        "data", F.replace("data", F.lit("text_embed"), F.lit("prompt_embedding"))
    ), schemas.REVIEWS_PROMPTS)
    out = lineage.clean_prompts(flat, STREAM_AS_OF)
    return out.select(
        "publish_time", "review_id", "prompt", "policy_version", "prompt_embedding",
        "review_embedding", "hours_since_prompt",
    )


@query
def response_originals(s):
    """The whole message and its rating, as JSON text with sorted keys."""
    out = lineage.clean_responses(s.response_messages, STREAM_AS_OF)
    return out.select(
        "message_id",
        F.to_json("original_message").alias("original_message"),
        F.to_json("safety_attributes").alias("safety_attributes"),
    )


@query
def repaired_answers(s):
    """Answers damaged in eight ways, and what is read out of them."""
    return _repaired(s.damaged_answers)


def _repaired(answers: DataFrame) -> DataFrame:
    document = payload.repaired(F.col("answer"))
    return answers.withColumn("document", document).select(
        "event_id",
        F.try_variant_get("document", "$.id", "bigint").alias("id"),
        payload.strict_string(F.col("document"), "$.kind").alias("kind"),
        payload.strict_string(F.col("document"), "$.note").alias("note"),
    )


@query
def safety_flatten(s):
    out = lineage.flatten_safety(lineage.clean_responses(s.response_messages, STREAM_AS_OF))
    columns: list[Column] = []
    for name in lineage.SAFETY_CATEGORIES:
        columns += [
            F.col(f"{name}.blocked").cast("string").alias(f"{name}_blocked"),
            F.col(f"{name}.probability_score").alias(f"{name}_probability"),
            F.col(f"{name}.severity_score").alias(f"{name}_severity"),
        ]
    return out.select("message_id", *columns)


@query
def embedding_values(s):
    """Flattened embedding text as numbers, one row per position."""
    cleaned = lineage.clean_prompts(s.prompt_messages, STREAM_AS_OF)
    return cleaned.select(
        "publish_time", F.posexplode(payload.vector(F.col("prompt_embedding")))
    ).select("publish_time", F.col("pos").cast("bigint").alias("position"), F.col("col").alias("value"))


@query
def message_dedupe_hourly(s):
    replayed = s.prompt_messages.unionByName(
        s.prompt_messages.withColumn(
            "publish_time", F.col("publish_time") + F.expr("INTERVAL '1' HOUR")
        )
    )
    return with_hour(dedupe(replayed)).select("message_id", "publish_time", "publish_hour")


@query
def raw_lineage_read(s):
    landed = decode(s.refund_messages, schemas.REFUNDS)
    return landed


@query
def landing_hour_range(s):
    """Write the hourly table, read one range back by pruned hours."""
    path = _scratch(s, "landing")
    write_hourly(decode(s.refund_messages, schemas.REFUNDS), path)
    landed = read_hourly(
        s.spark,
        path,
        datetime(2024, 1, 2, 0, 30),
        datetime(2024, 1, 28, 12, 15),
        schemas.REFUNDS,
    )
    return landed.select("message_id", "publish_time", "order_id", "refund_amount")


@query
def hourly_usage(s):
    return lineage.hourly_usage(lineage.clean_prompts(s.prompt_messages, STREAM_AS_OF))


@query
def hourly_refunds(s):
    return totals.hourly_refunds(decode(s.refund_messages, schemas.REFUNDS))


@query
def prompt_response_pairs(s):
    prompts = lineage.clean_prompts(s.prompt_messages, STREAM_AS_OF)
    responses = lineage.clean_responses(s.response_messages, STREAM_AS_OF)
    return lineage.with_latest_response(
        prompts.select("publish_time", "review_id", "prompt"), responses
    )


@query
def prompts_paired(s):
    """Each prompt with its own response, which comes some time later."""
    prompts = lineage.clean_prompts(s.prompt_messages, STREAM_AS_OF)
    responses = lineage.clean_responses(s.late_responses, STREAM_AS_OF)
    return pairing.pair_in_order(
        prompts.select("publish_time", "review_id", "prompt"),
        responses,
        response_tie=("message_id",),
        answer=("message_id", "response"),
    )


@query
def refund_prompts_paired(s):
    """The same for refund claims, by order, product and user."""
    prompts = decode(s.refund_prompt_messages, schemas.REFUNDS_PROMPTS)
    responses = decode(s.refund_response_messages, schemas.REFUNDS_RESPONSES)
    return pairing.pair_in_order(
        prompts.select("message_id", "publish_time", "order_id", "product_id", "user_id"),
        responses.withColumnRenamed("message_id", "response_id"),
        keys=("order_id", "product_id", "user_id"),
        prompt_tie=("message_id",),
        response_tie=("response_id",),
        answer=("response_id", "response"),
        stretch="6 hours",
    )


@query
def exchange_summary(s):
    return totals.exchange_summary(
        lineage.clean_prompts(s.prompt_messages, STREAM_AS_OF),
        lineage.clean_responses(s.response_messages, STREAM_AS_OF),
    )


@query
def embedding_similarity(s):
    """Cosine of every stored vector to the first one."""
    vectors = s.table("embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding")
    )
    first = vectors.agg(F.min_by("embedding", "vec_id")).scalar()
    out = lineage.similarity_to(vectors, "embedding", first)
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"))


# Streams


class _Streams(StandIns):
    """The stand-ins with every test table read as a file stream."""

    def table(self, name: str) -> DataFrame:
        schema = StandIns(self.spark, self.folder).table(name).schema
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}*.parquet")


def _landed(s, name: str, schema) -> DataFrame:
    """A topic landed by a stream that delivers every message twice, and read back."""
    path = _scratch(s, "stream")
    messages = getattr(_Streams(s.spark, s.folder), name)
    landing.land_messages(
        messages.unionByName(messages), schema, f"{path}/table", f"{path}/checkpoint"
    ).awaitTermination()
    return read_landed(s.spark, f"{path}/table", schema)


@query
def stream_landing(s):
    """Stream to the hourly landing table; one copy of each message arrives."""
    return _landed(s, "prompt_messages", schemas.REVIEWS_PROMPTS).select(
        "message_id", "publish_time", "review_id", "prompt", "policy_version"
    )


@query
def stream_landing_responses(s):
    return _landed(s, "response_messages", schemas.REVIEWS_RESPONSES).select(
        "message_id", "publish_time", "review_id", "response"
    )


@query
def stream_landing_refund_prompts(s):
    return _landed(s, "refund_prompt_messages", schemas.REFUNDS_PROMPTS).select(
        "message_id", "publish_time", "order_id", "product_id", "user_id", "prompt",
        "model_version", "policy_version", "feedback_embedding", "request_image_uri",
    )


@query
def stream_landing_refund_responses(s):
    return _landed(s, "refund_response_messages", schemas.REFUNDS_RESPONSES).select(
        "message_id", "publish_time", "order_id", "product_id", "user_id", "response"
    )


@query
def stream_landing_refunds(s):
    return _landed(s, "refund_messages", schemas.REFUNDS).select(
        "message_id", "publish_time", "product_id", "refund_amount", "order_id", "email"
    )


@query
def stream_hourly_refunds(s):
    """Refund totals per hour, kept up to date by a stream."""
    path = _scratch(s, "totals")
    refund_stream = decode(_Streams(s.spark, s.folder).refund_messages, schemas.REFUNDS)
    totals.publish_totals(
        totals.hourly_refunds(refund_stream), f"{path}/table", f"{path}/checkpoint"
    ).awaitTermination()
    return totals.totals_table(s.spark, f"{path}/table").read()


@query
def totals_corrected(s):
    """Totals of a first half, put right by the hours that the landing has touched since."""
    path = _scratch(s, "corrected")
    landed = decode(s.refund_messages, schemas.REFUNDS)
    table = landing_table(s.spark, f"{path}/landed", schemas.REFUNDS)
    early = F.xxhash64("message_id") % 2 == 0
    table.admit(landed.where(early), "halves", 0)
    seen = totals.correct_totals(s.spark, table.path, schemas.REFUNDS, f"{path}/totals")
    table.admit(landed.where(~early), "halves", 1)
    table.admit(landed, "replay", 0)
    totals.correct_totals(s.spark, table.path, schemas.REFUNDS, f"{path}/totals", seen)
    return totals.totals_table(s.spark, f"{path}/totals").read()


@query
def stream_pairs(s):
    """Pairs from two streams, with state kept by key until the watermark has passed."""
    path = _scratch(s, "pairs")
    streams = _Streams(s.spark, s.folder)
    prompts = decode(streams.prompt_messages, schemas.REVIEWS_PROMPTS)
    responses = decode(streams.late_responses, schemas.REVIEWS_RESPONSES)
    pairs = stream_pairing.pair_stream(prompts, responses, delay="0 seconds", timeout="1000 days")
    stream_pairing.keep_pairs(pairs, path, f"{path}/checkpoint").awaitTermination()
    done, _ = stream_pairing.exchange_tables(s.spark, path)
    return done.read().select(
        F.get_json_object("key", "$[0]").alias("review_id"),
        F.col("id").alias("prompt_id"), F.col("at").alias("prompt_time"),
        "response_id", "response_time", "kind",
    )


# Tables


@query
def raw_prompts_read(s):
    """The landing table of prompts, landed in two batches of which one comes twice."""
    table = landing_table(s.spark, _scratch(s, "prompts"), schemas.REVIEWS_PROMPTS)
    rows = decode(s.prompt_messages, schemas.REVIEWS_PROMPTS)
    early = F.xxhash64("message_id") % 2 == 0
    for number, batch in enumerate((rows.where(early), rows, rows.where(~early))):
        table.admit(batch, "deliveries", number)
    return read_landed(s.spark, table.path, schemas.REVIEWS_PROMPTS)


@query
def landing_compacted(s):
    """Hours that came in many small files, packed; a reader before and one after."""
    path = _scratch(s, "compacted")
    table = landing_table(s.spark, path, schemas.REFUNDS)
    rows = decode(s.refund_messages, schemas.REFUNDS)
    for number in range(3):
        table.admit(rows.where(F.pmod(F.xxhash64("message_id"), F.lit(3)) == number), "thirds", number)
    before = table.read()
    table.compact()
    after = read_landed(s.spark, path, schemas.REFUNDS)
    hour = F.date_trunc("hour", "publish_time").alias("publish_hour")
    counts = [
        df.groupBy(hour).agg(F.count("*").alias(name), F.sum("refund_amount").alias(f"{name}_amount"))
        for df, name in ((before, "before"), (after, "after"))
    ]
    fewer = F.lit(len(after.inputFiles()) < len(before.inputFiles())).cast("string").alias("fewer_files")
    return counts[0].join(counts[1], "publish_hour", "full").select(
        "publish_hour", "before", "before_amount", "after", "after_amount", fewer
    )


@query
def saved_tables(s):
    """A table built, built again from itself, and read as it was and as it is."""
    name = f"saved_users_{uuid.uuid4().hex}"
    people = s.users.select("id", "email", "age")
    first = save_table(people, name)
    second = save_table(first.withColumn("age", F.col("age") + 1), name)
    old = first.select("id", F.col("age").alias("age_before"))
    return open_table(s.spark, name).join(old, "id").select(
        "id", "email", "age_before", "age", F.lit(str(first.count() == second.count()).lower()).alias("whole")
    )


@query
def temp_tables(s):
    """A session table that holds a result, read twice by SQL."""
    name = f"order_totals_{uuid.uuid4().hex}"
    temp_table(
        s.order_items.groupBy("order_id").agg(F.sum("sale_price").alias("total")), name
    )
    return s.spark.sql(
        f"SELECT order_id, total FROM {name} WHERE total > (SELECT avg(total) FROM {name})"
    )


def _images(s) -> str:
    """Web pages as PNG files whose comment is a digest of the page; the folder."""
    folder = f"{_scratch(s, 'images')}/pages"
    png = F.arrow_udf(models.png_files, "binary")
    files.write_files(
        s.table("pages").select(
            F.concat(F.lit(f"{folder}/"), key("page_id"), F.lit(".png")).alias("uri"),
            png(F.md5("html")).alias("content"),
        )
    )
    return folder


@query
def image_embeddings(s):
    """PNG files written, listed and embedded by their content: 1408 numbers each."""
    listing = list_files(s.spark, _images(s))
    out = files.embed_files(listing, models.image_vector)
    return out.select(
        text.uri_key("uri", DIGITS).alias("page_id"),
        F.size("embedding").cast("bigint").alias("numbers"),
        F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x).alias("total"),
        "status",
    )


@query
def image_texts(s):
    """The same files read by a model of text in images, and cleaned."""
    found = files.map_files(list_files(s.spark, _images(s)), models.image_text)
    return found.select(
        text.uri_key("uri", DIGITS).alias("page_id"),
        text.clean_page_text(payload.scalar(F.col("answer"), documents.PAGE_TEXT)).alias("page_text"),
    )


@query
def nearest_vectors(s):
    """The ten nearest vectors of every hundredth one, by all lists of the index."""
    vectors = s.table("embeddings")
    index = neighbours.build_index(vectors, "vec_id", "embedding")
    return neighbours.search(index, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding")


@query
def nearest_vectors_recall(s):
    """How many of them half of the lists find."""
    vectors = s.table("embeddings")
    index = neighbours.build_index(vectors, "vec_id", "embedding")
    asked = vectors.where("vec_id % 100 = 0")
    exact = neighbours.search(index, asked, "vec_id", "embedding")
    some = neighbours.search(index, asked, "vec_id", "embedding", probes=neighbours.LISTS // 2)
    return neighbours.recall(some, exact).select(
        "queries", (F.col("recall") >= 0.9).cast("string").alias("recall_of_nine_tenths")
    )


# Models


@query
def apply_model_local(s):
    out = apply_model(s.table("documents"), "text", models.echo_digest)
    return out.select(
        "doc_id", F.col(RESULT).alias("answer"), F.col(STATUS).alias("status")
    )


@query
def answers_kept(s):
    """Answers of a first run, and what a second one over more rows still had to ask."""
    store = AnswerStore(s.spark, _scratch(s, "answers"), "m1")
    docs = s.table("documents")
    half = F.xxhash64("text") % 2 == 0
    first = store.ask(docs.where(half), "text", models.echo_digest)
    second = store.ask(docs, "text", models.echo_digest)
    third = store.ask(docs, "text", models.echo_digest)
    out = apply_model(docs, "text", models.echo_digest, store=store)
    return out.select(
        "doc_id", F.col(RESULT).alias("answer"), F.col(STATUS).alias("status"),
        F.lit(first + second).cast("bigint").alias("asked"),
        F.lit(third).cast("bigint").alias("asked_again"),
    )


@query
def apply_model_distinct(s):
    """The same with every distinct text asked once and joined back."""
    out = apply_model(s.table("documents"), "text", models.echo_digest, distinct=True)
    return out.select("doc_id", F.col(RESULT).alias("answer"), F.col(STATUS).alias("status"))


@query
def embed_local(s):
    out = embed(s.table("documents"), {"vector": ("text", models.length_vector)})
    return out.select("doc_id", F.col("vector")[0].alias("length"))


# Scalar functions


@query
def text_functions(s):
    body = F.concat(F.lit("\t "), F.col("text"), F.lit(' " '))
    return s.table("documents").select(
        "doc_id",
        text.trim_space(body).alias("trimmed"),
        text.unquote(F.concat(F.lit(' "'), F.col("text"), F.lit('" '))).alias("unquoted"),
        text.clean_page_text(F.concat(F.lit("• "), F.col("text"))).alias("page_text"),
        text.trim_set(F.col("text"), "aeinrst. ").alias("trimmed_set"),
        text.capture(F.col("text"), r"([0-9]{3})").alias("three_digits"),
        text.number_text(F.col("n_chars") / 4).alias("quarter"),
    )


@query
def uri_functions(s):
    """Keys out of file names, in full and as the last three digits, and a built URI."""
    return s.inventory_images.select(
        "uri",
        text.uri_key("uri", DIGITS).alias("product_id"),
        text.uri_key("uri", tail=True).alias("three_digits"),
        text.join_uri(IMAGE_ROOT, "/", text.uri_key("uri", DIGITS), "_refund_request.png").alias(
            "photo"
        ),
    )


@query
def time_functions(s):
    """Day and minute differences and the closed 90-day window up to an instant."""
    now = instant(AS_OF)
    return s.order_items.select(
        "id",
        "product_id",
        F.date_diff(F.col("shipped_at").cast("date"), F.col("created_at").cast("date"))
        .cast("bigint").alias("days_to_ship"),
        whole_minutes(F.col("shipped_at"), now).alias("minutes_since"),
        hours_since(F.col("shipped_at"), now).alias("hours_since"),
        F.when(F.col("created_at").between(days_before(now, 90), now), "recent")
        .otherwise("old").alias("age"),
    )


@query
def payload_functions(s):
    data = F.col("data")
    return s.response_messages.select(
        "message_id",
        payload.scalar(data, "$.response").alias("response"),
        payload.scalar(data, "$.safety_attributes[0].probability_score").alias("probability"),
        payload.json_text(data, "$.review_id").alias("quoted_id"),
        payload.strict_string(F.try_parse_json(data), "$.response").alias("strict_response"),
        payload.strict_string(
            F.try_parse_json(data), "$.safety_attributes[0].severity_score"
        ).alias("strict_severity"),
    )


@query
def parameterised_query(s):
    """SQL text with table slots and value markers."""
    return run_query(
        s.spark,
        "SELECT p.id AS product_id, i.status, count(*) AS lines, sum(i.sale_price) AS revenue "
        "FROM {items} i JOIN {products} p ON i.product_id = p.id "
        "WHERE i.sale_price < :max_price GROUP BY p.id, i.status",
        {"items": s.order_items, "products": s.products},
        max_price=50.0,
    )
