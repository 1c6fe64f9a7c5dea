"""The interface tables derived from the star-schema test tables.

Every stand-in reads its source tables whole.  Keys are padded text of ``DIGITS``
digits, so file names carry them with leading zeros.  Prices are exact binary
fractions, so their sums do not depend on the order of addition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxcart import schemas
from voxcart.operators.customers import Centroid, Segmentation
from voxcart.operators.documents import assemble_document
from voxcart.operators.reviews import latest_review_snapshot, score_sentiment, translated_reviews
from voxcart.sources.files import png_only
from voxcart.sources.tables import conform

DIGITS = 12
AS_OF = "2001-08-02 00:00:00"
STREAM_AS_OF = "2024-02-01 00:00:00"
RANGE = ("1995-01-01 00:00:00", "2001-07-31 00:00:00")
NOTICE = "Internal Only For use by employees only"
PAGE_PATTERN = r"_Page_([0-9]+)\.png$"
IMAGE_ROOT = "gs://bucket/review-images/uploads"
# Settings of the demonstration campaign.
PRODUCT_1, PRODUCT_2 = "product 7", "product 11"
# Segment centres used where a query needs fixed ones.
SEGMENTATION = Segmentation(
    centroids=(
        Centroid(1, {"avg_spend": 40.0, "count_orders": 6.0, "days_since_order": 100.0}),
        Centroid(2, {"avg_spend": 52.0, "count_orders": 9.0, "days_since_order": 250.0}),
        Centroid(3, {"avg_spend": 64.0, "count_orders": 14.0, "days_since_order": 500.0}),
    ),
    spread={"avg_spend": 8.0, "count_orders": 4.0, "days_since_order": 256.0},
    mean={"avg_spend": 52.0, "count_orders": 10.0, "days_since_order": 240.0},
)
LANGUAGES = [
    ("eng", "eng", "en", "English", "anglais", "Englisch"),
    ("fra", "fre", "fr", "French", "français", "Französisch"),
    ("deu", "ger", "de", "German", "allemand", "Deutsch"),
]


def key(column: Column | str) -> Column:
    """Digits with leading zeros up to ``DIGITS``; longer numbers stay whole."""
    digits = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(DIGITS)), F.lit("0"))


def email(custkey: Column) -> Column:
    return F.concat(F.lit("customer"), key(custkey), F.lit("@example.com"))


# Time of a response: the event's value is its delay in minutes.
LATER = "CAST(ts AS TIMESTAMP) + make_dt_interval(0, 0, CAST(floor(value) AS INT), 0)"

# Column types of the test tables, read from the files once.
_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


class StandIns:
    """Lazy stand-in tables over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            path, known = f"{self.folder}/{name}.parquet", (self.folder, name)
            if known not in _SCHEMAS:
                _SCHEMAS[known] = self.spark.read.parquet(path).schema
            self._tables[name] = self.spark.read.schema(_SCHEMAS[known]).parquet(path)
        return self._tables[name]

    @cached_property
    def order_items(self) -> DataFrame:
        lines = self.table("lineitem").join(
            self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "inner"
        )
        shipped = F.col("l_shipdate").cast("timestamp")
        df = lines.select(
            F.concat(key("l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"),
            key("l_orderkey").alias("order_id"),
            key("o_custkey").alias("user_id"),
            key("l_partkey").alias("product_id"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            shipped.alias("shipped_at"),
            (shipped + F.expr("INTERVAL '5' DAY")).alias("delivered_at"),
            F.when(
                F.col("l_returnflag") == "R", shipped + F.expr("INTERVAL '10' DAY")
            ).alias("returned_at"),
            (F.col("l_quantity") * 2 + F.col("l_linenumber") * F.lit(0.25)).alias("sale_price"),
        )
        return conform(df, schemas.ORDER_ITEMS)

    @cached_property
    def users(self) -> DataFrame:
        people = (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )
        df = people.select(
            key("c_custkey").alias("id"),
            F.lit("Customer").alias("first_name"),
            F.expr("substring(c_name, 10)").alias("last_name"),
            email(F.col("c_custkey")).alias("email"),
            (F.lit(18) + F.col("c_custkey") % 60).alias("age"),
            F.col("n_name").alias("state"),
            F.col("r_name").alias("country"),
        )
        return conform(df, schemas.USERS)

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            key("p_partkey").alias("id"),
            F.concat(F.lit("product "), F.col("p_partkey").cast("string")).alias("name"),
            F.col("p_type").alias("category"),
            F.concat_ws(" ", "p_brand", "p_name").alias("description"),
        )

    @cached_property
    def inventory_images(self) -> DataFrame:
        """Products on promotion are pictured as JPEG, which the listing leaves out."""
        suffix = F.when(F.col("p_type") == "PROMO", ".jpg").otherwise(".png")
        uri = F.concat(F.lit("gs://bucket/inventory-images/"), key("p_partkey"), suffix)
        return png_only(self.table("part").select(uri.alias("uri")))

    @cached_property
    def review_images(self) -> DataFrame:
        """One image per web page: there are fewer pages than reviews."""
        uri = F.concat(F.lit("gs://bucket/review-images/"), key("page_id"), F.lit(".png"))
        return png_only(self.table("pages").select(uri.alias("uri")))

    @cached_property
    def raw_reviews(self) -> DataFrame:
        """Documents as reviews of the first line of the order of the same number.

        Labelled documents come twice; the copy has a user nobody knows.
        """
        first_line = (
            self.table("lineitem")
            .where("l_linenumber = 1")
            .groupBy("l_orderkey")
            .agg(F.min("l_partkey").alias("partkey"))
        )
        labelled = self.table("labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
        documents = (
            self.table("documents")
            .join(self.table("orders"), F.col("doc_id") == F.col("o_orderkey"), "left")
            .join(first_line, F.col("doc_id") == F.col("l_orderkey"), "left")
            .join(labelled, "doc_id", "left")
        )
        owner = key("o_custkey")
        # Copied behind the joins, so that a text is shuffled once for both rows.
        users = F.when(F.col("labelled"), F.array(owner, F.lit("-1"))).otherwise(F.array(owner))
        reviews = documents.select(
            key("doc_id").alias("review_id"),
            F.concat(key("doc_id"), F.lit("-1")).alias("order_id"),
            F.explode(users).alias("user_id"),
            key(F.coalesce("partkey", F.lit(0))).alias("product_id"),
            F.concat(F.lit("Reviewer "), F.col("doc_id").cast("string")).alias("name"),
            (F.lit(1) + F.col("doc_id") % 5).cast("string").alias("review_rating"),
            F.col("text").alias("review_text"),
        )
        return conform(reviews, schemas.RAW_REVIEWS)

    @cached_property
    def languages(self) -> DataFrame:
        return self.spark.createDataFrame(LANGUAGES, schemas.ISO_639_CODES)

    @cached_property
    def translate_results(self) -> DataFrame:
        """The whole text, blanks around it and apostrophes escaped, as model answer."""
        text = F.concat(
            F.lit("\t "), F.replace("text", F.lit("'"), F.lit("&#39;")), F.lit(" don&#39;t \n")
        )
        answer = F.to_json(
            F.struct(
                F.array(
                    F.struct(
                        text.alias("translated_text"),
                        F.concat(F.lit(" "), F.col("lang")).alias("detected_language_code"),
                    )
                ).alias("translations")
            )
        )
        return self.table("documents").select(
            key("doc_id").alias("review_id"), answer.alias("ml_translate_result")
        )

    @cached_property
    def sentiment_results(self) -> DataFrame:
        """Score and magnitude from the labels; unlabelled documents have no row."""
        answer = F.to_json(
            F.struct(
                F.struct(
                    (F.col("quality") - F.col("toxic") * 2).cast("double").alias("score"),
                    (F.col("quality") + F.col("toxic")).cast("double").alias("magnitude"),
                ).alias("document_sentiment")
            )
        )
        return self.table("labels").select(
            key("doc_id").alias("review_id"), answer.alias("ml_understand_text_result")
        )

    @cached_property
    def snapshot(self) -> DataFrame:
        return latest_review_snapshot(
            self.raw_reviews, self.order_items, self.review_images, DIGITS
        )

    @cached_property
    def translated(self) -> DataFrame:
        answered = self.snapshot.join(self.translate_results, "review_id", "left")
        return translated_reviews(answered, self.languages)

    @cached_property
    def cleaned_reviews(self) -> DataFrame:
        answered = self.translated.join(self.sentiment_results, "review_id", "left")
        return score_sentiment(answered)

    @cached_property
    def policy_pages(self) -> DataFrame:
        """Conversation turns as pages that carry the notice at both ends."""
        number = key("turn")
        return self.table("conversations").select(
            F.col("conv_id").alias("document_id"),
            F.concat(F.lit("gs://bucket/service-policy/Policy_Page_"), number, F.lit(".png")).alias(
                "uri"
            ),
            F.concat(
                F.lit(f"{NOTICE} • "),
                F.col("text"),
                F.lit("\n● end of page "),
                F.col("turn").cast("string"),
                F.lit(f" {NOTICE}"),
            ).alias("page_text"),
        )

    def documents(self, pages_per_part: int | None = None, **options) -> DataFrame:
        return assemble_document(
            self.policy_pages,
            NOTICE,
            keys=["document_id"],
            pattern=PAGE_PATTERN,
            pages_per_part=pages_per_part,
            **options,
        )

    @cached_property
    def policy(self) -> DataFrame:
        """Each document is one version of the policy."""
        return self.documents().select(
            "service_policy_text", F.col("document_id").cast("double").alias("version_number")
        )

    @cached_property
    def refund_requests(self) -> DataFrame:
        """A request per order line by its owner, and one by another customer."""
        lines = self.table("lineitem").join(
            self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")
        )
        # Distinct as numbers: a task holds the keys of all its requests.
        pairs = lines.select(
            "l_orderkey", "l_partkey", F.explode(F.array("o_custkey", "l_suppkey")).alias("asker")
        )
        return pairs.distinct().select(
            email(F.col("asker")).alias("email"),
            key("l_orderkey").alias("order_id"),
            key("l_partkey").alias("product_id"),
            F.concat(F.lit(' "item '), key("l_partkey"), F.lit(' arrived broken" ')).alias(
                "review_text"
            ),
        )

    def _envelope(
        self, body: Column, time: str = "CAST(ts AS TIMESTAMP)", wanted: Column | None = None
    ) -> DataFrame:
        events = self.table("events")
        return (events if wanted is None else events.where(wanted)).select(
            F.col("event_id").cast("string").alias("message_id"),
            F.expr(time).alias("publish_time"),
            F.concat(F.lit("write-"), "event_type").alias("subscription_name"),
            F.col("props").alias("attributes"),
            body.alias("data"),
        )

    @cached_property
    def prompt_messages(self) -> DataFrame:
        """Events as prompt messages; errors have no prompt embedding."""
        value = F.col("value").cast("string")
        return self._envelope(
            F.concat(
                F.lit('{"review_id":"'),
                F.col("user_id").cast("string"),
                F.lit('","prompt":"  '),
                F.col("event_type"),
                F.lit(' ","model_version":"m1","policy_version":1.0'),
                F.when(F.col("event_type") == "error", "").otherwise(
                    F.concat(F.lit(',"text_embed":"[['), value, F.lit(', 0.5]]"'))
                ),
                F.lit(',"review_embed":"[[0.25]]","image_embed":"[0.125]"}'),
            )
        )

    @cached_property
    def response_messages(self) -> DataFrame:
        """Events as response messages.

        Views carry the rating as JSON text inside the body, errors no embedding
        and clicks a response that is no scalar.
        """
        return self._envelope(self._response_body())

    def _response_body(self) -> Column:
        value = F.col("value").cast("string")

        def rating(quote: str) -> Column:
            parts = [F.lit("[")]
            for position in range(4):
                parts += [
                    F.lit(
                        ("," if position else "")
                        + f"{{{quote}blocked{quote}:{'true' if position == 2 else 'false'},"
                        + f"{quote}probability_score{quote}:"
                    ),
                    value,
                    F.lit(f",{quote}severity_score{quote}:0.{position + 1}5}}"),
                ]
            return F.concat(*parts, F.lit("]"))

        safety = F.when(
            F.col("event_type") == "view", F.concat(F.lit('"'), rating('\\"'), F.lit('"'))
        ).otherwise(rating('"'))
        response = F.when(
            F.col("event_type") == "click", F.concat(F.lit("["), value, F.lit("]"))
        ).otherwise(F.concat(F.lit('"[answer] '), value, F.lit('"')))
        return F.concat(
            F.lit('{"review_id":"'),
            F.col("user_id").cast("string"),
            F.lit('","response":'),
            response,
            F.lit(',"safety_attributes":'),
            safety,
            F.when(F.col("event_type") == "error", "").otherwise(
                F.concat(F.lit(',"embedding":"[['), value, F.lit(']]"'))
            ),
            F.lit("}"),
        )

    @cached_property
    def late_responses(self) -> DataFrame:
        """The responses after as many minutes as the event's value says; views have none."""
        return self._envelope(self._response_body(), LATER, F.col("event_type") != "view")

    @cached_property
    def refund_prompt_messages(self) -> DataFrame:
        """Events as prompts of refund claims; few orders share many of them."""
        body = F.to_json(
            F.struct(
                F.lit("[0.25]").alias("feedback_embedding"),
                F.concat(F.lit("Is it broken? "), F.col("event_type")).alias("prompt"),
                F.lit("[0.5, 1.5]").alias("prompt_embedding"),
                F.concat(F.lit(f"{IMAGE_ROOT}/"), key("event_id"), F.lit(".png")).alias(
                    "request_image_uri"
                ),
                F.lit("m1").alias("model_version"),
                F.lit(1.0).alias("policy_version"),
                key("user_id").alias("user_id"),
                key(F.col("user_id") % 16).alias("order_id"),
                F.col("event_type").alias("product_id"),
            )
        )
        return self._envelope(body)

    @cached_property
    def refund_response_messages(self) -> DataFrame:
        """Their responses after as many minutes as the event's value says; errors have none."""
        body = F.to_json(
            F.struct(
                key(F.col("user_id") % 16).alias("order_id"),
                F.col("event_type").alias("product_id"),
                key("user_id").alias("user_id"),
                F.concat(F.lit("answer "), F.col("event_id").cast("string")).alias("response"),
            )
        )
        return self._envelope(body, LATER, F.col("event_type") != "error")

    @cached_property
    def damaged_answers(self) -> DataFrame:
        """Model answers with one kind of damage each, by the number of the event."""
        number = F.col("event_id").cast("string")
        note = F.concat(F.lit("it's "), number)

        def text(template: str) -> Column:
            return F.format_string(template, number, "event_type", note)

        templates = (
            '```json\n{"id": %s, "kind": "%s", "note": "%s",}\n```',
            "{'id': %s, 'kind': '%s', 'note': '%s'}",
            '{id: %s, kind: "%s", note: "%s"}',
            '{"id": %s, "kind": "%s", "note": "%s\n"}',
            '{"id": %s "kind": "%s" "note": "%s"}',
            '{"id": %s, "kind": "%s", "note": "%s',
            '{"id": %1$s, "kind": "%2$s", "more": {"list": [1, 2, ',
            'Sure! {"id": %1$s, "kind": "%2$s", "ok": True, "note": None, Hope this helps.',
        )
        answer = F.lit(None).cast("string")
        for place, template in enumerate(templates):
            answer = F.when(F.col("event_id") % len(templates) == place, text(template)).otherwise(answer)
        return self.table("events").select("event_id", answer.alias("answer"))

    @cached_property
    def refund_messages(self) -> DataFrame:
        """Events as refund messages with the published field names."""
        body = F.to_json(
            F.struct(
                key("user_id").alias("product_id"),
                F.concat(F.lit("product "), F.col("user_id").cast("string")).alias("product_name"),
                F.floor("value").cast("double").alias("refund_amount"),
                key("event_id").alias("order_id"),
                email(F.col("user_id")).alias("email"),
            )
        )
        return self.table("events").select(
            F.col("event_id").cast("string").alias("message_id"),
            F.col("ts").cast("timestamp").alias("publish_time"),
            F.lit("write-refunds").alias("subscription_name"),
            F.col("props").alias("attributes"),
            body.alias("data"),
        )
