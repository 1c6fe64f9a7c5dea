"""Refunds: products of an order, eligibility, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcart.functions.measures import days_before, instant
from voxcart.functions.text import (
    KEY_DIGITS,
    MISSING,
    fill_template,
    join_uri,
    trim_space,
    unquote,
    uri_key,
)
from voxcart.operators.documents import attach_latest_policy, first_of_version
from voxcart.operators.inference import RATING, RESULT, STATUS, Provider, apply_model, embed
from voxcart.operators.joins import aggregate_for_join, may_match
from voxcart.operators.messages import REFUND, REFUND_PROMPT, REFUND_RESPONSE, message

# The limits of the eligibility rule.
WINDOW_DAYS = 90
MAX_ORDERS = 50
MAX_PRICE = 50

# What makes a refund request the one it is; an event carries it as its key.
REQUEST = ("email", "order_id", "product_id")

CLAIM_PROMPT = (
    "You check defect claims for {company}. Our service policy says: {policy} "
    "The customer wrote: {review_text} The customer's photo is {request_image_uri} and the "
    "catalogue image is {inventory_image_uri}. Is the item defective? Answer yes or no."
)


def products_in_order(
    order_items: DataFrame, products: DataFrame, order_id: str | None = None
) -> DataFrame:
    """Products of one order, or of every order together with its id."""
    names = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    if order_id is not None:
        lines = order_items.where(F.col("order_id") == order_id).select("product_id")
    else:
        lines = order_items.select("order_id", "product_id")
    joined = lines.join(names, "product_id", "inner")
    return joined.select(*lines.columns, "product_name")


def recent_order_counts(
    order_items: DataFrame, as_of: Column, days: int = WINDOW_DAYS
) -> DataFrame:
    """Distinct orders per user created in the last ``days`` days."""
    recent = order_items.where(F.col("created_at").between(days_before(as_of, days), as_of))
    return aggregate_for_join(
        recent, {"user_id": "user_id"}, F.count_distinct("order_id").alias("orders_recent")
    )


def _first_user(rows: DataFrame, request: list[str]) -> DataFrame:
    """One row for each request, that of its first user by id, for all the rows it has.

    Equal requests stay one row each time they are made by the same user only once: a
    request is what its columns say.
    """
    rest = [c for c in rows.columns if c not in request]
    first = rows.groupBy(*request).agg(
        F.min_by(F.struct(*rest), F.struct("user_id", *[c for c in rest if c != "user_id"])).alias("of")
    )
    return first.select(*request, "of.*").select(*rows.columns)


def _asked_by_owner(
    requests: DataFrame, order_items: DataFrame, counted: DataFrame, line: Column
) -> DataFrame:
    """Requests with their first owner by id who may ask, and the first line of that owner.

    Lines take the e-mails of their owners and are reduced to one row for what may be asked.
    That and the requests meet on one key, the e-mail with the order and the product: a
    request is shuffled once, and equal requests lie in one place to become one row.
    """
    lines = order_items.select("user_id", "order_id", "product_id", line.alias("line"))
    # Shuffled on their own, so that the lines of a hot owner can be split.
    owners = aggregate_for_join(counted, {c: c for c in counted.columns})
    owned = lines.join(owners, "user_id", "inner").where(
        F.col("email").isNotNull() & F.col("order_id").isNotNull() & F.col("product_id").isNotNull()
    )
    first = F.min(F.struct("user_id", "orders_recent", "line")).alias("of")
    askable = aggregate_for_join(owned, {c: c for c in REQUEST}, first)
    key, rest = "email_order_product", [c for c in requests.columns if c not in REQUEST]
    rows = requests.select(F.struct(*REQUEST).alias(key), *rest).join(
        askable.select(F.struct(*REQUEST).alias(key), "of"), key, "inner"
    )
    return rows.groupBy(key, *rest).agg(F.first("of").alias("of")).select(
        f"{key}.*", *rest, "of.user_id", "of.orders_recent", "of.line.sale_price", "of.line.shipping_date"
    )


def _asked_by_anyone(
    requests: DataFrame, order_items: DataFrame, counted: DataFrame, line: Column
) -> DataFrame:
    """Requests with their first user by id who may ask, and a line of the order, whoever owns it."""
    lines = aggregate_for_join(
        order_items,
        {"order_id": "order_id", "product_id": "product_id", "owner_id": "user_id"},
        F.min(line).alias("line"),
    ).select("order_id", "product_id", "line.sale_price", "line.shipping_date")
    asked = requests.join(counted, "email", "inner")
    return _first_user(asked.join(lines, ["order_id", "product_id"], "inner"), requests.columns)


def refund_eligibility(
    requests: DataFrame,
    order_items: DataFrame,
    inventory_images: DataFrame,
    products: DataFrame,
    users: DataFrame,
    policy: DataFrame,
    as_of=None,
    strict_owner: bool = True,
    digits: int = KEY_DIGITS,
) -> DataFrame:
    """Eligibility of refund requests ``(email, order_id, product_id)``.

    Eligible needs fewer than 50 recent distinct orders, a price below 50 and a
    shipping time within 90 days; an unshipped line is not eligible.  A user
    without a recent order, and a product without an image, give no row.

    ``strict_owner`` demands that the order belongs to the user of that e-mail;
    without it any order may be paired with any known user.

    A request gives at most one row, whatever its inputs repeat: an order with several
    lines of the product is about the first by id, a product with several images takes the
    first by URI and with several names the first, an e-mail of several users the first by
    id who may ask, and of tied policy versions the first by text counts.
    """
    now = instant(as_of)
    line = F.struct(
        *(["id"] if "id" in order_items.columns else []),
        "sale_price",
        F.col("shipped_at").alias("shipping_date"),
    )
    people = users.select(F.col("id").alias("user_id"), "email").distinct()
    images = inventory_images.groupBy(uri_key("uri", digits).alias("product_id")).agg(
        F.min("uri").alias("inventory_image_uri")
    )
    names = products.groupBy(F.col("id").alias("product_id")).agg(F.min("name").alias("product_name"))
    shown = images.join(names, "product_id", "inner")
    shown = aggregate_for_join(shown, {c: c for c in shown.columns})
    # Counts are at most one row per user and meet the users first.  What is not of a user
    # with recent orders is dropped before requests and order lines are shuffled.
    counts = recent_order_counts(order_items, now)
    counted = people.join(counts, "user_id", "inner")
    requests = may_match(requests, "email", counted)
    if strict_owner:
        rows = _asked_by_owner(requests, may_match(order_items, "user_id", counts), counted, line)
    else:
        rows = _asked_by_anyone(requests, order_items, counted, line)
    rows = rows.join(shown, "product_id", "inner")
    passes = (
        (F.col("orders_recent") < MAX_ORDERS)
        & (F.col("sale_price") < MAX_PRICE)
        & (F.col("shipping_date") > days_before(now, WINDOW_DAYS))
    )
    extra = [c for c in requests.columns if c not in ("email", "order_id", "product_id")]
    return attach_latest_policy(rows, first_of_version(policy)).select(
        F.when(passes, "True").otherwise("False").alias("eligible"),
        "product_id",
        "service_policy_text",
        "policy_version",
        "inventory_image_uri",
        "user_id",
        "email",
        "sale_price",
        "product_name",
        "order_id",
        *extra,
    )


def claim_prompts(
    eligible: DataFrame, image_root: str, company: str = "our shop"
) -> DataFrame:
    """Eligible requests with the photo's URI and a yes-or-no prompt.

    ``review_text`` is the customer's note; blanks and quotes around it go.
    """
    claims = eligible.where(F.col("eligible") == "True")
    photo = join_uri(image_root, "/", F.col("order_id"), "_refund_request.png")
    prepared = claims.withColumn("review_text", unquote(F.col("review_text"))).withColumn(
        "request_image_uri", photo
    )
    return prepared.withColumn(
        "prompt",
        fill_template(
            CLAIM_PROMPT,
            company=F.lit(company),
            policy=F.col("service_policy_text"),
            review_text=F.coalesce("review_text", F.lit(MISSING)),
            request_image_uri=F.col("request_image_uri"),
            inventory_image_uri=F.col("inventory_image_uri"),
        ),
    )


def answer_claims(prompts: DataFrame, provider: Provider, **options) -> DataFrame:
    defaults = {"max_output_tokens": 2048, "temperature": 0.7, "top_k": 32, "top_p": 1.0}
    return apply_model(prompts, "prompt", provider, **{**defaults, **options})


def decide(answer: Column, parity: bool = False) -> Column:
    """``refund``, ``no_refund`` or ``review`` for a model answer.

    The default takes only a clear yes for a refund and a clear no against one,
    and sends the rest to a person.  ``parity`` refunds on anything but exactly no.
    """
    said = F.lower(answer)
    if parity:
        return F.when(said == "no", "no_refund").when(said.isNotNull(), "refund").otherwise("review")
    word = F.regexp_replace(trim_space(said), r"[.!\"']", "")
    return F.when(word == "yes", "refund").when(word == "no", "no_refund").otherwise("review")


def refund_decisions(
    answered: DataFrame, answer_col: str = RESULT, parity: bool = False
) -> DataFrame:
    """Answered claims with a ``decision`` and the amount to refund."""
    return answered.select(
        "product_id",
        "product_name",
        F.col("sale_price").alias("refund_amount"),
        "order_id",
        "email",
        decide(F.col(answer_col), parity).alias("decision"),
    )


def refund_events(decisions: DataFrame) -> DataFrame:
    """Refund messages of the decisions to refund, keyed by their request.

    The key follows from the request alone, so an outbox (``operators.outbox``) admits one
    event for it however often it is decided.
    """
    return message(decisions.where("decision = 'refund'"), REFUND, REQUEST)


def claim_messages(
    answered: DataFrame, model_version: str, embedder: Provider | None = None
) -> tuple[DataFrame, DataFrame]:
    """Prompt messages of all claims that were asked, response messages of those answered."""
    df = answered.where(F.col("prompt").isNotNull()).select(
        "*",
        F.lit(model_version).alias("model_version"),
        F.col(RESULT).alias("response"),
        F.col(RATING).alias("safety_attributes"),
    )
    if embedder is not None:
        df = embed(
            df,
            {
                "feedback_embedding": ("review_text", embedder),
                "prompt_embedding": ("prompt", embedder),
                "response_embedding": ("response", embedder),
            },
        )
    key = ("order_id", "product_id", "user_id")
    responses = df.where(F.col(STATUS) == "")
    return message(df, REFUND_PROMPT, key), message(responses, REFUND_RESPONSE, key)
