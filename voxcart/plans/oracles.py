"""The catalog's queries as SQL text for another engine, to compare results.

``VIEWS`` spell out the stand-in tables and the intermediate results; a query
lists what it needs and gets it as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from string import Formatter

from voxcart.functions.text import MISSING, WHITESPACE
from voxcart.operators import campaign, cases, customers, documents, refunds, reviews
from voxcart.plans.standins import (
    AS_OF,
    DIGITS,
    IMAGE_ROOT,
    LANGUAGES,
    NOTICE,
    PAGE_PATTERN,
    PRODUCT_1,
    PRODUCT_2,
    RANGE,
    SEGMENTATION,
    STREAM_AS_OF,
)


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def key(expression: str) -> str:
    digits = f"CAST({expression} AS VARCHAR)"
    return f"lpad({digits}, CAST(greatest(length({digits}), {DIGITS}) AS INTEGER), '0')"


def email(expression: str) -> str:
    return f"'customer' || {key(expression)} || '@example.com'"


def trim_space(expression: str) -> str:
    return f"trim({expression}, {literal(WHITESPACE)})"


def template(text: str, **values: str) -> str:
    parts = []
    for words, name, _, _ in Formatter().parse(text):
        if words:
            parts.append(literal(words))
        if name is not None:
            parts.append(f"CAST({values[name]} AS VARCHAR)")
    return " || ".join(parts)


def columns(*names: str) -> dict[str, str]:
    return {name: name for name in names}


def scalar(document: str, path: str) -> str:
    return (
        f"CASE WHEN json_type({document}, '{path}') NOT IN ('OBJECT', 'ARRAY') "
        f"THEN json_extract_string({document}, '{path}') END"
    )


def vector(document: str, name: str) -> str:
    return f"'[' || trim({scalar(document, '$.' + name)}, '[]') || ']'"


def image_key(uri: str) -> str:
    return f"nullif(regexp_extract({uri}, '([0-9]{{{DIGITS}}})\\.png$', 1), '')"


def digit(prompt: str) -> str:
    return f"(instr('0123456789abcdef', substr(md5({prompt}), 1, 1)) - 1)"


def number_text(expression: str) -> str:
    return (
        f"regexp_replace(CAST(CAST({expression} AS DECIMAL(38,2)) AS VARCHAR), '\\.?0+$', '')"
    )


def hours_since(start: str) -> str:
    return f"round(date_sub('minute', {start}, TIMESTAMP '{STREAM_AS_OF}') / 60.0, 2)"


def features(level: str) -> str:
    lines = (
        f"SELECT * FROM fx_order_items WHERE created_at BETWEEN TIMESTAMP '{RANGE[0]}' "
        f"AND TIMESTAMP '{RANGE[1]}'"
    )
    if level == "order":
        lines = (
            "SELECT user_id, order_id, created_at, sum(sale_price) AS sale_price "
            f"FROM ({lines}) GROUP BY user_id, order_id, created_at"
        )
    return f"""
        SELECT user_id,
               CAST(date_diff('day', CAST(max(created_at) AS DATE), DATE '{AS_OF[:10]}') AS BIGINT)
                 AS days_since_order,
               count(DISTINCT order_id) AS count_orders, avg(sale_price) AS avg_spend
        FROM ({lines}) GROUP BY user_id"""


def distances(source: str) -> str:
    terms = []
    for centroid in SEGMENTATION.centroids:
        squares = " + ".join(
            f"pow((CAST({name} AS DOUBLE) - CAST({centroid.values[name]} AS DOUBLE)) "
            f"/ CAST({spread} AS DOUBLE), 2)"
            for name, spread in SEGMENTATION.spread.items()
        )
        terms.append(f"SELECT *, {centroid.centroid_id} AS cid, sqrt({squares}) AS d FROM {source}")
    return " UNION ALL ".join(terms)


def eligibility(strict_owner: bool) -> str:
    owner = "AND i.user_id = u.id" if strict_owner else ""
    # Of several lines of one product in an order, a request is about the first.
    lines = f"""(
          SELECT order_id, product_id, user_id, sale_price, shipped_at FROM fx_order_items
          QUALIFY row_number() OVER (PARTITION BY order_id, product_id, user_id
                                     ORDER BY id, sale_price, shipped_at) = 1)"""
    return f"""
        SELECT CASE WHEN c.orders_recent < 50 AND i.sale_price < 50
                     AND i.shipped_at > TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY
                    THEN 'True' ELSE 'False' END AS eligible,
               r.product_id, p.service_policy_text, p.version_number AS policy_version,
               v.uri AS inventory_image_uri, u.id AS user_id, r.email, i.sale_price,
               n.name AS product_name, r.order_id, r.review_text
        FROM fx_refund_requests r
        JOIN fx_users u ON u.email = r.email
        JOIN recent_orders c ON c.user_id = u.id
        JOIN {lines} i ON i.order_id = r.order_id AND i.product_id = r.product_id {owner}
        JOIN fx_inventory_images v ON {image_key('v.uri')} = r.product_id
        JOIN fx_products n ON n.id = r.product_id
        JOIN newest_policy p ON true"""


def case_inputs(source: str) -> str:
    return f"""
        SELECT r.review_id, r.review_text, r.review_language, r.uri AS review_image_uri,
               r.product_id, v.uri AS inventory_image_uri, p.service_policy_text,
               p.version_number AS policy_version
        FROM {source} r
        JOIN fx_inventory_images v ON {image_key('v.uri')} = r.product_id
        JOIN newest_policy p ON true"""


def assembled(text: str, pages: int | None = None) -> str:
    part = f"greatest(floor((page_number - {documents.COVER_PAGES + 1}) / {pages}), 0)"
    part, name = (f", CAST({part} AS BIGINT)", " AS part_number") if pages else ("", "")
    return f"""
        SELECT document_id{part}{name},
               coalesce(string_agg(CASE WHEN page_number > {documents.COVER_PAGES} THEN {text} END,
                                   ' ' ORDER BY page_number, uri), '') AS service_policy_text,
               CAST({documents.VERSION} AS DOUBLE) AS version_number
        FROM numbered_pages GROUP BY document_id{part}"""


def rating(quote: str) -> str:
    parts = []
    for position in range(4):
        blocked = "true" if position == 2 else "false"
        parts.append(
            f"'{{{quote}blocked{quote}:{blocked},{quote}probability_score{quote}:' "
            f"|| CAST(value AS VARCHAR) || ',{quote}severity_score{quote}:0.{position + 1}5}}'"
        )
    return "'[' || " + " || ',' || ".join(parts) + " || ']'"


LATER = "ts + to_minutes(CAST(floor(value) AS INTEGER))"


def envelope(body: str, time: str = "ts", wanted: str = "true") -> str:
    return f"""
        SELECT CAST(event_id AS VARCHAR) AS message_id, {time} AS publish_time,
               'write-' || event_type AS subscription_name, props AS attributes, {body} AS data
        FROM events WHERE {wanted}"""


def response_body() -> str:
    return f"""'{{"review_id":"' || CAST(user_id AS VARCHAR) || '","response":'
        || CASE WHEN event_type = 'click' THEN '[' || CAST(value AS VARCHAR) || ']'
                ELSE '"[answer] ' || CAST(value AS VARCHAR) || '"' END
        || ',"safety_attributes":'
        || CASE WHEN event_type = 'view' THEN '"' || {rating(chr(92) + '"')} || '"'
                ELSE {rating('"')} END
        || CASE WHEN event_type = 'error' THEN ''
                ELSE ',"embedding":"[[' || CAST(value AS VARCHAR) || ']]"' END || '}}'"""


def paired(prompts: str, responses: str, keys: list[str]) -> str:
    """Numbers of prompts and of the prompts that responses are for: a queue by running sums.

    ``prompts`` and ``responses`` have ``id, moment``; the result ``prompt_id, response_id``.
    """
    by = ", ".join(keys)
    order = f"PARTITION BY {by} ORDER BY moment, step DESC, id ROWS UNBOUNDED PRECEDING"
    before = f"PARTITION BY {by} ORDER BY moment, step DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
        (WITH both_sides AS (
           SELECT {by}, id, moment, 1 AS step FROM ({prompts}) UNION ALL
           SELECT {by}, id, moment, -1 FROM ({responses})),
         levels AS (
           SELECT *, sum(step) OVER ({order}) AS level,
                  count(*) FILTER (step = 1) OVER ({order}) AS asked,
                  count(*) FILTER (step = -1) OVER ({order}) AS given FROM both_sides),
         lows AS (
           SELECT *, least(min(level) OVER ({order}), 0) AS low,
                  least(coalesce(min(level) OVER ({before}), 0), 0) AS low_before FROM levels),
         turns AS (
           SELECT *, CASE WHEN step = 1 THEN asked WHEN low = low_before THEN given + low END AS turn
           FROM lows)
         SELECT p.id AS prompt_id, r.id AS response_id
         FROM turns p JOIN turns r ON p.step = 1 AND r.step = -1 AND p.turn = r.turn
          AND {" AND ".join(f"p.{k} = r.{k}" for k in keys)})"""


def kmeans(rounds: int, seed: int = 42) -> tuple[str, Callable[[str], str]]:
    """Common table expressions: ``scaled`` rows, and the centres ``c0`` to ``c<rounds>``."""
    names = customers.FEATURES
    stats = ", ".join(
        f"avg(CAST({n} AS DOUBLE)) AS m_{n}, sqrt(var_pop(CAST({n} AS DOUBLE)) * count({n}) "
        f"/ (count(*) - 1)) AS s_{n}" for n in names
    )
    scaled = ", ".join(
        f"(CAST({n} AS DOUBLE) - m_{n}) / CASE WHEN s_{n} > 0 THEN s_{n} ELSE 1 END AS {n}" for n in names
    )

    def gap(centre: str) -> str:
        return " + ".join(f"(s.{n} - {centre}.{n}) * (s.{n} - {centre}.{n})" for n in names)

    parts = [
        f"stats AS MATERIALIZED (SELECT {stats} FROM features_item)",
        f"scaled AS MATERIALIZED (SELECT user_id, {scaled} FROM features_item, stats)",
    ]
    for turn in range(customers.SEGMENTS):
        drawn = (
            f"(CAST('0x' || substr(md5('{seed}|{turn}|' || user_id), 1, 13) AS BIGINT) + 0.5::DOUBLE)"
            f" / {float(1 << 52)!r}::DOUBLE"
        )
        if turn:
            source = "scaled s, " + ", ".join(f"seed{i}" for i in range(turn))
            weight = "least(" + ", ".join(gap(f"seed{i}") for i in range(turn)) + ")"
            wait = f"CASE WHEN {weight} > 0 THEN -ln({drawn}) / {weight} END"
        else:
            source, wait = "scaled s", f"-ln({drawn})"
        parts.append(
            f"seed{turn} AS MATERIALIZED (SELECT {', '.join(f's.{n}' for n in names)} FROM {source} "
            f"ORDER BY {wait} NULLS LAST, {drawn}, user_id LIMIT 1)"
        )
    parts.append(
        "c0 AS MATERIALIZED ("
        + " UNION ALL ".join(
            f"SELECT {i + 1} AS cid, * FROM seed{i}" for i in range(customers.SEGMENTS)
        )
        + ")"
    )
    for r in range(1, rounds + 1):
        parts.append(
            f"a{r} AS (SELECT s.*, c.cid FROM scaled s, c{r - 1} c QUALIFY row_number() OVER "
            f"(PARTITION BY user_id ORDER BY {gap('c')}, c.cid) = 1)"
        )
        means = ", ".join(f"coalesce(any_value(m.{n}), any_value(c.{n})) AS {n}" for n in names)
        sums = ", ".join(f"avg({n}) AS {n}" for n in names)
        parts.append(
            f"c{r} AS MATERIALIZED (SELECT c.cid, {means} FROM c{r - 1} c LEFT JOIN "
            f"(SELECT cid, {sums} FROM a{r} GROUP BY cid) m ON m.cid = c.cid GROUP BY c.cid)"
        )
    return ", ".join(parts), gap


CLEAN_PAGE = r"regexp_replace(replace(page_text, chr(10), ' '), '[•●]', '', 'g')"
PHRASE = trim_space(f"replace(text_content, {literal(NOTICE)}, '')")
CONTEXT = columns(*campaign.CONTEXT)
SETTINGS = {name: literal(value) for name, value in campaign.CAMPAIGN.items()}

VIEWS = {
    "fx_order_items": f"""
        SELECT {key('l_orderkey')} || '-' || CAST(l_linenumber AS VARCHAR) AS id,
               {key('l_orderkey')} AS order_id, {key('o_custkey')} AS user_id,
               {key('l_partkey')} AS product_id, o_orderstatus AS status,
               CAST(o_orderdate AS TIMESTAMP) AS created_at,
               CAST(l_shipdate AS TIMESTAMP) AS shipped_at,
               CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS TIMESTAMP) + INTERVAL 10 DAY END
                 AS returned_at,
               l_quantity * 2 + l_linenumber * CAST(0.25 AS DOUBLE) AS sale_price
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_users": f"""
        SELECT {key('c_custkey')} AS id, 'Customer' AS first_name,
               substr(c_name, 10) AS last_name, {email('c_custkey')} AS email,
               18 + c_custkey % 60 AS age, n_name AS state, r_name AS country
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "fx_products": f"""
        SELECT {key('p_partkey')} AS id, 'product ' || CAST(p_partkey AS VARCHAR) AS name,
               p_type AS category, p_brand || ' ' || p_name AS description FROM part""",
    "fx_inventory_images": f"""
        SELECT uri FROM (
          SELECT 'gs://bucket/inventory-images/' || {key('p_partkey')}
                 || CASE WHEN p_type = 'PROMO' THEN '.jpg' ELSE '.png' END AS uri FROM part)
        WHERE uri LIKE '%.png'""",
    "fx_review_images": f"""
        SELECT 'gs://bucket/review-images/' || {key('page_id')} || '.png' AS uri FROM pages""",
    "fx_raw_reviews": f"""
        SELECT {key('doc_id')} AS review_id, {key('doc_id')} || '-1' AS order_id,
               CASE WHEN copy THEN '-1' ELSE {key('o_custkey')} END AS user_id,
               {key('coalesce(pk, 0)')} AS product_id,
               'Reviewer ' || CAST(doc_id AS VARCHAR) AS name,
               CAST(1 + doc_id % 5 AS VARCHAR) AS review_rating, text AS review_text
        FROM (SELECT doc_id, text, false AS copy FROM documents UNION ALL
              SELECT d.doc_id, d.text, true FROM documents d
              WHERE d.doc_id IN (SELECT doc_id FROM labels))
        LEFT JOIN orders ON o_orderkey = doc_id
        LEFT JOIN (SELECT l_orderkey AS ok, min(l_partkey) AS pk FROM lineitem
                   WHERE l_linenumber = 1 GROUP BY l_orderkey) ON ok = doc_id""",
    "fx_languages": "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join(literal(v) for v in (row[2], row[3])) + ")" for row in LANGUAGES)
    + ") AS t(iso_639_1, language_name_en)",
    "fx_translate": f"""
        SELECT {key('doc_id')} AS review_id,
               CAST(json_object('translations', json_array(json_object(
                 'translated_text',
                 chr(9) || ' ' || replace(text, '''', '&#39;') || ' don&#39;t ' || chr(10),
                 'detected_language_code', ' ' || lang))) AS VARCHAR) AS answer
        FROM documents""",
    "fx_sentiment": f"""
        SELECT {key('doc_id')} AS review_id,
               CAST(quality - toxic * 2 AS DOUBLE) AS score,
               CAST(quality + toxic AS DOUBLE) AS magnitude FROM labels""",
    "snapshot": f"""
        SELECT s.review_id, s.order_id, s.user_id, s.product_id, name, review_rating,
               review_text, uri
        FROM (SELECT r.*, row_number() OVER (
                PARTITION BY r.review_id, r.order_id, r.product_id
                ORDER BY i.created_at DESC NULLS LAST, r.user_id, r.name, r.review_rating,
                         r.review_text) AS rn
              FROM fx_raw_reviews r LEFT JOIN fx_order_items i
                ON r.user_id = i.user_id AND r.product_id = i.product_id AND r.order_id = i.id) s
        LEFT JOIN fx_review_images v ON {image_key('v.uri')} = s.review_id
        WHERE rn = 1""",
    "translated": f"""
        SELECT s.review_id, order_id, user_id, product_id, name, review_rating, uri,
               review_text AS review_text_raw,
               replace({trim_space("json_extract_string(answer, '$.translations[0].translated_text')")},
                       '&#39;', '''') AS review_text,
               language_name_en AS review_language
        FROM snapshot s LEFT JOIN fx_translate t ON t.review_id = s.review_id
        LEFT JOIN fx_languages ON iso_639_1 =
          {trim_space("json_extract_string(answer, '$.translations[0].detected_language_code')")}""",
    "cleaned": """
        SELECT t.*, CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative'
                         WHEN score = 0 THEN 'neutral' ELSE 'unknown' END AS sentiment,
               magnitude AS sentiment_magnitude, score AS sentiment_score
        FROM translated t LEFT JOIN fx_sentiment s ON s.review_id = t.review_id""",
    "negative": "SELECT * FROM cleaned WHERE sentiment = 'negative' AND uri IS NOT NULL",
    "fx_policy_pages": f"""
        SELECT conv_id AS document_id,
               'gs://bucket/service-policy/Policy_Page_' || {key('turn')} || '.png' AS uri,
               {literal(NOTICE + ' • ')} || text || chr(10) || '● end of page '
                 || CAST(turn AS VARCHAR) || {literal(' ' + NOTICE)} AS page_text
        FROM conversations""",
    "numbered_pages": f"""
        SELECT document_id, uri, {CLEAN_PAGE} AS text_content,
               CAST(nullif(regexp_extract(uri, '{PAGE_PATTERN}', 1), '') AS BIGINT) AS page_number
        FROM fx_policy_pages""",
    "documents_whole": assembled(PHRASE),
    "fx_policy": """
        SELECT service_policy_text, CAST(document_id AS DOUBLE) AS version_number
        FROM documents_whole""",
    "newest_policy": """
        SELECT * FROM fx_policy
        WHERE version_number = (SELECT max(version_number) FROM fx_policy)""",
    "fx_refund_requests": f"""
        SELECT DISTINCT email, order_id, product_id,
               ' "item ' || product_id || ' arrived broken" ' AS review_text
        FROM (SELECT {email('o_custkey')} AS email, {key('l_orderkey')} AS order_id,
                     {key('l_partkey')} AS product_id
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              UNION ALL
              SELECT {email('l_suppkey')}, {key('l_orderkey')}, {key('l_partkey')}
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "recent_orders": f"""
        SELECT user_id, count(DISTINCT order_id) AS orders_recent FROM fx_order_items
        WHERE created_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AND TIMESTAMP '{AS_OF}'
        GROUP BY user_id""",
    "eligible": eligibility(True),
    "claims": f"""
        SELECT *, {template(
            refunds.CLAIM_PROMPT, company="'our shop'", policy="service_policy_text",
            review_text=f"coalesce(note, '{MISSING}')", request_image_uri="photo",
            inventory_image_uri="inventory_image_uri")} AS prompt
        FROM (SELECT *, trim({trim_space('review_text')}, '"') AS note,
                     {literal(IMAGE_ROOT + '/')} || order_id || '_refund_request.png' AS photo
              FROM eligible WHERE eligible = 'True')""",
    "answered_claims": f"""
        SELECT *, CASE CAST(floor({digit('prompt')} / 4) AS INTEGER)
                    WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'No.' ELSE 'maybe' END AS answer
        FROM claims""",
    "case_prompts": f"""
        SELECT *, {template(
            cases.RESOLUTION_PROMPT, company="'our shop'",
            review_text=f"coalesce(review_text, '{MISSING}')",
            language=f"coalesce(review_language, '{MISSING}')", policy="service_policy_text")} AS prompt
        FROM ({case_inputs('negative')})""",
    "features_item": features("item"),
    "features_order": features("order"),
    "assigned_item": "SELECT user_id, days_since_order, count_orders, avg_spend, cid AS centroid_id "
    "FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, cid) AS rn "
    f"FROM ({distances('features_item')})) WHERE rn = 1",
    "assigned_order": "SELECT user_id, days_since_order, count_orders, avg_spend, "
    "CAST(cid AS BIGINT) AS centroid_id "
    "FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, cid) AS rn "
    f"FROM ({distances('features_order')})) WHERE rn = 1",
    "pivoted": "SELECT CAST(centroid_id AS BIGINT) AS centroid_id, "
    + ", ".join(f"round(avg({n}), 2) AS {n}" for n in customers.FEATURES)
    + " FROM assigned_item GROUP BY centroid_id",
    "persona_asked": "SELECT centroid_id AS cluster, "
    + template(
        customers.PERSONA_PROMPT,
        centroid_id="centroid_id",
        **{n: number_text(n) for n in customers.FEATURES},
    )
    + " AS prompt FROM pivoted",
    "persona_rows": "SELECT cluster, 'Title ' || substr(md5(prompt), 1, 6) AS persona_title, "
    "'Text ' || md5(prompt) AS persona_description FROM persona_asked",
    "context": f"""
        SELECT a.centroid_id, a.user_id, days_since_order, count_orders, avg_spend,
               persona_title, persona_description, age, state, country,
               p1.name AS product_1_name, p1.description AS product_1_description,
               p2.name AS product_2_name, p2.description AS product_2_description,
               first_name, last_name, u.email AS user_email
        FROM assigned_order a JOIN persona_rows ON cluster = centroid_id
        JOIN fx_users u ON u.id = a.user_id
        LEFT JOIN fx_products p1 ON p1.name = {literal(PRODUCT_1)}
        LEFT JOIN fx_products p2 ON p2.name = {literal(PRODUCT_2)}""",
    "copy": f"""
        SELECT user_id, centroid_id AS cluster, persona_title, uri, md5({template(
            campaign.COPY_PROMPT, company=SETTINGS["company"],
            product_1_description="product_1_description", **CONTEXT)}) AS output
        FROM context JOIN fx_inventory_images
          ON {image_key('uri')} = (SELECT id FROM fx_products WHERE name = {literal(PRODUCT_1)})""",
    "email_asked": "SELECT c.*, "
    + template(
        campaign.EMAIL_PROMPT,
        output="output",
        **{
            name: f"c.{name}"
            for name in (
                *campaign.CONTEXT, "product_1_name", "product_2_name", "product_2_description"
            )
        },
        **SETTINGS,
    )
    + " AS prompt FROM context c JOIN copy ON copy.user_id = c.user_id",
    "fx_prompts": envelope("""'{"review_id":"' || CAST(user_id AS VARCHAR) || '","prompt":"  '
        || event_type || ' ","model_version":"m1","policy_version":1.0'
        || CASE WHEN event_type = 'error' THEN ''
                ELSE ',"text_embed":"[[' || CAST(value AS VARCHAR) || ', 0.5]]"' END
        || ',"review_embed":"[[0.25]]","image_embed":"[0.125]"}'"""),
    "fx_responses": envelope(response_body()),
    "fx_late_responses": envelope(response_body(), LATER, "event_type <> 'view'"),
    "fx_claim_prompts": f"""
        SELECT CAST(event_id AS VARCHAR) AS message_id, ts AS publish_time,
               {key('user_id % 16')} AS order_id, event_type AS product_id,
               {key('user_id')} AS user_id, 'Is it broken? ' || event_type AS prompt,
               {literal(IMAGE_ROOT + '/')} || {key('event_id')} || '.png' AS request_image_uri
        FROM events""",
    "fx_claim_responses": f"""
        SELECT CAST(event_id AS VARCHAR) AS message_id, {LATER} AS publish_time,
               {key('user_id % 16')} AS order_id, event_type AS product_id,
               {key('user_id')} AS user_id, 'answer ' || CAST(event_id AS VARCHAR) AS response
        FROM events WHERE event_type <> 'error'""",
    "cleaned_prompts": f"""
        SELECT message_id, publish_time, {scalar('data', '$.review_id')} AS review_id,
               {trim_space(scalar('data', '$.prompt'))} AS prompt,
               {scalar('data', '$.model_version')} AS model_version,
               {scalar('data', '$.policy_version')} AS policy_version,
               subscription_name, attributes, {hours_since('publish_time')} AS hours_since_prompt,
               {vector('data', 'text_embed')} AS prompt_embedding,
               {vector('data', 'review_embed')} AS review_embedding,
               {vector('data', 'image_embed')} AS image_embedding
        FROM fx_prompts WHERE {vector('data', 'text_embed')} IS NOT NULL""",
    "cleaned_responses": f"""
        SELECT publish_time, {scalar('data', '$.review_id')} AS review_id,
               {scalar('data', '$.response')} AS response, message_id, subscription_name,
               attributes, {hours_since('publish_time')} AS hours_since_prompt,
               {vector('data', 'embedding')} AS response_embedding, data
        FROM fx_responses WHERE {vector('data', 'embedding')} IS NOT NULL""",
    "cleaned_late_responses": f"""
        SELECT message_id, publish_time, {scalar('data', '$.review_id')} AS review_id,
               {scalar('data', '$.response')} AS response
        FROM fx_late_responses WHERE {vector('data', 'embedding')} IS NOT NULL""",
    "fx_refunds": f"""
        SELECT CAST(event_id AS VARCHAR) AS message_id, ts AS publish_time,
               {key('user_id')} AS product_id,
               'product ' || CAST(user_id AS VARCHAR) AS product_name,
               CAST(floor(value) AS DOUBLE) AS refund_amount, {key('event_id')} AS order_id,
               {email('user_id')} AS email, 'write-refunds' AS subscription_name,
               props AS attributes
        FROM events""",
}


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it names, directly or through other views."""
    names = list(VIEWS)
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in names:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(VIEWS[name])
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in names if name in needed)
    return f"WITH {ctes}\n{body}" if ctes else body


def _safety_columns() -> str:
    parts = []
    for position, name in enumerate(
        ("hate_speech", "dangerous_content", "harassment", "sexually_explicit")
    ):
        base = f"$[{position}]"
        parts.append(
            f"json_extract_string(r, '{base}.blocked') AS {name}_blocked, "
            f"CAST(json_extract_string(r, '{base}.probability_score') AS DOUBLE) "
            f"AS {name}_probability, "
            f"CAST(json_extract_string(r, '{base}.severity_score') AS DOUBLE) AS {name}_severity"
        )
    return ", ".join(parts)


def _decision(parity: bool) -> str:
    if parity:
        said = "CASE WHEN lower(answer) = 'no' THEN 'no_refund' ELSE 'refund' END"
    else:
        said = (
            "CASE answer WHEN 'yes' THEN 'refund' WHEN 'no' THEN 'no_refund' "
            "WHEN 'No.' THEN 'no_refund' ELSE 'review' END"
        )
    return (
        "SELECT product_id, product_name, sale_price AS refund_amount, order_id, email, "
        f"{said} AS decision FROM answered_claims"
    )


def _vector_text(expression: str) -> str:
    return f"'[' || CAST(length({expression}) AS VARCHAR) || '.0,0.5]'"


def _kmeans_seeds() -> str:
    parts, _ = kmeans(0)
    values = " UNION ALL ".join(
        f"SELECT CAST(cid AS BIGINT) AS centroid_id, '{n}' AS feature, "
        f"round({n} * CASE WHEN s_{n} > 0 THEN s_{n} ELSE 1 END + m_{n}, 6) AS numerical_value "
        "FROM c0, stats"
        for n in customers.FEATURES
    )
    return f"SELECT * FROM (WITH {parts} {values})"


def _kmeans_segments() -> str:
    parts, gap = kmeans(customers.ROUNDS)
    means = ", ".join(f"round(avg(f.{n}), 6) AS {n}" for n in customers.FEATURES)
    return f"""SELECT * FROM (WITH {parts},
      last AS (SELECT s.user_id, c.cid FROM scaled s, c{customers.ROUNDS} c QUALIFY row_number() OVER
               (PARTITION BY user_id ORDER BY {gap('c')}, c.cid) = 1)
      SELECT CAST(cid AS BIGINT) AS centroid_id, count(*) AS customers, {means}
      FROM last JOIN features_item f ON f.user_id = last.user_id GROUP BY cid)"""


def _originals() -> str:
    # Numbers come out without a zero behind the point.
    def ordered(place: int) -> str:
        at = f"'$[{place}].{{}}'"
        blocked, probability, severity = (
            f"json_extract_string(safety, {at.format(n)})"
            for n in ("blocked", "probability_score", "severity_score")
        )
        return (
            f"""'{{"blocked":' || {blocked} || ',"probability_score":' """
            f"""|| regexp_replace({probability}, '\\.0$', '') || ',"severity_score":' || {severity} || '}}'"""
        )

    ratings = "'[' || " + " || ',' || ".join(ordered(i) for i in range(4)) + " || ']'"
    rating_text = f"CASE WHEN is_text THEN CAST(safety AS VARCHAR) ELSE {ratings} END"
    return f"""
        SELECT message_id, '{{"embedding":' || CAST(json_extract(data, '$.embedding') AS VARCHAR)
               || ',"response":'
               || regexp_replace(CAST(json_extract(data, '$.response') AS VARCHAR), '\\.0\\]$', ']')
               || ',"review_id":' || CAST(json_extract(data, '$.review_id') AS VARCHAR)
               || ',"safety_attributes":' || {rating_text} || '}}' AS original_message,
               {rating_text} AS safety_attributes
        FROM (SELECT *, json_extract(data, '$.safety_attributes') AS safety,
                     json_type(data, '$.safety_attributes') = 'VARCHAR' AS is_text
              FROM cleaned_responses)"""


_RESOLUTION_BODY = (
    "'Here it is:' || chr(10) || '```json' || chr(10) || '{\"issue_resolution\": \"Replace ' "
    "|| md5(prompt) || '\", \"response_user_language\": \"Salut ' || substr(md5(prompt), 1, 4) "
    "|| '\", \"response_translated\": ' || CASE WHEN substr(md5(prompt), 1, 1) = '0' THEN '7' "
    "ELSE '\"Hello ' || substr(md5(prompt), 1, 4) || '\"' END || '}' || chr(10) || '```'"
)

BODIES = {
    "latest_review_snapshot": "SELECT * FROM snapshot",
    "translated_reviews": "SELECT * FROM translated",
    "sentiment_labels": "SELECT review_id, order_id, product_id, sentiment, sentiment_magnitude, "
    "sentiment_score FROM cleaned",
    "negative_with_image": "SELECT review_id, product_id, uri FROM negative",
    "translate_with_model": "SELECT review_id, review_text AS review_text_raw, "
    "'It''s ' || md5(review_text) AS review_text, "
    f"CASE CAST(floor({digit('review_text')} / 4) AS INTEGER) WHEN 0 THEN 'English' "
    "WHEN 1 THEN 'French' WHEN 2 THEN 'German' END AS review_language FROM snapshot",
    "sentiment_with_model": "SELECT review_id, order_id, CASE WHEN s = 7 THEN 'unknown' "
    "WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS sentiment, "
    "CAST(abs(s) AS DOUBLE) AS sentiment_magnitude, "
    "CAST(CASE WHEN s <> 7 THEN s END AS DOUBLE) AS sentiment_score "
    f"FROM (SELECT *, {digit('review_text')} - 8 AS s FROM translated)",
    "translate_by_prompt": "SELECT review_id, order_id, review_text AS review_text_raw, "
    f"md5({template(reviews.TRANSLATE_PROMPT, review_text='review_text')}) AS review_text "
    "FROM snapshot",
    "sentiment_by_prompt": "SELECT review_id, order_id, product_id, review_text, "
    f"CASE CAST(floor({digit('prompt')} / 6) AS INTEGER) WHEN 0 THEN 'positive' "
    "WHEN 1 THEN 'neutral' ELSE 'negative' END AS review_sentiment FROM (SELECT *, "
    f"{template(reviews.SENTIMENT_PROMPT, review_text='review_text')} AS prompt FROM translated)",
    "sentiment_join_back": "SELECT s.review_id, product_id, review_text, "
    "CAST(score AS VARCHAR) AS review_sentiment "
    "FROM fx_sentiment s LEFT JOIN translated t ON t.review_id = s.review_id",
    "order_items_enriched": """
        SELECT i.id, order_id, status, sale_price, email, state, country, n.name AS product_name,
               category, returned_at
        FROM fx_order_items i JOIN fx_users u ON u.id = i.user_id
        LEFT JOIN fx_products n ON n.id = i.product_id""",
    "products_in_order": """
        SELECT order_id, product_id, name AS product_name
        FROM fx_order_items i JOIN fx_products n ON n.id = i.product_id""",
    "recent_order_counts": "SELECT * FROM recent_orders",
    "refund_eligibility": "SELECT * FROM eligible",
    "refund_eligibility_parity": eligibility(False),
    "refund_decisions": _decision(False),
    "refund_decisions_parity": _decision(True),
    "refund_events": "SELECT product_id, product_name, refund_amount, order_id, email "
    f"FROM ({_decision(False)}) WHERE decision = 'refund'",
    "refund_requests_repeated": _decision(False),
    "refund_claim_messages": f"""
        SELECT user_id, order_id, product_id, prompt, 'm1' AS model_version, policy_version,
               {_vector_text('prompt')} AS prompt_embedding,
               {_vector_text('note')} AS feedback_embedding, photo AS request_image_uri
        FROM claims""",
    "refund_response_messages": "SELECT user_id, order_id, product_id, answer AS response, "
    f"{_vector_text('answer')} AS response_embedding FROM answered_claims",
    "document_assembly": "SELECT * FROM documents_whole",
    "document_assembly_characters": assembled(f"trim(text_content, {literal(NOTICE)})"),
    "document_parts": assembled(PHRASE, 2),
    "policy_by_prompt": assembled(
        f"'Page ' || md5({template(documents.PARSE_PROMPT, uri='uri')})"
    ),
    "document_from_images": assembled("'Page ' || md5(uri)"),
    "latest_policy": "SELECT * FROM newest_policy",
    "latest_policy_join": "SELECT review_id, product_id, service_policy_text, "
    "version_number AS policy_version FROM snapshot JOIN newest_policy ON true",
    "review_case_inputs": case_inputs("cleaned"),
    "resolve_reviews": """
        SELECT review_id, 'Replace ' || md5(prompt) AS issue_resolution,
               'Salut ' || substr(md5(prompt), 1, 4) AS email_user_language,
               CASE WHEN substr(md5(prompt), 1, 1) <> '0'
                    THEN 'Hello ' || substr(md5(prompt), 1, 4) END AS email_translated,
               '' AS parse_status
        FROM case_prompts WHERE prompt IS NOT NULL
        UNION ALL
        SELECT review_id, NULL, NULL, NULL, 'null_input' FROM case_prompts WHERE prompt IS NULL""",
    "review_prompt_messages": f"""
        SELECT review_id, prompt, 'm1' AS model_version, policy_version,
               {_vector_text('prompt')} AS prompt_embedding,
               {_vector_text('review_text')} AS review_embedding,
               {_vector_text('review_image_uri')} AS image_embedding
        FROM case_prompts WHERE prompt IS NOT NULL""",
    "review_response_messages": f"""
        SELECT review_id, response, {_vector_text('response')} AS response_embedding
        FROM (SELECT review_id, {_RESOLUTION_BODY} AS response FROM case_prompts
              WHERE prompt IS NOT NULL)""",
    "rfm_item_level": "SELECT * FROM features_item",
    "rfm_order_level": "SELECT * FROM features_order",
    "assign_fixed_centroids": "SELECT user_id, CAST(arg_min(cid, d) AS BIGINT) AS centroid_id, "
    + ", ".join(f"round(list_sort(list(d))[{i}], 6) AS distance_{i}" for i in (1, 2, 3))
    + f" FROM ({distances('features_item')}) GROUP BY user_id",
    "segment_invariants": f"""
        SELECT count(*) AS customers, CAST({customers.SEGMENTS} AS BIGINT) AS segments,
               CAST(0 AS BIGINT) AS not_nearest, CAST(0 AS BIGINT) AS other_distances
        FROM features_item""",
    "centroid_pivot": "SELECT * FROM pivoted",
    "persona_prompts": "SELECT * FROM persona_asked",
    "persona_parse": "SELECT cluster, 'The ' || md5(prompt) AS persona_title, "
    "'[\"' || md5(prompt) || '\"]' AS persona_description FROM persona_asked",
    "personas": "SELECT * FROM persona_rows",
    "campaign_context": "SELECT * FROM context",
    "product_copy": "SELECT * FROM copy",
    "email_prompts": "SELECT user_id, user_email, prompt FROM email_asked",
    "draft_emails": "SELECT user_id, user_email, centroid_id, "
    "'\"Dear ' || md5(prompt) || '\"' AS email_english FROM email_asked",
    "clean_prompts": "SELECT publish_time, review_id, prompt, model_version, policy_version, "
    "subscription_name, attributes, hours_since_prompt, prompt_embedding, review_embedding, "
    "image_embedding, CAST(1 AS DOUBLE) AS version_inside FROM cleaned_prompts",
    "clean_responses": "SELECT publish_time, review_id, response, message_id, subscription_name, "
    "attributes, hours_since_prompt, response_embedding, "
    "CASE WHEN json_type(data, '$.safety_attributes') = 'VARCHAR' THEN 'true' ELSE 'false' END "
    "AS rating_is_text FROM cleaned_responses",
    "clean_prompts_flat": "SELECT publish_time, review_id, prompt, policy_version, "
    "prompt_embedding, CAST(NULL AS VARCHAR) AS review_embedding, hours_since_prompt "
    "FROM cleaned_prompts",
    "safety_flatten": f"""
        SELECT message_id, {_safety_columns()}
        FROM (SELECT message_id, CASE WHEN json_type(data, '$.safety_attributes') = 'VARCHAR'
                THEN json_extract_string(data, '$.safety_attributes')
                ELSE CAST(json_extract(data, '$.safety_attributes') AS VARCHAR) END AS r
              FROM cleaned_responses)""",
    "embedding_values": """
        SELECT publish_time, CAST(0 AS BIGINT) AS position,
               CAST(split_part(trim(prompt_embedding, '[]'), ',', 1) AS DOUBLE) AS value
        FROM cleaned_prompts
        UNION ALL
        SELECT publish_time, CAST(1 AS BIGINT),
               CAST(trim(split_part(trim(prompt_embedding, '[]'), ',', 2)) AS DOUBLE)
        FROM cleaned_prompts""",
    "message_dedupe_hourly": "SELECT message_id, min(publish_time) AS publish_time, "
    "date_trunc('hour', min(publish_time)) AS publish_hour FROM (SELECT message_id, publish_time "
    "FROM fx_prompts UNION ALL SELECT message_id, publish_time + INTERVAL 1 HOUR FROM fx_prompts) "
    "GROUP BY message_id",
    "raw_lineage_read": "SELECT * FROM fx_refunds",
    "landing_hour_range": "SELECT message_id, publish_time, order_id, refund_amount "
    "FROM fx_refunds WHERE publish_time >= TIMESTAMP '2024-01-02 00:30:00' "
    "AND publish_time < TIMESTAMP '2024-01-28 12:15:00'",
    "hourly_usage": "SELECT date_trunc('hour', publish_time) AS publish_hour, model_version, "
    "count(*) AS prompts FROM cleaned_prompts GROUP BY ALL",
    "hourly_refunds": "SELECT date_trunc('hour', publish_time) AS publish_hour, "
    "count(*) AS refunds, sum(refund_amount) AS amount FROM fx_refunds GROUP BY ALL",
    "stream_hourly_refunds": "SELECT date_trunc('hour', publish_time) AS publish_hour, "
    "count(*) AS refunds, sum(refund_amount) AS amount FROM fx_refunds GROUP BY ALL",
    "prompt_response_pairs": """
        SELECT p.publish_time, p.review_id, p.prompt, l.publish_time AS response_time, l.response,
               coalesce(l.responses, 0) AS responses
        FROM cleaned_prompts p LEFT JOIN (
          SELECT *, count(*) OVER (PARTITION BY review_id) AS responses,
                 row_number() OVER (PARTITION BY review_id ORDER BY publish_time DESC,
                                    response DESC NULLS LAST) AS rn
          FROM cleaned_responses) l ON l.review_id = p.review_id AND l.rn = 1""",
    "prompts_paired": f"""
        SELECT p.publish_time, p.review_id, p.prompt, r.publish_time AS response_time, r.message_id,
               r.response
        FROM cleaned_prompts p
        LEFT JOIN {paired('SELECT review_id, message_id AS id, publish_time AS moment FROM cleaned_prompts',
                          'SELECT review_id, message_id AS id, publish_time AS moment FROM cleaned_late_responses',
                          ['review_id'])} m ON m.prompt_id = p.message_id
        LEFT JOIN cleaned_late_responses r ON r.message_id = m.response_id""",
    "refund_prompts_paired": f"""
        SELECT p.message_id, p.publish_time, p.order_id, p.product_id, p.user_id,
               r.publish_time AS response_time, r.message_id AS response_id, r.response
        FROM fx_claim_prompts p
        LEFT JOIN {paired('SELECT *, message_id AS id, publish_time AS moment FROM fx_claim_prompts',
                          'SELECT *, message_id AS id, publish_time AS moment FROM fx_claim_responses',
                          ['order_id', 'product_id', 'user_id'])} m ON m.prompt_id = p.message_id
        LEFT JOIN fx_claim_responses r ON r.message_id = m.response_id""",
    "stream_pairs": f"""
        SELECT {scalar('p.data', '$.review_id')} AS review_id, p.message_id AS prompt_id,
               p.publish_time AS prompt_time, r.message_id AS response_id,
               r.publish_time AS response_time, 'pair' AS kind
        FROM fx_prompts p
        JOIN {paired("SELECT json_extract_string(data, '$.review_id') AS review_id, message_id AS id, "
                     "publish_time AS moment FROM fx_prompts",
                     "SELECT json_extract_string(data, '$.review_id') AS review_id, message_id AS id, "
                     "publish_time AS moment FROM fx_late_responses",
                     ['review_id'])} m ON m.prompt_id = p.message_id
        JOIN fx_late_responses r ON r.message_id = m.response_id
        WHERE r.publish_time < (SELECT date_trunc('milliseconds', max(publish_time)) FROM (
          SELECT publish_time FROM fx_prompts UNION ALL SELECT publish_time FROM fx_late_responses))""",
    "raw_prompts_read": f"""
        SELECT message_id, publish_time, {scalar('data', '$.review_id')} AS review_id,
               {scalar('data', '$.prompt')} AS prompt, 'm1' AS model_version,
               CAST(1 AS DOUBLE) AS policy_version, subscription_name, attributes,
               CAST(NULL AS VARCHAR) AS prompt_embedding, CAST(NULL AS VARCHAR) AS review_embedding,
               CAST(NULL AS VARCHAR) AS image_embedding
        FROM fx_prompts""",
    "landing_compacted": """
        SELECT date_trunc('hour', publish_time) AS publish_hour, count(*) AS before,
               sum(refund_amount) AS before_amount, count(*) AS after,
               sum(refund_amount) AS after_amount, 'true' AS fewer_files
        FROM fx_refunds GROUP BY 1""",
    "totals_corrected": "SELECT date_trunc('hour', publish_time) AS publish_hour, "
    "count(*) AS refunds, sum(refund_amount) AS amount FROM fx_refunds GROUP BY ALL",
    "saved_tables": "SELECT id, email, age AS age_before, age + 1 AS age, 'true' AS whole FROM fx_users",
    "temp_tables": """
        SELECT order_id, total FROM (
          SELECT order_id, sum(sale_price) AS total, avg(sum(sale_price)) OVER () AS mean
          FROM fx_order_items GROUP BY order_id) WHERE total > mean""",
    "image_embeddings": f"""
        SELECT {key('page_id')} AS page_id, CAST(1408 AS BIGINT) AS numbers,
               44.0::DOUBLE * list_sum(list_transform(range(1, 33),
                 lambda i: instr('0123456789abcdef', substr(md5(md5(html)), i, 1)) - 1)) / 16 AS total,
               '' AS status
        FROM pages""",
    "image_texts": f"""
        SELECT {key('page_id')} AS page_id, ' Page ' || md5(md5(html)) AS page_text FROM pages""",
    "nearest_vectors": """
        SELECT query_id, CAST(row_number() OVER (
                 PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank,
               id, similarity
        FROM (SELECT q.vec_id AS query_id, v.vec_id AS id,
                     round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]),
                                                  CAST(v.embedding AS DOUBLE[])), 9) AS similarity
              FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10""",
    "nearest_vectors_recall": "SELECT count(*) AS queries, 'true' AS recall_of_nine_tenths "
    "FROM embeddings WHERE vec_id % 100 = 0",
    "refund_outbox": "SELECT product_id, product_name, refund_amount, order_id, email "
    f"FROM ({_decision(False)}) WHERE decision = 'refund'",
    "kmeans_seeds": _kmeans_seeds(),
    "segment_customers_kmeans": _kmeans_segments(),
    "response_originals": _originals(),
    "repaired_answers": """
        SELECT event_id, event_id AS id, event_type AS kind,
               CASE event_id % 8 WHEN 3 THEN 'it''s ' || CAST(event_id AS VARCHAR) || chr(10)
                 WHEN 6 THEN NULL WHEN 7 THEN NULL
                 ELSE 'it''s ' || CAST(event_id AS VARCHAR) END AS note
        FROM events""",
    "answers_kept": "SELECT doc_id, md5(text) AS answer, '' AS status, "
    "(SELECT count(DISTINCT text) FROM documents) AS asked, CAST(0 AS BIGINT) AS asked_again "
    "FROM documents",
    "exchange_summary": """
        SELECT review_id, date_trunc('hour', publish_time) AS publish_hour,
               count(*) FILTER (is_prompt) AS prompts, count(*) FILTER (NOT is_prompt) AS responses,
               min(publish_time) FILTER (is_prompt) AS first_prompt,
               min(publish_time) FILTER (NOT is_prompt) AS first_response
        FROM (SELECT review_id, publish_time, true AS is_prompt FROM cleaned_prompts UNION ALL
              SELECT review_id, publish_time, false FROM cleaned_responses)
        GROUP BY 1, 2""",
    "embedding_similarity": """
        SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
                 (SELECT arg_min(CAST(embedding AS DOUBLE[]), vec_id) FROM embeddings)), 6)
                 AS similarity
        FROM embeddings""",
    "stream_landing": f"""
        SELECT message_id, publish_time, {scalar('data', '$.review_id')} AS review_id,
               {scalar('data', '$.prompt')} AS prompt, CAST(1 AS DOUBLE) AS policy_version
        FROM fx_prompts""",
    "stream_landing_responses": f"""
        SELECT message_id, publish_time, {scalar('data', '$.review_id')} AS review_id,
               json_extract_string(data, '$.response') AS response
        FROM fx_responses""",
    "stream_landing_refund_prompts": """
        SELECT message_id, publish_time, order_id, product_id, user_id, prompt,
               'm1' AS model_version, CAST(1 AS DOUBLE) AS policy_version,
               '[0.25]' AS feedback_embedding, request_image_uri
        FROM fx_claim_prompts""",
    "stream_landing_refund_responses": """
        SELECT message_id, publish_time, order_id, product_id, user_id, response
        FROM fx_claim_responses""",
    "stream_landing_refunds": """
        SELECT message_id, publish_time, product_id, refund_amount, order_id, email
        FROM fx_refunds""",
    "apply_model_local": "SELECT doc_id, md5(text) AS answer, '' AS status FROM documents",
    "apply_model_distinct": "SELECT doc_id, md5(text) AS answer, '' AS status FROM documents",
    "embed_local": "SELECT doc_id, CAST(length(text) AS DOUBLE) AS length FROM documents",
    "text_functions": f"""
        SELECT doc_id, {trim_space('''chr(9) || ' ' || text || ' " ' ''')} AS trimmed,
               trim({trim_space("' \"' || text || '\" '")}, '"') AS unquoted,
               regexp_replace(replace('• ' || text, chr(10), ' '), '[•●]', '', 'g') AS page_text,
               trim(text, 'aeinrst. ') AS trimmed_set,
               nullif(regexp_extract(text, '([0-9]{{3}})', 1), '') AS three_digits,
               {number_text('n_chars / 4.0')} AS quarter
        FROM documents""",
    "uri_functions": f"""
        SELECT uri, {image_key('uri')} AS product_id,
               nullif(regexp_extract(uri, '([0-9]{{3}})\\.png$', 1), '') AS three_digits,
               {literal(IMAGE_ROOT + '/')} || {image_key('uri')} || '_refund_request.png' AS photo
        FROM fx_inventory_images""",
    "time_functions": f"""
        SELECT id, product_id,
               CAST(date_diff('day', CAST(created_at AS DATE), CAST(shipped_at AS DATE)) AS BIGINT)
                 AS days_to_ship,
               date_sub('minute', shipped_at, TIMESTAMP '{AS_OF}') AS minutes_since,
               round(date_sub('minute', shipped_at, TIMESTAMP '{AS_OF}') / 60.0, 2) AS hours_since,
               CASE WHEN created_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY
                         AND TIMESTAMP '{AS_OF}' THEN 'recent' ELSE 'old' END AS age
        FROM fx_order_items""",
    "payload_functions": f"""
        SELECT message_id, {scalar('data', '$.response')} AS response,
               {scalar('data', '$.safety_attributes[0].probability_score')} AS probability,
               CAST(json_extract(data, '$.review_id') AS VARCHAR) AS quoted_id,
               CASE WHEN json_type(data, '$.response') = 'VARCHAR'
                    THEN json_extract_string(data, '$.response') END AS strict_response,
               CASE WHEN json_type(data, '$.safety_attributes[0].severity_score') = 'VARCHAR'
                    THEN json_extract_string(data, '$.safety_attributes[0].severity_score') END
                 AS strict_severity
        FROM fx_responses""",
    "parameterised_query": """
        SELECT p.id AS product_id, i.status, count(*) AS lines, sum(i.sale_price) AS revenue
        FROM fx_order_items i JOIN fx_products p ON i.product_id = p.id
        WHERE i.sale_price < 50 GROUP BY p.id, i.status""",
}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(body) for name, body in BODIES.items()}
