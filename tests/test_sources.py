from __future__ import annotations

import re

from pyspark.sql import functions as F

from voxcart import schemas
from voxcart.plans import local_models as models
from voxcart.plans.build import Inputs, Models, Settings, build_all
from voxcart.plans.standins import AS_OF, DIGITS, NOTICE, PAGE_PATTERN, RANGE, StandIns
from voxcart.sources.files import list_files
from voxcart.sources.tables import read_table, run_query, save_table, temp_table


def test_declared_schema_keeps_ids_and_prunes_columns(spark, tmp_path):
    path = str(tmp_path / "order_items")
    spark.sql(
        "SELECT '007' AS id, '01' AS order_id, '02' AS user_id, '003' AS product_id, "
        "timestamp_ntz'2024-01-01 00:00:00' AS created_at, 5 AS sale_price, 'x' AS unknown"
    ).write.parquet(path)
    df = read_table(spark, path, "order_items")
    assert df.schema == schemas.ORDER_ITEMS
    row = df.first()
    assert (row.id, row.product_id, row.sale_price, row.status) == ("007", "003", 5.0, None)
    plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<id:string>", plan)


def test_every_interface_table_has_a_schema():
    assert set(schemas.TABLES) == {
        "users", "order_items", "products", "raw_reviews", "iso_639_codes"
    }
    assert set(schemas.LANDING) == {
        "reviews_prompts", "reviews_responses", "refunds_prompts", "refunds_responses", "refunds"
    }
    body = schemas.payload_schema(schemas.REFUNDS).fieldNames()
    assert body == ["product_id", "product_name", "refund_amount", "order_id", "email"]


def test_file_listing_reads_no_content_unless_asked(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a001.png", "b.jpg", "sub/c002.png"):
        (tmp_path / name).write_bytes(b"x" * 3)
    df = list_files(spark, str(tmp_path))
    assert sorted(r.uri.rsplit("/", 1)[1] for r in df.select("uri").collect()) == [
        "a001.png", "c002.png"
    ]
    plan = df.select("uri")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert {bytes(r.content) for r in df.collect()} == {b"xxx"}


def test_tables_from_queries(spark):
    df = spark.range(3)
    assert save_table(df, "saved_numbers").count() == 3
    assert save_table(df.where("id > 0"), "saved_numbers").count() == 2
    assert temp_table(df, "numbers").count() == 3
    out = run_query(spark, "SELECT * FROM {t} WHERE id = :wanted", {"t": df}, wanted=2)
    assert [r.id for r in out.collect()] == [2]


def detect(inputs, **options):
    return ['{"full_text_annotation":{"text":"be fair"}}' for _ in inputs]


def translate(inputs, **options):
    return [
        '{"translations":[{"translated_text":"bad shoes","detected_language_code":"de"}]}'
    ] * len(inputs)


def feel(inputs, **options):
    return ['{"document_sentiment":{"score":-0.5,"magnitude":1}}'] * len(inputs)


def test_build_all(spark, folder):
    s = StandIns(spark, folder)
    requests = s.refund_requests.where("order_id < '000000000100'")
    inputs = Inputs(
        s.raw_reviews, s.order_items, s.languages, s.review_images, s.inventory_images,
        s.policy_pages.where("document_id = 3").select("uri"), s.users, s.products, requests,
    )
    settings = Settings(
        *RANGE, AS_OF, NOTICE, DIGITS, PAGE_PATTERN, prefix="built_", product_1="product 7",
        product_2="product 11", image_root="gs://b/uploads",
    )
    embedders = {"text": models.length_vector, "image": models.length_vector}
    providers = Models(
        translate, feel, detect, models.persona, models.resolution, models.echo_digest,
        models.email, models.yes_or_no, embedders,
    )
    built = build_all(inputs, providers, settings)
    assert spark.table("built_cleaned_reviews").count() == s.table("documents").count()
    assert built["customer_personas"].count() == 3
    assert built["complete_service_policy"].first()[0].startswith("be fair")
    assert built["customer_segments"].count() == built["rfm_features"].count()
    expected = spark.table("built_cleaned_reviews").where(F.col("uri").isNotNull())
    resolved = built["review_resolutions"]
    assert 0 < resolved.count() <= expected.count()
    assert {r.parse_status for r in resolved.collect()} == {""}
    asked = built["answered_cases"].count()
    for name in ("prompts", "responses"):
        assert built[f"reviews_{name}"].count() == asked == built[f"cleaned_{name}"].count()
    copies = built["campaign_context"].count()
    assert built["product_descriptions"].count() == copies == built["emails"].count()
    assert built["emails"].where("email_english IS NULL").count() == 0
    refunded = built["refund_decisions"].where("decision = 'refund'").count()
    assert built["refunds"].count() == refunded
    # Run again: landed messages and events stay as they are, tables get a new version.
    again = build_all(inputs, providers, settings)
    assert again["reviews_prompts"].count() == asked and again["refunds"].count() == refunded
