from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxcart.operators import documents

NOTICE = "Internal Only For use by staff"


def pages(spark, rows):
    data = [(d, f"gs://b/Policy_Page_{n:02d}.png", t) for d, n, t in rows]
    return spark.createDataFrame(data, "doc string, uri string, page_text string")


def test_order_covers_and_version(spark):
    df = pages(spark, [("a", 10, "ten"), ("a", 3, "three"), ("a", 2, "cover"), ("a", 4, None)])
    out = documents.assemble_document(df, NOTICE)
    assert [tuple(r) for r in out.collect()] == [("three ten", 1.0)]


def test_no_pages_give_one_empty_text(spark):
    df = pages(spark, [("a", 1, "cover")])
    assert documents.assemble_document(df, NOTICE).first()[0] == ""
    assert documents.assemble_document(df.where("false"), NOTICE).first()[0] == ""
    assert documents.assemble_document(df, NOTICE, keys=["doc"]).first()[1] == ""


def test_notice_as_phrase_and_as_characters(spark):
    df = pages(spark, [("a", 3, f"{NOTICE} refunds\n• within 30 days {NOTICE}")])
    phrase = documents.assemble_document(df, NOTICE).first()[0]
    characters = documents.assemble_document(df, NOTICE, mode="characters").first()[0]
    assert phrase == "refunds  within 30 days"
    assert characters == phrase.strip(NOTICE) != phrase
    with pytest.raises(ValueError):
        documents.assemble_document(df, NOTICE, mode="other")


def test_parts_hold_the_whole_document(spark):
    df = pages(spark, [("a", n, f"p{n}") for n in range(1, 30)])
    whole = documents.assemble_document(df, NOTICE, keys=["doc"]).first()[1]
    parts = documents.assemble_document(df, NOTICE, keys=["doc"], pages_per_part=4)
    texts = [r.service_policy_text for r in parts.orderBy("part_number").collect()]
    assert len(texts) > 5 and " ".join(texts) == whole


def test_reading_pages_with_a_model(spark):
    images = spark.createDataFrame([("gs://b/Policy_Page_03.png",)], "uri string")

    def detect(inputs, vision_features, **options):
        assert vision_features == ["DOCUMENT_TEXT_DETECTION"]
        return ['{"full_text_annotation":{"text":"• read"}}' for _ in inputs]

    out = documents.assemble_document(documents.read_pages(images, detect), NOTICE)
    assert out.first()[0] == "read"


def test_latest_version_keeps_ties(spark):
    policy = spark.createDataFrame(
        [(1.0, "old"), (2.0, "new"), (2.0, "newer"), (None, "none")],
        "version_number double, service_policy_text string",
    )
    df = spark.createDataFrame([("r1",), ("r2",)], "review_id string")
    out = documents.attach_latest_policy(df, policy)
    assert sorted((r.review_id, r.service_policy_text, r.policy_version) for r in out.collect()) == [
        ("r1", "new", 2.0), ("r1", "newer", 2.0), ("r2", "new", 2.0), ("r2", "newer", 2.0)
    ]
    assert documents.attach_latest_policy(df, policy.where(F.lit(False))).count() == 0


def test_pages_of_any_number_are_kept(spark):
    df = pages(spark, [("a", n, f"t{n}") for n in (101, 3, 100, 99)])
    assert documents.assemble_document(df, NOTICE).first()[0] == "t3 t99 t100 t101"
