"""Hot keys: what keeps a key with a third of all rows from loading one task."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from voxcart.operators import cases, customers, lineage, pairing, refunds, reviews
from voxcart.sources.landing import dedupe


@pytest.fixture
def forced_skew(spark):
    """Shuffle joins only, and partitions so small that the hot key counts as skewed."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
    }
    before = {key: spark.conf.get(key, None) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df) -> str:
    df._jdf.queryExecution().executedPlan().execute().count()
    return df._jdf.queryExecution().executedPlan().toString()


def hot(column, rows_per_key=3):
    """A key that holds a third of all rows."""
    return F.when(F.col("id") % rows_per_key == 0, "hot").otherwise(column.cast("string"))


@pytest.mark.parametrize("hot_user", ["u0", None])
def test_review_join_splits_the_hot_order_line(spark, forced_skew, hot_user):
    """A third of the reviews are of one order line, or of no known user."""
    rows = spark.range(0, 30000, 1, 16)
    is_hot = F.col("id") % 3 == 0
    review_df = rows.select(
        F.col("id").cast("string").alias("review_id"),
        hot(F.col("id")).alias("order_id"),
        F.when(is_hot, hot_user).otherwise(F.concat(F.lit("u"), F.col("id") % 7)).alias("user_id"),
        F.concat(F.lit("p"), F.when(is_hot, 0).otherwise(F.col("id") % 5)).alias("product_id"),
        F.lit("n").alias("name"),
        F.lit("5").alias("review_rating"),
        F.sha2(F.col("id").cast("string"), 256).alias("review_text"),
    )
    lines = rows.select(
        hot(F.col("id")).alias("id"),
        F.concat(F.lit("u"), F.when(is_hot, 0).otherwise(F.col("id") % 7)).alias("user_id"),
        F.concat(F.lit("p"), F.when(is_hot, 0).otherwise(F.col("id") % 5)).alias("product_id"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    images = spark.createDataFrame([("gs://b/001.png",)], "uri string")
    df = reviews.latest_review_snapshot(review_df, lines, images)
    assert re.search(r"skew=true", final_plan(df))
    assert df.count() == 30000


def test_copies_shrink_before_the_shuffle(spark):
    copies = spark.range(0, 9000, 1, 4).select(
        hot(F.col("id")).alias("review_id"), F.lit("o").alias("order_id"),
        F.lit("u").alias("user_id"), F.lit("p").alias("product_id"), F.lit("n").alias("name"),
        F.lit("5").alias("review_rating"), F.lit("t").alias("review_text"),
    )
    lines = spark.createDataFrame([], "id string, user_id string, product_id string, created_at timestamp")
    images = spark.createDataFrame([], "uri string")
    df = reviews.latest_review_snapshot(copies, lines, images)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(review_id.*\n.*WindowGroupLimit.*Partial", plan)
    assert df.count() == 6001


def test_case_join_splits_the_hot_product(spark, forced_skew):
    df = spark.range(0, 30000, 1, 16).select(
        F.col("id").cast("string").alias("review_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("review_text"),
        F.lit("English").alias("review_language"), F.lit("gs://b/r.png").alias("uri"),
        F.when(F.col("id") % 3 == 0, "000").otherwise(
            F.lpad((F.col("id") % 999 + 1).cast("string"), 3, "0")).alias("product_id"),
    )
    images = spark.range(0, 1000, 1, 4).select(
        F.concat(F.lit("gs://b/"), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit(".png")).alias("uri")
    )
    policy = spark.createDataFrame([(1.0, "x")], "version_number double, service_policy_text string")
    out = cases.review_case_inputs(df, images, policy)
    assert re.search(r"skew=true", final_plan(out))
    assert out.count() == 30000


def test_pairing_splits_the_hot_review(spark, forced_skew):
    messages = spark.range(0, 30000, 1, 16).select(
        hot(F.col("id")).alias("review_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("prompt"),
        F.col("id").cast("string").alias("response"),
        F.timestamp_seconds("id").alias("publish_time"),
    )
    df = lineage.with_latest_response(messages.drop("response"), messages)
    assert re.search(r"skew=true", final_plan(df))
    assert df.count() == 30000
    assert df.where("review_id = 'hot'").first().response == "29997"


def test_eligibility_splits_the_hot_user(spark, forced_skew):
    rows = spark.range(0, 30000, 1, 16)
    lines = rows.select(
        F.col("id").cast("string").alias("order_id"), F.lit("001").alias("product_id"),
        hot(F.col("id") % 3000).alias("user_id"), F.lit(1.0).alias("sale_price"),
        F.lit("2024-06-29").cast("timestamp").alias("created_at"),
        F.lit("2024-06-29").cast("timestamp").alias("shipped_at"),
    )
    people = rows.select(hot(F.col("id") % 3000).alias("id")).distinct().withColumn(
        "email", F.concat("id", F.lit("@x")))
    requests = lines.select(F.concat("user_id", F.lit("@x")).alias("email"), "order_id",
                            "product_id", F.sha2("order_id", 512).alias("review_text"))
    df = refunds.refund_eligibility(
        requests, lines, spark.createDataFrame([("gs://b/001.png",)], "uri string"),
        spark.createDataFrame([("001", "shirt")], "id string, name string"), people,
        spark.createDataFrame([(1.0, "x")], "version_number double, service_policy_text string"),
        "2024-06-30",
    )
    assert len(re.findall(r"skew=true", final_plan(df))) >= 2
    assert df.count() == 30000
    assert df.where("eligible = 'False'").select("user_id").distinct().count() == 1


def test_distinct_orders_are_counted_in_two_steps(spark):
    items = spark.range(0, 9000, 1, 4).select(
        hot(F.col("id")).alias("user_id"), (F.col("id") % 700).cast("string").alias("order_id"),
        F.lit(1.0).alias("sale_price"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    features = customers.rfm_features(items, "2024-01-01", "2024-01-02", "2024-01-03")
    counts = refunds.recent_order_counts(items, F.lit("2024-01-02").cast("timestamp"))
    for df in (features, counts):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # First by user and order, then by user with counts added up on the map side.
        assert len(re.findall(r"Exchange hashpartitioning\(\S+, order_id#\d+, \d+\)", plan)) == 1
        assert "partial_count(distinct order_id" in plan
    assert features.where("user_id = 'hot'").first().count_orders == 700


def test_dedupe_combines_copies_on_the_map_side(spark):
    df = spark.range(0, 9000, 1, 4).select(
        hot(F.col("id")).alias("message_id"), F.lit("2024-01-01").cast("timestamp").alias("publish_time"),
        F.col("id").alias("body"),
    )
    out = dedupe(df)
    assert "partial_min_by" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 6001
    assert out.where("message_id = 'hot'").first().body == 0


def test_pairing_in_order_uses_a_task_per_stretch_of_a_hot_key(spark):
    events = spark.range(0, 40_000, 1, 8).select(
        F.lit("hot").alias("review_id"), F.col("id").cast("string").alias("response"),
        F.timestamp_seconds(F.col("id") * 10).alias("publish_time"),
    )
    out = pairing.pair_in_order(events.drop("response"), events)
    assert out.where("response IS NULL OR response_time != publish_time").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(key#\d+, stretch#\d+", plan)
