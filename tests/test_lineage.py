from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voxcart import schemas
from voxcart.operators import lineage, outbox
from voxcart.operators.messages import REVIEW_PROMPT, emit, message
from voxcart.plans.standins import StandIns
from voxcart.sources.landing import (
    HOUR,
    decode,
    dedupe,
    read_hourly,
    read_landed,
    with_hour,
    write_hourly,
)
from voxcart.streaming import landing, totals

ENVELOPE = "message_id string, at string, subscription_name string, attributes string, data string"
AS_OF = "2024-01-01 12:00:00"


def envelopes(spark, bodies, at="2024-01-01 10:30:30"):
    rows = [
        (str(i), at, "sub", "{}", b if isinstance(b, (str, type(None))) else json.dumps(b))
        for i, b in enumerate(bodies)
    ]
    df = spark.createDataFrame(rows, ENVELOPE)
    return df.withColumn("publish_time", F.col("at").cast("timestamp")).drop("at")


def test_prompts_with_old_and_published_keys(spark):
    old = {"review_id": "1", "prompt": "\n hi ", "text_embed": "[[1, 2]]", "policy_version": 1.0}
    new = {"review_id": "2", "prompt": "x", "prompt_embedding": "[3]", "review_embedding": "[[4]]"}
    out = lineage.clean_prompts(
        envelopes(spark, [old, new, {"review_id": "3"}, "bad", None, "[1]"]), AS_OF
    )
    assert out.columns == [
        "original_message", "publish_time", "review_id", "prompt", "model_version",
        "policy_version", "subscription_name", "attributes", "hours_since_prompt",
        "prompt_embedding", "review_embedding", "image_embedding",
    ]
    got = out.select("review_id", "prompt", "policy_version", "hours_since_prompt",
                     "prompt_embedding", "review_embedding").orderBy("review_id").collect()
    assert [tuple(r) for r in got] == [
        ("1", "hi", "1.0", 1.48, "[1, 2]", None), ("2", "x", None, 1.48, "[3]", "[4]")
    ]
    assert json.loads(str(out.where("review_id = '1'").first().original_message.toJson())) == old


def test_array_embedding_is_no_scalar(spark):
    body = {"review_id": "1", "text_embed": [[1, 2]]}
    assert lineage.clean_prompts(envelopes(spark, [body]), AS_OF).count() == 0


def test_cleaning_twice_delivered_messages_changes_nothing(spark):
    df = envelopes(spark, [{"review_id": "1", "prompt": "a", "text_embed": "[1]"}] * 2)
    same = df.withColumn("message_id", F.lit("m"))
    assert dedupe(same).count() == 1
    once = lineage.clean_prompts(dedupe(same), AS_OF).drop("original_message").collect()
    assert once == lineage.clean_prompts(dedupe(dedupe(same)), AS_OF).drop("original_message").collect()


def test_responses_and_safety_in_every_encoding(spark):
    rating = [
        {"blocked": i == 1, "probability_score": i / 4, "severity_score": i / 8} for i in range(4)
    ]
    bodies = [
        {"review_id": "list", "response": "r", "safety_attributes": rating, "embedding": "[1]"},
        {"review_id": "text", "response": "r", "safety_attributes": json.dumps(rating),
         "response_embedding": "[1]"},
        {"review_id": "none", "response": ["r"], "embedding": "[1]"},
    ]
    flat = lineage.flatten_safety(lineage.clean_responses(envelopes(spark, bodies), AS_OF))
    assert flat.columns[-5:] == [*lineage.SAFETY_CATEGORIES, "safety_attributes"]
    got = {r.review_id: r for r in flat.collect()}
    for kind in ("list", "text"):
        assert tuple(got[kind].dangerous_content) == (True, 0.25, 0.125)
        assert tuple(got[kind].sexually_explicit) == (False, 0.75, 0.375)
    assert tuple(got["none"].hate_speech) == (None, None, None)
    assert got["none"].response is None


def test_safety_as_plain_text_column(spark):
    df = spark.createDataFrame([("1", '[{"blocked":true}]'), ("2", "bad")],
                               "id string, safety_attributes string")
    got = {r.id: r.hate_speech.blocked for r in lineage.flatten_safety(df).collect()}
    assert got == {"1": True, "2": None}


def test_flat_landing_table(spark):
    body = {"review_id": "1", "prompt": "p", "prompt_embedding": "[[1]]", "policy_version": 2.5}
    flat = decode(envelopes(spark, [body]), schemas.REVIEWS_PROMPTS)
    row = lineage.clean_prompts(flat, AS_OF).first()
    assert (row.review_id, row.policy_version, row.prompt_embedding) == ("1", "2.5", "[1]")


def test_latest_response_gives_one_row_per_prompt(spark):
    prompts = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "review_id string, prompt string")
    responses = spark.createDataFrame(
        [("1", "2024-01-01", "old"), ("1", "2024-01-02", "new"), ("9", "2024-01-01", "x")],
        "review_id string, at string, response string",
    ).withColumn("publish_time", F.col("at").cast("timestamp"))
    out = lineage.with_latest_response(prompts, responses)
    assert sorted((r.prompt, r.response, r.responses) for r in out.collect()) == [
        ("a", "new", 2), ("b", "new", 2), ("c", None, 0)
    ]


def test_message_body_and_emit(spark, tmp_path):
    df = spark.createDataFrame([("1", "p", [1.0])], "review_id string, prompt string, "
                               "prompt_embedding array<double>")
    out = message(df, REVIEW_PROMPT, ("review_id",))
    emit(out, str(tmp_path / "topic"))
    body = json.loads(spark.read.text(str(tmp_path / "topic")).first().value)
    assert list(body) == list(REVIEW_PROMPT)
    assert body["prompt_embedding"] == "[1.0]" and body["model_version"] is None


def test_hourly_table_prunes_and_keeps_every_row(spark, tmp_path):
    hot = [("2024-01-01 05:10:00",)] * 300 + [(f"2024-01-01 {h:02d}:59:59",) for h in range(24)]
    df = spark.createDataFrame(hot, "at string").select(
        F.monotonically_increasing_id().cast("string").alias("message_id"),
        F.col("at").cast("timestamp").alias("publish_time"),
    )
    path = str(tmp_path / "landing")
    write_hourly(df, path)
    assert read_hourly(spark, path).count() == len(hot)
    part = read_hourly(spark, path, datetime(2024, 1, 1, 5, 30), datetime(2024, 1, 1, 7))
    assert part.count() == 2
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert HOUR in plan.split("PartitionFilters: [")[1].split("]")[0]


def stream_of(spark, tmp_path, df):
    source = str(tmp_path / "topic")
    df.coalesce(1).write.mode("append").json(source)
    return source, df.schema


def test_stream_lands_each_message_once_in_its_hour(spark, tmp_path):
    first = envelopes(spark, [{"review_id": "1", "prompt": "p"}, {"review_id": "2"}])
    later = envelopes(spark, [{"review_id": "3"}], "2024-01-01 11:00:00").withColumn(
        "message_id", F.lit("later")
    )
    source, schema = stream_of(spark, tmp_path, first.unionByName(first).unionByName(later))
    target, state = str(tmp_path / "table"), str(tmp_path / "state")

    def run():
        messages = landing.message_stream(spark, schema, source)
        landing.land_messages(
            messages, schemas.REVIEWS_PROMPTS, target, state
        ).awaitTermination()
        return read_landed(spark, target, schemas.REVIEWS_PROMPTS)

    assert sorted(r.message_id for r in run().collect()) == ["0", "1", "later"]
    hour = read_landed(
        spark, target, schemas.REVIEWS_PROMPTS, datetime(2024, 1, 1, 11), datetime(2024, 1, 1, 12)
    )
    assert [r.message_id for r in hour.collect()] == ["later"]
    # A replay after a restart is recognised from the table.
    stream_of(spark, tmp_path, first)
    assert sorted(r.message_id for r in run().collect()) == ["0", "1", "later"]
    # A first delivery lands however old its publish time is.
    late = envelopes(spark, [{"review_id": "9"}], "2023-06-01 10:00:00").withColumn(
        "message_id", F.lit("late")
    )
    stream_of(spark, tmp_path, late.unionByName(late))
    assert sorted(r.message_id for r in run().collect()) == ["0", "1", "late", "later"]


def test_a_hot_hour_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(200_000).select(
        F.col("id").cast("string").alias("message_id"),
        F.timestamp_seconds(F.lit(1_704_100_000) + F.col("id") % 60).alias("publish_time"),
        F.sha2(F.col("id").cast("string"), 256).alias("body"),
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "1m")
    try:
        write_hourly(df, str(tmp_path / "landing"))
    finally:
        spark.conf.unset(size)
    (hour,) = (tmp_path / "landing").glob(f"{HOUR}=*")
    assert len(list(hour.glob("*.parquet"))) > 2


def test_batch_and_stream_totals_agree(spark, folder, tmp_path):
    s = StandIns(spark, folder)
    refunds = decode(s.refund_messages, schemas.REFUNDS)
    batch = {r.publish_hour: (r.refunds, r.amount) for r in totals.hourly_refunds(refunds).collect()}
    source, schema = stream_of(spark, tmp_path, s.refund_messages)
    stream = decode(landing.message_stream(spark, schema, source), schemas.REFUNDS)
    query = (
        totals.hourly_refunds(stream, "31 days").writeStream.outputMode("complete")
        .format("memory").queryName("hourly").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {r.publish_hour: (r.refunds, r.amount) for r in spark.table("hourly").collect()} == batch


def test_totals_of_an_out_of_order_stream_and_late_rows(spark, tmp_path):
    """Changed days alone are written again; a row behind the watermark comes from the landing."""

    def refund(number, at, amount):
        body = {"product_id": "1", "refund_amount": amount, "order_id": str(number)}
        return envelopes(spark, [body], at).withColumn("message_id", F.lit(str(number)))

    days = [refund(1, "2024-01-03 10:30:00", 1.0), refund(2, "2024-01-03 09:10:00", 2.0),
            refund(3, "2024-01-03 10:00:00", 4.0), refund(4, "2024-01-01 08:00:00", 8.0)]
    state, target, landed = (str(tmp_path / n) for n in ("state", "totals", "landed"))
    source = str(tmp_path / "topic")
    numbers = []
    for df in days:
        df.coalesce(1).write.mode("append").json(source)
        messages = landing.message_stream(spark, df.schema, source)
        totals.publish_totals(
            totals.hourly_refunds(decode(messages, schemas.REFUNDS), "2 hours"), target, state
        ).awaitTermination()
        landing.land_messages(messages, schemas.REFUNDS, landed, f"{state}-landed").awaitTermination()
        numbers.append(totals.totals_table(spark, target).log.state().number)

    def got():
        return {str(r.publish_hour): (r.refunds, r.amount)
                for r in totals.totals_table(spark, target).read().collect()}

    on_time = {"2024-01-03 10:00:00": (2, 5.0), "2024-01-03 09:00:00": (1, 2.0)}
    assert got() == on_time
    seen = totals.correct_totals(spark, landed, schemas.REFUNDS, target)
    assert got() == {**on_time, "2024-01-01 08:00:00": (1, 8.0)}
    before = totals.totals_table(spark, target).log.state().number
    assert totals.correct_totals(spark, landed, schemas.REFUNDS, target, seen) == seen
    assert totals.totals_table(spark, target).log.state().number == before
    old = totals.totals_table(spark, target).read(number=numbers[0]).collect()
    assert [r.amount for r in old] == [1.0]


def test_usage_and_exchange_streams(spark, tmp_path):
    bodies = [{"review_id": "1", "prompt": "p", "model_version": "m", "text_embed": "[1]",
               "embedding": "[1]", "response": "r"}] * 3
    source, schema = stream_of(spark, tmp_path, envelopes(spark, bodies))
    messages = landing.message_stream(spark, schema, source)
    prompts = lineage.clean_prompts(messages, AS_OF)
    responses = lineage.clean_responses(messages, AS_OF)
    for name, df in (
        ("usage", totals.hourly_usage_stream(prompts)),
        ("exchange", totals.exchange_summary(prompts, responses)),
    ):
        query = (df.writeStream.outputMode("complete").format("memory").queryName(name)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    assert tuple(spark.table("usage").first())[1:] == ("m", 3)
    assert tuple(spark.table("exchange").first())[2:4] == (3, 3)


def test_refund_stream_writes_each_batch_once(spark, tmp_path):
    requests = spark.createDataFrame([("o1",), ("o2",)], "order_id string")
    source, schema = stream_of(spark, tmp_path, requests)
    stream = landing.message_stream(spark, schema, source)
    out = str(tmp_path / "events")
    query = totals.decide_refund_stream(
        stream, lambda batch: batch.select(F.lit(None).alias("key"), F.col("order_id").alias("value")),
        out, str(tmp_path / "state"),
    )
    query.awaitTermination()
    assert sorted(r.value for r in outbox.outbox(spark, out).read().collect()) == ["o1", "o2"]


def test_hour_column(spark):
    df = spark.createDataFrame([("2024-01-01 10:59:59",)], "at string").select(
        F.col("at").cast("timestamp").alias("publish_time")
    )
    assert with_hour(df).first()[HOUR] == datetime(2024, 1, 1, 10)
