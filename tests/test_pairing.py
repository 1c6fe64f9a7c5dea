"""Prompts and their responses, in a batch and in streams, against a queue."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voxcart.operators import pairing
from voxcart.streaming import pairing as streams

START = datetime(2024, 1, 1)


def queue(prompts, responses):
    """Prompt id -> response id; rows are ``(key, seconds, id)``."""
    events = [(t, 0, i, k) for k, t, i in prompts] + [(t, 1, i, k) for k, t, i in responses]
    waiting, pairs = {}, {}
    for t, kind, name, key in sorted(events):
        if kind == 0:
            waiting.setdefault(key, []).append(name)
        elif waiting.get(key):
            pairs[waiting[key].pop(0)] = name
    return pairs


def frame(spark, rows, body):
    data = [(k, None if t is None else START + timedelta(seconds=t), i, f"{body} {i}") for k, t, i in rows]
    return spark.createDataFrame(
        data, f"review_id string, publish_time timestamp, message_id string, {body} string"
    )


@pytest.mark.parametrize("stretch", ["30 seconds", "1 hour", "100 days"])
def test_batch_against_a_queue(spark, stretch):
    rng = random.Random(4)
    prompts, responses = (
        [(rng.choice("aaab"), rng.randrange(400), f"{side}{i:03d}") for i in range(150)]
        for side in "pr"
    )
    out = pairing.pair_in_order(
        frame(spark, prompts, "prompt"), frame(spark, responses, "response"),
        prompt_tie=("message_id",), response_tie=("message_id",), stretch=stretch,
    )
    assert out.columns == ["review_id", "publish_time", "message_id", "prompt", "response_time", "response"]
    got = {r.message_id: r.response and r.response.split()[1] for r in out.collect()}
    expected = queue(prompts, responses)
    assert got == {i: expected.get(i) for _, _, i in prompts}


def test_nulls_ties_and_empty_sides(spark):
    prompts = [(None, 1, "p0"), ("a", None, "p1"), ("a", 5, "p2"), ("a", 5, "p3"), ("z", 1, "p4")]
    responses = [(None, 2, "r0"), ("a", 4, "early"), ("a", None, "r1"), ("a", 5, "r2"), ("a", 9, "r3")]
    out = pairing.pair_in_order(
        frame(spark, prompts, "prompt"), frame(spark, responses, "response"),
        prompt_tie=("message_id",), response_tie=("message_id",),
    )
    got = {r.message_id: r.response for r in out.collect()}
    assert got == {"p0": None, "p1": None, "p2": "response r2", "p3": "response r3", "p4": None}
    none = frame(spark, [], "response")
    assert {r.response for r in pairing.pair_in_order(frame(spark, prompts, "prompt"), none).collect()} == {None}
    assert pairing.pair_in_order(frame(spark, [], "prompt"), none).count() == 0


def test_keys_of_several_columns(spark):
    def rows(*r):
        df = spark.createDataFrame(list(r), "order_id string, product_id string, at int, response string")
        return df.withColumn("publish_time", F.timestamp_seconds("at"))

    prompts = rows(("o", "p", 1, None), ("o", "q", 1, None)).drop("response")
    responses = rows(("o", "q", 2, "for q"), ("o", "x", 2, "nobody's"))
    out = pairing.pair_in_order(prompts, responses, keys=("order_id", "product_id"))
    assert {r.product_id: r.response for r in out.collect()} == {"p": None, "q": "for q"}


def run_stream(spark, tmp_path, steps, delay, timeout):
    """Each step's rows arrive as one micro-batch; the two tables at the end."""
    prompts, responses = (str(tmp_path / n) for n in ("prompts", "responses"))
    schemas = {
        "prompt": frame(spark, [("k", 0, "x")], "prompt").schema,
        "response": frame(spark, [("k", 0, "x")], "response").schema,
    }
    state_rows = []
    for asked, given in steps:
        frame(spark, asked, "prompt").coalesce(1).write.mode("append").parquet(prompts)
        frame(spark, given, "response").coalesce(1).write.mode("append").parquet(responses)
        pairs = streams.pair_stream(
            spark.readStream.schema(schemas["prompt"]).parquet(prompts),
            spark.readStream.schema(schemas["response"]).parquet(responses),
            delay=delay, timeout=timeout,
        )
        query = streams.keep_pairs(pairs, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        state_rows.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    done, late = (t.read().collect() for t in streams.exchange_tables(spark, str(tmp_path / "out")))
    return done, late, state_rows


def test_stream_out_of_order_timeouts_and_late_rows(spark, tmp_path):
    steps = [
        # A response before its prompt, and one that no prompt waits for.
        ([("a", 100, "p2")], [("a", 110, "r1"), ("a", 90, "r0")]),
        ([("a", 95, "p1")], [("b", 105, "orphan")]),
        # The watermark comes to 200 - 20: p1 takes r1; p2 waits.
        ([("c", 200, "p3")], []),
        # Now to 580: p2 and p3 have waited longer than 300 seconds or not yet.
        ([], [("d", 600, "later")]),
        # Late rows are no longer put in order.
        ([("a", 99, "late prompt")], [("c", 300, "late response"), ("d", 2000, "end")]),
        ([], [("d", 2001, "end 2")]),
    ]
    done, late, state_rows = run_stream(spark, tmp_path, steps, "20 seconds", "300 seconds")
    got = {r.id: (r.kind, r.response_id) for r in done}
    assert got == {
        "p1": ("pair", "r1"), "p2": ("unanswered", None), "p3": ("unanswered", None)
    }
    assert sorted(r.id for r in late) == ["late prompt", "late response"]
    assert all(r.body for r in late)
    # After time-out nothing of a, b and c is left.
    assert state_rows[-1] < max(state_rows)


def test_stream_is_the_queue_and_restarts_count_once(spark, tmp_path):
    rng = random.Random(6)
    prompts, responses = (
        [(rng.choice("ab"), t, f"{side}{t:04d}") for t in range(start, 300, 7)]
        for side, start in (("p", 0), ("r", 3))
    )
    steps = []
    for low in range(0, 300, 100):
        chosen = [[r for r in rows if low <= r[1] < low + 100] for rows in (prompts, responses)]
        for part in chosen:
            rng.shuffle(part)
        steps.append(tuple(chosen))
    steps.append(([("z", 1000, "end")], []))
    done, late, _ = run_stream(spark, tmp_path, steps, "0 seconds", "1 day")
    assert not late
    assert {r.id: r.response_id for r in done} == queue(prompts, responses)


def test_rows_are_shuffled_once_per_turn(spark):
    """Prompts and responses of a turn meet in one shuffle of rows, without a second pass."""
    asked, given = frame(spark, [("a", 1, "p")], "prompt"), frame(spark, [("a", 2, "r")], "response")
    out = pairing.pair_in_order(asked, given)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(key#\d+, turn#", plan)) == 1
    assert [r.response for r in out.collect()] == ["response r"]
