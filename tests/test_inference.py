from __future__ import annotations

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from voxcart.operators.inference import (
    RATING,
    RESULT,
    STATUS,
    AnswerStore,
    CallControl,
    apply_model,
    embed,
)
from voxcart.session import checkpoint_root


def logged(path):
    """A provider that writes one line per input it is asked."""

    def provider(inputs, **options):
        with open(path, "a") as log:
            log.writelines(f"{text}\n" for text in inputs)
        return [f"{text}/{options.get('suffix', '')}" for text in inputs]

    return provider


def lines(path):
    return open(path).read().split()


def frame(spark, texts, partitions=1):
    rows = list(enumerate(texts))
    return spark.createDataFrame(rows, "id int, prompt string").repartition(partitions)


def test_answers_status_and_options(spark, tmp_path):
    log = tmp_path / "calls"
    out = apply_model(frame(spark, ["a", None, "b"]), "prompt", logged(log), suffix="z")
    assert out.columns == ["id", "prompt", RESULT, RATING, STATUS]
    assert sorted(tuple(r)[1:] for r in out.where("prompt IS NOT NULL").collect()) == [
        ("a", "a/z", None, ""), ("b", "b/z", None, "")
    ]
    assert [tuple(r)[2:] for r in out.where("prompt IS NULL").collect()] == [
        (None, None, "null_input")
    ]


def jobs(spark):
    return set(spark.sparkContext.statusTracker().getJobIdsForGroup())


def test_building_a_plan_asks_nothing(spark, tmp_path):
    log = tmp_path / "calls"
    before = jobs(spark)
    out = apply_model(frame(spark, ["a", "b"]), "prompt", logged(log))
    apply_model(out, "prompt", logged(log), result_col="x", rating_col=None, status_col=None, distinct=True)
    embed(out, {"v": ("prompt", lambda i, **o: [[1.0]] * len(i))})
    assert jobs(spark) == before and not log.exists()


def test_only_the_input_goes_to_python(spark):
    df = spark.range(10).select("id", F.lit("text").alias("prompt"), F.lit("long policy").alias("policy"))
    out = apply_model(df, "prompt", lambda i, **o: i)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "policy" not in re.search(r"ArrowEvalPython \[run\((.*?)\)", plan)[1]


def test_a_store_asks_once_for_all_consumers_and_runs(spark, tmp_path):
    log, store = tmp_path / "calls", AnswerStore(spark, str(tmp_path / "store"), "m1")
    df = frame(spark, [f"p{i}" for i in range(50)] + [None, "p1"], 4)
    control = CallControl.counting(spark)
    assert store.ask(df, "prompt", logged(log), control=control, batch_size=5) == 50
    out = apply_model(df, "prompt", logged(log), store=store)
    assert out.columns == ["id", "prompt", RESULT, RATING, STATUS]
    assert out.count() == 52 and out.where(f"{RESULT} = 'p1/'").count() == 2
    assert out.where(f"{STATUS} = 'null_input'").count() == 1
    assert control.counts["inputs"].value == 50
    # A second run makes no call; other options and another model are other questions.
    again = CallControl.counting(spark)
    assert store.ask(df, "prompt", logged(log), control=again) == 0
    assert again.counts["calls"].value == 0 and len(lines(log)) == 50
    more = frame(spark, ["p1", "new"])
    assert store.apply(more, "prompt", logged(log)).where(f"{STATUS} = ''").count() == 2
    assert lines(log)[50:] == ["new"]
    assert store.attach(more, "prompt", suffix="z").where(f"{STATUS} = 'not_asked'").count() == 2
    assert AnswerStore(spark, store.path, "m2").ask(more, "prompt", logged(log)) == 2


def test_failed_calls_are_asked_again(spark, tmp_path):
    switch, store = tmp_path / "down", AnswerStore(spark, str(tmp_path / "store"))

    def provider(inputs, **options):
        if switch.exists():
            raise RuntimeError("down")
        return inputs

    switch.touch()
    df = frame(spark, ["a", "b"])
    first = store.apply(df, "prompt", provider).collect()
    assert {r[STATUS] for r in first} == {"RuntimeError: down"}
    switch.unlink()
    assert {r[RESULT] for r in store.apply(df, "prompt", provider).collect()} == {"a", "b"}


def test_a_lost_task_repeats_at_most_one_batch(spark, tmp_path):
    """The task fails inside its fourth call; the next run finds the batches before it."""
    log, store = tmp_path / "calls", AnswerStore(spark, str(tmp_path / "store"))

    def provider(inputs, **options):
        with open(log, "a") as file:
            file.writelines(f"{text}\n" for text in inputs)
        if len(lines(log)) == 8:
            os._exit(1)
        return inputs

    df = frame(spark, [f"p{i}" for i in range(20)])
    try:
        store.ask(df, "prompt", provider, batch_size=2, parallelism=1)
    except Exception:
        pass
    store.ask(df, "prompt", provider, batch_size=2, parallelism=1)
    asked = lines(log)
    assert len(set(asked)) == 20 and len(asked) <= 22
    assert store.attach(df, "prompt").where(f"{STATUS} = ''").count() == 20


def test_time_limit_retries_and_counters(spark):
    def slow(inputs, **options):
        time.sleep(0.0 if inputs == ["a"] else 5)
        return inputs

    control = CallControl.counting(spark, timeout=0.5, retries=1, backoff=0.01)
    got = apply_model(frame(spark, ["a", "b"]), "prompt", slow, batch_size=1, control=control).collect()
    by_input = {r.prompt: r[STATUS] for r in got}
    assert by_input["a"] == "" and by_input["b"].startswith("TimeoutError")
    counted = {n: a.value for n, a in control.counts.items()}
    # b: two tries of its batch, and two by itself.
    assert counted == {"calls": 5, "inputs": 5, "retries": 2, "timeouts": 4}


def test_distinct_asks_a_repeated_input_once(spark, tmp_path):
    log = tmp_path / "calls"
    df = frame(spark, ["a"] * 30 + ["b", None], 4)
    out = apply_model(df, "prompt", logged(log), distinct=True)
    assert out.columns == ["id", "prompt", RESULT, RATING, STATUS]
    rows = out.collect()
    assert len(rows) == 32
    assert sorted(lines(log)) == ["a", "b"]
    assert [r[STATUS] for r in rows].count("null_input") == 1


def test_one_bad_input_fails_alone(spark):
    def provider(inputs, **options):
        if "bad" in inputs:
            raise ValueError("cannot read")
        return [(text, "[]") for text in inputs]

    out = apply_model(frame(spark, ["a", "bad", "c"]), "prompt", provider)
    got = {r.prompt: (r[RESULT], r[RATING], r[STATUS]) for r in out.collect()}
    assert got == {
        "a": ("a", "[]", ""),
        "bad": (None, None, "ValueError: cannot read"),
        "c": ("c", "[]", ""),
    }


def test_wrong_number_of_answers_is_an_error_status(spark):
    out = apply_model(frame(spark, ["a"]), "prompt", lambda inputs, **o: [])
    assert out.first()[STATUS].startswith("IndexError")


def test_other_columns_pass_through(spark):
    df = spark.sql(
        "SELECT 9007199254740993L AS n, cast(NULL AS bigint) AS m, 'x' AS t, "
        "timestamp'2024-01-01 00:00:00' AS ts, named_struct('a', array(1)) AS s, "
        "cast(1.10 AS decimal(5,2)) AS d"
    )
    out = apply_model(df, "t", lambda inputs, **o: inputs)
    assert out.select(df.columns).collect() == df.collect()
    assert out.select(df.columns).schema.simpleString() == df.schema.simpleString()


def test_embed_two_columns_in_one_pass(spark):
    def size(inputs, **options):
        return [[float(len(text))] for text in inputs]

    df = spark.createDataFrame([("ab", None)], "a string, b string")
    out = embed(df, {"x": ("a", size), "y": ("b", size)})
    assert tuple(out.first()) == ("ab", None, [2.0], None)
    assert "array<double>" in out.schema["x"].dataType.simpleString()


def test_parallelism_bounds_the_callers(spark):
    def worker(inputs, **options):
        return [str(os.getpid())] * len(inputs)

    out = apply_model(frame(spark, map(str, range(64)), 8), "prompt", worker, parallelism=2)
    assert out.rdd.getNumPartitions() == 2


def test_checkpoints_go_to_the_configured_folder(spark):
    root = checkpoint_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    assert spark.sparkContext.getCheckpointDir() is not None


@pytest.mark.parametrize("batch_size, calls", [(1, 5), (2, 3), (64, 1)])
def test_batch_size(spark, tmp_path, batch_size, calls):
    log = tmp_path / "calls"

    def provider(inputs, **options):
        with open(log, "a") as file:
            file.write("call\n")
        return inputs

    apply_model(frame(spark, list("abcde")), "prompt", provider, batch_size=batch_size).collect()
    assert len(lines(log)) == calls
