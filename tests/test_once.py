"""Tables that take a row once, versions and merges: crashes, races, readers, compaction."""

from __future__ import annotations

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxcart import schemas
from voxcart.sources import once
from voxcart.sources.commits import CommitLog, Conflict
from voxcart.sources.landing import landing_table, read_landed
from voxcart.sources.tables import expire_versions, open_table, save_table, temp_table
from voxcart.sources.versions import MergedTable, VersionedTable
from voxcart.streaming import landing

COLUMNS = "message_id string, at string, product_id string, refund_amount double, order_id string"


def refunds(spark, rows):
    """Flat refund rows from ``(id, time, order)``."""
    df = spark.createDataFrame([(i, at, "p", 1.0, o) for i, at, o in rows], COLUMNS)
    df = df.withColumn("publish_time", F.col("at").cast("timestamp"))
    return df.select(
        *(
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.REFUNDS
        )
    )


def table(spark, path):
    return landing_table(spark, str(path), schemas.REFUNDS)


def got(df):
    return sorted(((r.message_id, r.order_id) for r in df.collect()), key=repr)


ROWS = [
    ("m1", "2024-01-01 10:00:00", "a"),
    ("m1", "2024-01-01 10:59:00", "later copy"),
    ("m1", "2024-01-01 11:00:00", "other hour"),
    (None, "2024-01-01 10:00:00", "no id 1"),
    (None, "2024-01-01 10:00:00", "no id 2"),
    (None, "2024-01-01 10:00:00", "no id 2"),
    ("m2", None, "no time"),
    (None, None, "nothing"),
]
LANDED = [("m1", "a"), ("m1", "other hour"), ("m2", "no time"), (None, "no id 1"),
          (None, "no id 2"), (None, "nothing")]


def test_null_ids_and_times_are_kept_and_landed_once(spark, tmp_path):
    t = table(spark, tmp_path)
    order = [F.col("publish_time")]
    for _ in range(2):
        t.admit(refunds(spark, ROWS), order=order)
        assert got(t.read()) == sorted(LANDED, key=repr)
    assert t.admit(refunds(spark, [])).number == 3
    assert got(t.read()) == sorted(LANDED, key=repr)


def test_a_crash_between_write_and_commit_leaves_no_copy_and_no_loss(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.admit(refunds(spark, ROWS[:1]), "s", 0)

    def crash(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", crash)
        with pytest.raises(RuntimeError):
            t.admit(refunds(spark, ROWS[2:4]), "s", 1)
    assert got(t.read()) == [("m1", "a")]
    t.admit(refunds(spark, ROWS[2:4]), "s", 1)
    expected = sorted([("m1", "a"), ("m1", "other hour"), (None, "no id 1")], key=repr)
    assert got(t.read()) == expected
    # A batch that was committed is not run again, even with other rows.
    t.admit(refunds(spark, ROWS[4:5]), "s", 1)
    assert got(t.read()) == expected
    assert len(t.vacuum(older_than=0.0)) == 2  # rows and filters of the lost attempt: rows only
    assert got(t.read()) == expected


def test_a_stream_that_dies_before_its_commit_goes_on(spark, tmp_path, monkeypatch):
    body = '{"product_id": "p", "order_id": "%s"}'
    df = spark.createDataFrame(
        [(str(i), "2024-01-01 10:00:00", "s", "{}", body % i) for i in range(5)],
        "message_id string, publish_time string, subscription_name string, attributes string, data string",
    ).withColumn("publish_time", F.col("publish_time").cast("timestamp"))
    df.coalesce(1).write.json(str(tmp_path / "topic"))
    path, state = str(tmp_path / "table"), str(tmp_path / "state")

    def run():
        messages = landing.message_stream(spark, df.schema, str(tmp_path / "topic"))
        landing.land_messages(messages, schemas.REFUNDS, path, state).awaitTermination()

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", lambda *a, **k: 1 / 0)
        with pytest.raises(Exception, match="division"):
            run()
    assert read_landed(spark, path, schemas.REFUNDS).count() == 0
    run()
    run()
    assert sorted(r.order_id for r in read_landed(spark, path, schemas.REFUNDS).collect()) == list("01234")


def test_two_writers_admit_a_row_once(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.admit(refunds(spark, ROWS[:1]))
    plain, other = CommitLog.commit, []

    def after_another(self, *args, **kwargs):
        if not other:
            other.append(True)
            table(spark, tmp_path).admit(refunds(spark, [("x", "2024-01-01 10:00:00", "first")]))
        return plain(self, *args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", after_another)
        t.admit(refunds(spark, [("x", "2024-01-01 10:00:00", "second"), ("y", "2024-01-01 10:00:00", "y")]))
    assert got(t.read()) == [("m1", "a"), ("x", "first"), ("y", "y")]


def test_a_number_is_given_once_and_snapshots_hold_all(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    start = log.state()
    log.commit(start, [{"folder": "data/a", "rows": {}}])
    with pytest.raises(Conflict):
        log.commit(start, [{"folder": "data/b", "rows": {}}])
    for i in range(25):
        state = log.state()
        log.commit(state, [{"folder": f"data/{i}", "rows": {}}], source="s", batch=i)
    assert len(log.state().live) == 26 and log.state().batches == {"s": 24}
    assert list((tmp_path / "_log").glob("*.snapshot"))
    assert len(log.state(3).live) == 3 and log.state(21).batches == {"s": 19}


def test_filters_find_all_and_few_others():
    rng = np.random.default_rng(1)
    known = rng.integers(-(1 << 63), (1 << 63) - 1, 20_000)
    strange = rng.integers(-(1 << 63), (1 << 63) - 1, 20_000)
    filter_bytes = once.bloom(known)
    assert once.may_hold(filter_bytes, known).all()
    assert once.may_hold(filter_bytes, strange).mean() < 0.03
    assert len(filter_bytes) <= 2 * 10 * len(known) // 8


def test_wrong_hits_of_a_filter_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(once, "may_hold", lambda known, hashes: np.ones(len(hashes), dtype=bool))
    t = table(spark, tmp_path)
    t.admit(refunds(spark, ROWS[:1]))
    t.admit(refunds(spark, [("z", "2024-01-01 10:30:00", "new"), *ROWS[:1]]))
    assert got(t.read()) == [("m1", "a"), ("z", "new")]


def test_many_small_files_become_few_and_a_reader_sees_each_row_once(spark, tmp_path):
    t = table(spark, tmp_path)
    rows = [(f"m{i}", f"2024-01-{1 + i % 9:02d} {i % 24:02d}:00:00", str(i)) for i in range(300)]
    for n in range(6):
        t.admit(refunds(spark, rows[n::6]).repartition(8), "s", n)
    reader = t.read()
    before, files = got(reader), len(reader.inputFiles())
    t.compact()
    after = t.read()
    assert len(after.inputFiles()) == 1 < files
    assert got(after) == before == got(reader) and len(before) == 300
    # Copies are still known, and parts in order make a reader skip.
    t.admit(refunds(spark, rows[:50]))
    assert got(t.read()) == before
    t.compact()
    assert got(t.read()) == before
    assert t.vacuum(older_than=0.0) and got(t.read()) == before
    with pytest.raises(Exception):
        reader.count()


def test_packs_are_next_fit_and_large_parts_take_several():
    packs = once.OnceTable._packs({"a": 4, "b": 5, "c": 3, "d": 35, "e": 1}, 1.0, 10)
    assert packs == [("a", 0, 1), ("b", 0, 1), ("c", 1, 1), ("d", 2, 4), ("e", 6, 1)]


def test_versions_readers_and_a_table_built_from_itself(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path))
    t.replace(spark.range(1000))
    old, stop, seen = t.read(), threading.Event(), set()

    def read():
        while not stop.is_set():
            seen.add(t.read().count())

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(4):
        t.replace(t.read().where(f"id >= {100 * (i + 1)}"))
    stop.set()
    reader.join()
    assert seen <= {1000, 900, 800, 700, 600} and t.read().count() == 600
    assert old.count() == 1000 and t.read(number=2).count() == 900
    t.expire(keep=2)
    assert t.read(number=4).count() == 700
    with pytest.raises(Exception):
        old.count()
    t.replace(t.read().where("false"))
    assert t.read().count() == 0 and t.read().columns == ["id"]


def test_a_failed_replace_keeps_the_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path))
    t.replace(spark.range(3))
    with pytest.raises(Exception):
        t.replace(spark.range(3).select(F.raise_error(F.lit("no"))))
    assert t.read().count() == 3


def test_saved_tables_by_name(spark):
    df = spark.range(3)
    assert save_table(df, "numbers_by_version").count() == 3
    first = open_table(spark, "numbers_by_version")
    save_table(spark.table("numbers_by_version").where("id > 0"), "numbers_by_version")
    assert spark.table("numbers_by_version").count() == 2 and first.count() == 3
    assert open_table(spark, "numbers_by_version", 1).count() == 3
    expire_versions(spark, "numbers_by_version", keep=1)
    assert spark.table("numbers_by_version").count() == 2


def test_a_temp_table_is_computed_once(spark):
    counter = spark.sparkContext.accumulator(0)

    def count(rows):
        for row in rows:
            counter.add(1)
            yield row

    df = spark.createDataFrame(spark.range(5).rdd.mapPartitions(count), "id long")
    kept = temp_table(df, "counted_once")
    counted = counter.value
    assert kept.count() == kept.agg(F.count("*")).first()[0] == 5
    assert spark.sql("SELECT max(id) FROM counted_once").first()[0] == 4
    assert counter.value == counted


def test_merges_rewrite_only_changed_parts(spark, tmp_path):
    schema = T.StructType().add("k", "string").add("v", "long")
    t = MergedTable(spark, str(tmp_path), schema, F.substring("k", 1, 1), ("k",))
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    t.merge(rows(("a1", 1), ("a2", 2), ("b1", 3), (None, 9)), "s", 0)
    first = t.log.state()
    t.merge(rows(("a1", 10), (None, 90)), "s", 1)
    t.merge(rows(("a1", 77)), "s", 1)  # run before
    assert sorted(map(tuple, t.read().collect()), key=repr) == [
        ("a1", 10), ("a2", 2), ("b1", 3), (None, 90)
    ]
    kept = [e for f, e in t.log.state().live.items() if f in first.live]
    assert [set(e["rows"]) for e in kept] == [{"b"}]
    assert sorted(r.v for r in t.read(number=1).collect()) == [1, 2, 3, 9]
    t.merge(rows(), "s", 2)
    t.merge(rows(("b1", 4)), "s", 3)
    assert t.expire(keep=1) and sorted(r.v for r in t.read().collect()) == [2, 4, 10, 90]


def test_compaction_gives_a_pack_a_task_of_its_own(spark, tmp_path, monkeypatch):
    """Packs meet in no task: neither by their hash nor as packs of one large part."""
    t = table(spark, tmp_path / "t")
    for batch in range(2):
        rows = [(f"{batch}-{i}", f"2024-01-01 {min(i // 40, 9):02d}:00:00", "o") for i in range(800)]
        t.admit(refunds(spark, rows), "s", batch)
    before = got(t.read())
    folders = [f for f, e in t.log.state().live.items() if e["kind"] == once.DATA]
    total = 120_000
    monkeypatch.setattr(once.OnceTable, "_small", lambda *a: (folders, total))
    t.compact(target_bytes=total // 12)
    counts = [r["count"] for r in t.read().groupBy(F.input_file_name()).count().collect()]
    assert got(t.read()) == before and len(counts) >= 10 and max(counts) <= 240


def test_probe_finds_hits_by_part_and_slot():
    hashes = np.arange(100, dtype=np.int64)
    rows = [("a", 0, None, once.bloom(hashes[:50])), ("a", 0, None, once.bloom(hashes[50:60]))]
    rows += [("a", 0, int(h), None) for h in hashes] + [("b", 0, int(h), None) for h in hashes]
    rows += [("b", 1, None, once.bloom(hashes[:1])), ("b", 1, 0, None)]
    names = ["part", "slot", "h", "bits"]
    types = [once.pa.string(), once.pa.int32(), once.pa.int64(), once.pa.binary()]
    for size in (1, 7, 300):
        batches = [
            once.pa.RecordBatch.from_arrays(
                [once.pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), types, strict=True)], names
            )
            for i in range(0, len(rows), size)
        ]
        found = [(r["part"], r["h"]) for b in once._probe(iter(batches)) for r in b.to_pylist()]
        assert {("a", h) for h in range(60)} | {("b", 0)} <= set(found) and len(found) == len(set(found))
        assert len(found) <= 65
