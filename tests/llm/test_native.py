"""Exact dedup, quality rules, mixing and sharding on small hand-made tables."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest

from voxcart.llm import exact_dedup, mixing, quality_rules, sharding
from voxcart.llm.common import scratch_scope, written
from voxcart.session import checkpoint_root

SPACE = r"[\x20\x09-\x0D]+"


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(*r, "x", 1, True) for r in rows],
        "doc_id long, text string, lang string, source string,"
        " text_sha256 string, copies int, kept boolean",
    )


ROWS = [
    (3, "a  b", "en", "s1"),
    (1, "a\tb", "en", "s1"),
    (1, "a\tb", "en", "s1"),
    (None, "a b", "en", "s2"),
    (7, None, None, None),
    (8, "", "en", "s1"),
    (9, "é " * 30_000, "xx", "s2"),
    (10, "a b ", "en", "s2"),
]


def exact_brute_force(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        sha = hashlib.sha256(re.sub(SPACE, " ", text or "").encode()).hexdigest()
        groups[sha].append(doc_id)
    out = []
    for sha, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        first = known[0] if known else None
        seen = False
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, first, len(ids), not seen, sha))
            seen = True
    return sorted(out, key=repr)


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_dedup(spark, counters):
    rows = ROWS + [(100 + i, "hot text", "en", "s1") for i in range(500)]
    rows += [(1000 + i, f"rare {i}", "en", "s1") for i in range(500)]
    df = frame(spark, rows).repartition(7)
    got = sorted(map(tuple, exact_dedup.mark(df, counters).collect()), key=repr)
    assert got == exact_brute_force(rows)
    kept = exact_dedup.keep_first(df, counters)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in got if r[3])


def test_exact_dedup_broadcasts_the_frequent_winner(spark):
    rows = [(i, "hot", "en", "s") for i in range(300)] + [(i, f"t{i}", "en", "s") for i in range(300, 600)]
    digests = frame(spark, rows).select(
        "doc_id", exact_dedup.text_digest(exact_dedup.F.col("text")).alias("text_sha256")
    )
    (winner,) = exact_dedup.frequent_winners(digests).collect()
    assert (winner.winner_id, winner.copies) == (0, 300)


def quality_brute_force(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered), failed,
    )


def test_quality_measures_and_guards(spark):
    prose = "the cat and the dog of the house and the men of the town went to see what "
    fine = " ".join(f"{w}{i}" if i % 3 else w for i, w in enumerate((prose * 40).split()))
    rows = [(i, fine, "en", "s") for i in range(20)]
    rows += [
        (100, " ".join(f"X{i}Z$$$" for i in range(80)), "en", "s"),
        (101, "a b c d e f g h i j " * 5, "en", "s"),
        (102, "one two three four five six seven eight nine ten", "en", "s"),
        (103, "x\nx\n \n\ny x\n", None, None),
        (104, None, "en", "s"),
        (105, "a " * 20_000, "zz", "s"),
        (None, "é#é 😀* a\x0bb", "zz", "s"),
    ]
    got = quality_rules.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, *_ in rows:
        r = by_id[doc_id]
        assert (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
        ) == quality_brute_force(text)
    assert by_id[0].kept and by_id[102].kept and by_id[102].class_distance is None
    assert not by_id[100].kept and not by_id[100].base_failed
    kept = quality_rules.keep_good(frame(spark, rows))
    assert kept.count() == sum(r.kept for r in got)
    assert kept.columns == frame(spark, rows).columns


def test_mixing_meets_target_and_budget(spark):
    rows = [(i, "w " * 10, "en", "hot") for i in range(3000)]
    rows += [(5000 + i, "w " * 10, "en", f"s{i % 5}") for i in range(500)]
    rows += [(None, "w w", "en", None), (9000, None, "en", "empty"), (9001, "", "en", "empty")]
    df = frame(spark, rows)
    plan = mixing.plan(df, entropy_share=0.9, repeat_limit=3.0, budget_share=1.0).collect()
    assert len(plan) == len(rows)
    taken, tokens = Counter(), Counter()
    for r in plan:
        taken[r.source] += r.copies * r.n_tokens
        tokens[r.source] += r.n_tokens
    # No source above its limit, the budget kept but for what the last documents lack.
    assert all(taken[s] <= 3.1 * tokens[s] for s in tokens if tokens[s])
    assert taken.total() <= tokens.total()
    assert taken["hot"] < tokens["hot"] and taken["s1"] > tokens["s1"] and taken["empty"] == 0
    out = mixing.realise(df, entropy_share=0.9, repeat_limit=1.0, budget_share=0.5)
    assert out.columns == df.columns
    assert max(Counter(r.doc_id for r in out.collect()).values()) == 1


def test_budget_holds_without_ids_and_with_repeated_ones(spark):
    rows = [(None, f"{'w ' * (i % 20)}x{i}", "en", f"s{i % 3}") for i in range(1000)]
    rows += [(i % 40, "a b c " * (i % 7), "en", "s1") for i in range(400)]
    df = frame(spark, rows)
    plan = mixing.plan(df, budget_share=0.5, repeat_limit=1.0).collect()
    planned = sum(r.copies * r.n_tokens for r in plan)
    total = sum(r.n_tokens for r in plan)
    out = mixing.realise(df, budget_share=0.5, repeat_limit=1.0).collect()
    taken = sum(len((r.text or "").split()) for r in out)
    assert len(plan) == len(rows) and taken == planned <= 0.5 * total
    assert taken > 0.4 * total
    given = Counter((i, t, s) for i, t, _, s in rows)
    assert all(n <= given[k] for k, n in Counter((r.doc_id, r.text, r.source) for r in out).items())


def test_mix_of_columns_with_clashing_names(spark):
    df = frame(spark, [(i, "a b", "en", f"s{i % 2}") for i in range(50)]).selectExpr(
        "*", "1 AS block", "2 AS of_block", "3 AS of_source", "4 AS last_place", "5 AS rounds", "6 AS tokens"
    )
    out = mixing.realise(df, budget_share=0.5, repeat_limit=1.0)
    assert out.columns == df.columns
    assert {tuple(r)[-6:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6)}


def test_written_shards_hold_each_row_once(spark, tmp_path):
    rows = [(1, "a", "en", "s"), (None, "b", "en", "s"), (2, "c", "en", "s"), (2, "d", None, None)]
    rows += [(None, None, "en", "s"), (3, "a", "en", "s")]
    df = frame(spark, rows).selectExpr("*", "'mine' AS shard", "7 AS size", "8 AS place")
    folder = sharding.write_shards(df, str(tmp_path / "shards"), shards=3)
    back = spark.read.parquet(folder)
    kept = Counter(tuple(r) for r in back.select(df.columns).collect())
    assert kept == Counter(tuple(r) for r in df.collect())
    shards = {}
    for r in sharding.assign(df, shards=3).collect():
        shards.setdefault((r.doc_id, r.text_crc32), set()).add(r.shard)
    for r in back.collect():
        assert r._shard in shards[r.doc_id, zlib.crc32((r.text or "").encode())]
    assert sharding.write_shards(df.drop("shard").limit(0), str(tmp_path / "none"), shards=3)


def test_shards_against_plain_sums(spark):
    rows = ROWS + [(100 + i, f"text {i % 40} " * (1 + i % 7), "en", "s") for i in range(300)]
    rows += [(5000 + i, "hot " * 20, "en", "s") for i in range(200)]
    order = sorted(
        ((hashlib.md5((t or "").encode()).hexdigest(), i is not None, i or 0, i, len((t or "").encode()) + 16)
         for i, t, *_ in rows),
    )
    total, start, slots, wanted = sum(o[4] for o in order), 0, Counter(), []
    for *_, doc_id, size in order:
        shard = min(start * 7 // total, 6)
        wanted.append((doc_id, size, shard, slots[shard], start))
        slots[shard] += 1
        start += size
    got = [
        (r.doc_id, r.size, r.shard, r.slot, r.start)
        for r in sharding.assign(frame(spark, rows), shards=7).collect()
    ]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_scratch_tables_go_with_their_scope(spark):
    root = checkpoint_root(spark).removeprefix("file:")

    def folders():
        return {f for f in os.listdir(root) if f.startswith("voxcart-scoped")}

    before = folders()
    with scratch_scope(spark) as outer:
        first = written(spark.range(3), "scoped")
        with scratch_scope(spark) as inner:
            written(spark.range(4), "scoped")
            kept = inner.keep(written(spark.range(5), "scoped"))
        assert kept.count() == 5 and len(folders() - before) == 2
        with pytest.raises(ValueError), scratch_scope(spark):
            written(spark.range(6), "scoped")
            raise ValueError
        assert first.count() == 3 and len(folders() - before) == 2
        outer.keep(first)
    assert len(folders() - before) == 1 and first.count() == 3


def test_exponent_is_the_largest_that_is_even_enough(spark):
    import math

    tokens = {"a": 900, "b": 90, "c": 10}
    df = spark.createDataFrame(list(tokens.items()), "source string, tokens long")

    def entropy(power):
        w = [(t / 1000) ** power for t in tokens.values()]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    found = mixing.exponent(df, entropy_share=0.8, repeat_limit=1000.0)
    assert entropy(found) >= 0.8 * math.log(3) > entropy(found + 1e-9)
    limited = mixing.exponent(df, entropy_share=0.99, repeat_limit=4.0)
    w = {s: (t / 1000) ** limited for s, t in tokens.items()}
    worst = max(w[s] / sum(w.values()) / (t / 1000) for s, t in tokens.items())
    assert abs(worst - 4.0) < 1e-6


def test_shards(spark):
    rows = ROWS + [(100 + i, f"text {i % 40} " * (1 + i % 7), "en", "s") for i in range(400)]
    rows += [(5000 + i, "hot " * 20, "en", "s") for i in range(300)]
    got = sharding.assign(frame(spark, rows), shards=8).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    slots = defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    expected = Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # One very long text takes several shards' worth; the others are near equal.
    assert set(sizes) <= set(range(8))
    usual = [(100 + i, f"text {i % 40} " * (1 + i % 7), "en", "s") for i in range(4000)]
    sizes = Counter()
    for r in sharding.assign(frame(spark, usual), shards=8).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * sizes.total() / 8


def test_empty_tables(spark):
    df = frame(spark, ROWS).limit(0)
    for operator in (
        exact_dedup.mark, exact_dedup.keep_first, quality_rules.judge, quality_rules.keep_good,
        mixing.plan, mixing.realise, sharding.assign,
    ):
        assert operator(df).collect() == []
