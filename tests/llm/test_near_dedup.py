from __future__ import annotations

import re

import numpy as np
import pytest

from voxcart.llm import near_dedup


def shingle_set(text):
    words = re.findall(
        r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    )
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows):
    """component_id by doc_id: all pairs, union by smallest id."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, own in sorted(sets.items()):
        near = set().union(*(holders.get(s, set()) for s in own))
        for j in near:
            both = len(own & sets[j])
            if 100 * both >= 75 * (len(own) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in own:
            holders.setdefault(s, set()).add(i)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def marked(df):
    return {r.doc_id: tuple(r)[1:] for r in near_dedup.mark(df).collect()}


def test_sets_follow_the_contract():
    for text in ["a b c d e f a b c d e", "A\tb\nC", "", None, "  ", "İ K é\xa0x É", "one " * 3000]:
        assert len(near_dedup.shingles(text)) == len(shingle_set(text))
    assert near_dedup.shingles("A b  c").tolist() == near_dedup.shingles("a\nB C").tolist()


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_documents(spark, folder, scale):
    docs = spark.read.parquet(folder.replace("sf0.001", scale) + "/documents.parquet")
    expected = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert marked(docs) == expected
    assert len({v[1] for v in expected.values()}) < len(expected)


def test_chains_and_one_large_group(spark):
    """Copies with changes at several places: many links fail and the group still holds."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words)) for i in (900, 901)]
    for i in range(120):
        own = list(words)
        for place in rng.choice(400, 9, replace=False):
            own[place] = f"x{i}y{place}"
        rows.append((i, " ".join(own)))
    # Many texts that share a passage and are not similar.
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [
        (2000 + i, passage + " " + " ".join(f"q{i}r{k}" for k in range(60))) for i in range(150)
    ]
    # A chain: each text is similar to the next only.
    rows += [(3000 + i, " ".join(f"c{k}" for k in range(6 * i, 6 * i + 60))) for i in range(40)]
    rows += [(4000, None), (4001, ""), (4002, "two words"), (4003, "Two\nWORDS")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, label int")
    assert marked(df) == brute_force(rows)


@pytest.mark.parametrize("edits", [(2, 9), (5, 7)])
def test_large_group_of_members_mostly_below_the_bound(spark, edits):
    """Edits at random places, some of them shared: links lie between any two members."""
    rng = np.random.default_rng(sum(edits))
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        own = list(base)
        for place in rng.choice(150, rng.integers(*edits), replace=False):
            own[place] = f"x{i}y{place}"
        rows.append((i, " ".join(own)))
        if i % 10 == 0:  # a second text with the same edits and one of its own
            own[rng.integers(0, 150)] = f"z{i}"
            rows.append((1000 + i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_force(rows)
    assert marked(df) == expected
    assert 20 < len({v[1] for v in expected.values()}) < len(rows)


def test_difference_prefixes_find_every_link(spark, monkeypatch):
    """With every bucket treated as a large one."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 1)
    test_chains_and_one_large_group(spark)


def test_rows_without_id_and_repeated_rows(spark):
    text = "one two three four five six"
    rows = [(None, text), (None, text), (3, text), (3, text), (5, text), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_dedup.mark(df).collect()), key=repr)
    expected = [(None, 2, None, True)] * 2 + [(3, 2, 3, True)] * 2
    expected += [(5, 2, 3, False), (6, 0, 6, True)]
    assert got == sorted(expected, key=repr)
    assert sorted((r.doc_id for r in near_dedup.keep_one(df).collect()), key=repr) == [
        3, 3, 6, None, None
    ]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50, 90)] + [(7, 3), (3, 11), (11, 20), (30, 31)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(near_dedup.components(df).collect())
    expected = {i: 50 for i in range(50, 91)} | dict.fromkeys((3, 7, 11, 20), 3)
    assert got == expected | {30: 30, 31: 30}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert marked(df) == {}
