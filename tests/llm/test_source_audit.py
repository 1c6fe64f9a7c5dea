from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxcart.llm import source_audit

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, place int"


def brute_force(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 5) // (total + 5 * len(kept)) for t in kept}

        mine = shares(counts[lang, source])
        whole = shares(sum((c for (x, _), c in counts.items() if x == lang), Counter()))
        parts = {"pair": [], "term": []}
        for x, other in groups:
            if x == lang and other != source:
                theirs = shares(counts[lang, other])
                parts["pair"].append((sum(abs(mine[t] - theirs[t]) for t in kept), other))
        for t in kept:
            if counts[lang, source][t] and mine[t] > whole[t]:
                parts["term"].append((mine[t] - whole[t], t))
        for part, found in parts.items():
            found.sort(key=lambda f: (-f[0], f[1].encode()))
            for rank, (value, item) in enumerate(found[: top if part == "term" else None], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = [a + b for a in ("ab", "É", "東京", "Zoo", "x") for b in ("", "q", "ß", "mn", "o")]
    out = []
    for _ in range(400):
        lang = rng.choice(["en", "en", "en", "de", None, ""])
        source = rng.choice(["s1", "s1", "s1", "s2", "S3", "é", None])
        picks = rng.choices(words, weights=range(1, 26), k=rng.choice([0, 1, 4, 30]))
        out.append((rng.choice([" ", "-", "1", "\n"]).join(picks), lang, source))
    out += [(None, "en", "s9"), ("once", "fr", "s1"), ("", "fr", "s2"), ("x " * 9000, "en", "s1")]
    return out + [("hot copy Zoo", "en", "s1")] * 200


@pytest.mark.parametrize(("block", "chunk", "held"), [(512, 8192, 500_000), (2, 6, 500_000), (2, 6, 4)])
def test_brute_force(spark, rows, block, chunk, held, monkeypatch):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("HELD", held)):
        monkeypatch.setattr(source_audit, name, value)
    df = spark.createDataFrame(
        [(i if i % 5 else None, *r, 1, "x", 0) for i, r in enumerate(rows)], SCHEMA
    ).repartition(3)
    got = sorted(map(tuple, source_audit.audit(df, 9, 4).collect()))
    assert got == brute_force(rows, 9, 4)


def test_skyband_keeps_what_fewer_dominate():
    rng = np.random.default_rng(2)
    for size, k in ((1, 1), (40, 3), (700, 5), (1500, 50)):
        group, whole = rng.integers(1, 30, size), rng.integers(1, 30, size)
        terms = [f"t{i:05d}".encode() for i in rng.permutation(size)]
        wanted = {
            i
            for i in range(size)
            if sum(
                group[j] >= group[i] and whole[j] <= whole[i] and terms[j] < terms[i]
                for j in range(size)
            )
            < k
        }
        assert set(source_audit.skyband(group, whole, terms, k).tolist()) == wanted


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(9 * 10**17, 4 * 10**18, 10**6)], "n long, total long, terms long")
    (got,) = df.select(source_audit.share("n", "total")).first()
    assert got == 1 + 10**9 * (9 * 10**17 + 5) // (4 * 10**18 + 5 * 10**6)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert source_audit.audit(df).collect() == []
