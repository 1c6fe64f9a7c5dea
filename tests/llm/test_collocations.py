from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxcart.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n long, following string, prefix string"


def brute_force(rows, least, top=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang or "und" if lang is None else lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for w, c in counts.items() if len(w) == 1)
        candidates = {w: c for w, c in counts.items() if len(w) > 1 and c >= least}
        found = []
        for w, a in candidates.items():
            if any(
                len(v) > len(w) and 100 * c >= 80 * a
                and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
                for v, c in candidates.items()
            ):
                continue
            score, k = min((2000000 * a // (counts[w[:k]] + counts[w[k:]]), k) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), counts[w[:k]], counts[w[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "The", "cat", "a\xa0b", "é", "É", "東京", "x\x1c", "sat-on", "mat"]
    gaps = [" ", "  ", "\t", ". ", ",", "\n", " ; "]
    out = []
    for i in range(300):
        n = rng.choice([0, 1, 3, 20])
        picks = rng.choices(words, weights=range(10, 0, -1), k=n)
        out.append(("".join(w + rng.choices(gaps, weights=[20, 2, 2, 1, 1, 1, 1])[0] for w in picks), rng.choice(["en", "en", "de", None, ""])))
    out += [(None, "en"), ("", "fr"), ("once upon a time " * 40, "en")] + [("the hot pair", "en")] * 200
    return out


@pytest.mark.parametrize("portion", [1 << 24, 200])
def test_brute_force(spark, rows, portion, monkeypatch):
    df = spark.createDataFrame(
        [(i if i % 7 else None, t, lang, 5, "x", "y") for i, (t, lang) in enumerate(rows)], SCHEMA
    ).repartition(3)
    monkeypatch.setattr(collocations, "PORTION", portion)
    assert rows_of(collocations.collocations(df, least=8)) == brute_force(rows, 8)


def test_top_and_ties(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string")
    assert rows_of(collocations.collocations(df, least=5, top=3)) == brute_force(rows, 5, top=3)


def test_wrong_hits_of_the_bit_table_change_nothing(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "text string, lang string")
    full = np.full(collocations.BITS // 64, np.iinfo(np.uint64).max, dtype=np.uint64)
    monkeypatch.setattr(collocations, "_bits", lambda frequent: full)
    assert rows_of(collocations.collocations(df, least=8)) == brute_force(rows, 8)


def test_prefix_totals(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string")
    merged = collocations.merged_stripes(df, 3, 8)
    for length in (1, 2):
        entries = collocations.extensions(merged[length - 1], length - 1, 8)
        totals = merged[length].groupBy("lang", "prefix").sum("n")
        wrong = entries.join(totals, (entries.lang == totals.lang) & (entries.phrase == totals.prefix), "left")
        assert wrong.where("`sum(n)` IS NULL OR `sum(n)` != f").count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(df).collect() == []
