from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np

from voxcart.llm import quality_gam


def test_fits_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert (2, 5) in model.pairs
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(4)
    x = rng.random((500, len(quality_gam.FEATURES)))
    model = quality_gam.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float))
    row = x[7]
    total = model.intercept
    for j, edges in enumerate(model.edges):
        total += model.tables[j][sum(e <= row[j] for e in edges)]
    for (j, k), table in zip(model.pairs, model.pair_tables):
        total += table[sum(e <= row[j] for e in model.coarse[j]), sum(e <= row[k] for e in model.coarse[k])]
    assert np.isclose(model.margins(x)[7], total)


def test_held_out_accuracy(spark, folder):
    folder = folder.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in quality_gam.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in held)
    right = np.mean([got[r.doc_id].predicted == r.quality for r in held])
    good = [r for r in held if r.quality == 1]
    kept = np.mean([got[r.doc_id].predicted == 1 for r in good])
    bad = np.mean([got[r.doc_id].predicted == 0 for r in held if r.quality == 0])
    print(right, kept, bad, len(held))
    assert right > 0.95 and kept > 0.98 and bad > 0.8


def plain_features(text):
    """The features one by one, without arrays."""
    white = "[ \\t\\n\\x0b\\x0c\\r]+"
    words = [w for w in re.split(white, text) if w]
    n, data = len(words) or 1, [b for b in text.encode() if b not in b"\t\n\x0b\x0c\r "]
    chars = len(data) or 1
    sizes = [len(w.encode()) for w in words]
    counts, octets = Counter(words), Counter(data)
    lines = [line.encode() for line in text.split("\n") if re.sub(white, "", line)]
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) > 5 else []

    def ascii_upper(w):
        letters = [c for c in w if c.isascii() and c.isalpha()]
        return bool(letters) and all(c.isupper() for c in letters)

    return {
        "words": math.log1p(len(words)),
        "length": sum(sizes) / n,
        "long": sum(s > 12 for s in sizes) / n,
        "different": len(counts) / n,
        "commonest": max(counts.values(), default=0) / n,
        "doubled": sum(a == b for a, b in zip(words, words[1:])) / n,
        "repeated": 1 - len(set(runs)) / len(runs) if runs else 0.0,
        "entropy": -sum(c / chars * math.log2(c / chars) for c in octets.values()),
        "per_line": len(words) / (len(lines) or 1),
        "same_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "ended": sum(line.rstrip(b" \t\n\x0b\x0c\r")[-1:] in (b".", b"!", b"?") for line in lines) / (len(lines) or 1),
        "shouted": sum(ascii_upper(w) and len(w.encode()) > 1 for w in words) / n,
        "marked": sum(w[-1] in "#*$%&|<>!" for w in words) / n,
    }


def test_features_against_plain_python(spark, folder):
    texts = ["", " \n\t", "A b A b. A b A b A b", "x", "é É ÉÉ AB a! b# c\nc\n\nd. \r\n", "a a a a a a a"]
    texts += [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(100).collect()]
    classes = len(quality_gam._IN)
    for text in texts:
        got = quality_gam.features(text)
        plain = list(plain_features(text).values())
        assert np.allclose(got[:7], plain[:7]) and np.allclose(got[7 + classes :], plain[7:]), text
        data = [b for b in text.encode() if b not in b"\t\n\x0b\x0c\r "]
        for share, chosen in zip(got[7 : 7 + classes], quality_gam._IN.values()):
            inside = set(np.arange(256)[chosen].tolist())
            assert np.isclose(share, sum(b in inside for b in data) / (len(data) or 1))


def test_ties_repeated_rows_and_the_query(spark, folder):
    """Scores of the whole query are those of a model fitted by hand on the same rows."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    chosen = sorted(
        (r.doc_id, float(r.quality)) for r in labels.collect()
        if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5
    )
    model = quality_gam.fit(
        np.array([quality_gam.features(texts[i]) for i, _ in chosen]), np.array([y for _, y in chosen])
    )
    names = list(texts)
    wanted = dict(zip(names, model.scores(np.array([quality_gam.features(texts[i]) for i in names]))))
    rows = quality_gam.classify(docs.repartition(5), labels).collect()
    assert len(rows) == len(names)
    for r in rows:
        assert np.isclose(r.score, wanted[r.doc_id]) and r.predicted == int(r.score >= 0.3)
    twice = quality_gam.score(docs.union(docs.limit(20)), model).collect()
    assert len(twice) == len(names) + 20 and len(set(map(tuple, twice))) == len(names)


def test_defined_results(spark):
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 1), (3, "a " * 20000, 0), (None, "a b", 1), (3, "x", 0)],
        "doc_id long, text string, label int",
    )
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int"
    )
    rows = quality_gam.classify(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    assert {r.score for r in quality_gam.classify(docs, none).collect()} == {0.5}
    assert quality_gam.classify(docs.limit(0), labels).collect() == []
