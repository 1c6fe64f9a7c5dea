from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest

from voxcart.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(text, names):
    if not text:
        yield []
    for i in range(1, len(text) + 1):
        if text[:i] in names:
            for rest in segmentations(text[i:], names):
                yield [names[text[:i]], *rest]


@pytest.fixture(scope="module")
def vocabulary():
    return langid.pieces(PATH)


def test_sums_over_all_segmentations(vocabulary):
    names = {n: i for n, (i, _) in vocabulary.automaton.items()}
    rng = np.random.default_rng(1)
    model = rng.random((vocabulary.size, 2)) / 1000
    words = ["der", "house", "été", "zzyx"]
    got = langid.word_scores(vocabulary, words, model)
    counts = np.array([3.0, 1.0, 2.0, 5.0])
    uses = np.zeros(vocabulary.size)
    for w, word in enumerate(words):
        ways = list(segmentations(langid.MARK + word, names))
        chances = np.array([np.prod(model[way], axis=0) for way in ways])
        assert np.allclose(got[w], np.log(chances.sum(axis=0)))
        for way, chance in zip(ways, chances[:, 0] / chances[:, 0].sum()):
            np.add.at(uses, way, counts[w] * chance)
    assert np.allclose(langid.expected_uses(vocabulary, words, counts, model[:, 0]), uses)


def test_long_runs_are_summed_whole(vocabulary, monkeypatch):
    """The pass over windows gives what the pass over many words gives, and whole runs."""
    rng = np.random.default_rng(2)
    model = (rng.random((vocabulary.size, 2)) + 1e-4) / 1000
    words = ["house", "dasistkeinwort", "été一x", "z" * 70, "langeswort" * 9]
    monkeypatch.setattr(langid, "SHORT", 1000)
    scores = langid.word_scores(vocabulary, words, model)
    counts = np.array([3.0, 1.0, 2.0, 5.0, 1.0])
    uses = langid.expected_uses(vocabulary, words, counts, model[:, 0])
    for short, window in ((0, 7), (5, 64), (0, 1 << 16)):
        monkeypatch.setattr(langid, "SHORT", short)
        monkeypatch.setattr(langid, "WINDOW", window)
        assert np.allclose(langid.word_scores(vocabulary, words, model), scores)
        assert np.allclose(langid.expected_uses(vocabulary, words, counts, model[:, 0]), uses)
    # No cut: two halves with a word's beginning each are another text.
    whole, halves = langid.words_of("ab" * 100), langid.words_of("ab" * 50 + " " + "ab" * 50)
    assert [len(w) for w in whole] == [200] and [len(w) for w in halves] == [100, 100]
    very_long = langid.word_scores(vocabulary, ["x" * 20_000], model)
    assert np.isfinite(very_long).all() and (very_long < -10_000).all()


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs, PATH).collect()}
    right = total = 0
    for row in docs.collect():
        found = got[row.doc_id]
        assert found.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= found.score <= 1
        if found.held_out:
            total += 1
            right += found.lang_pred == row.lang
    assert len(got) == docs.count() and right / total > 0.97


def test_defined_results(spark):
    rows = [
        (0, "the house of the father and the mother", "en", "a"),
        (1, "das haus der mutter und des vaters", "de", "a"),
        (2, None, "en", "a"),
        (3, "123 ... ²½", "en", "a"),
        (4, "", None, "a"),
        (5, "x" * 5000 + " 一", None, "a"),
        (None, "the mother", None, "a"),
        (7, "the mother", "en", "a"),
        (7, "the mother", "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, word string")
    got = sorted(map(tuple, langid.identify(df, PATH).collect()), key=repr)
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in got}
    assert [by_id[i][2:] for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert by_id[5][2] in ("de", "en") and by_id[None][1] is False


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.identify(df, PATH).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0), PATH).collect() == []
