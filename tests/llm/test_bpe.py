from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxcart.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None,
    "",
    "   ",
    "Hello, world's  best\n\n\ttest 12345 tests　x",
    "naïve café — 東京 😀😀 ‍́ é",
    "x" * 3000 + "ab" * 2000 + "é" * 500,
    "before<|endoftext|>after <|endoftext|>",
    "a<|endoftext",
    "ththentionable ererhethe " * 200,
    "\x00\x01 \x7f \xa0\xad ÿ",
    "0" * 1000 + " " * 1000 + "\n" * 1000 + "=" * 777,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    data = np.array(ids, dtype="<u4").tobytes()
    decoded = library.decode(ids, skip_special_tokens=False)
    return (
        len(ids),
        hashlib.sha256(data).hexdigest(),
        hashlib.sha256(decoded.encode()).hexdigest(),
    )


def test_hard_texts(spark, library):
    df = spark.createDataFrame(
        [(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int"
    )
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digest(df, PATH).collect()}
    assert got == {i: expected(library, t) for i, t in enumerate(TEXTS)}


def test_documents(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digest(docs, PATH).collect()}
    assert got == {r.doc_id: expected(library, r.text) for r in docs.collect()}


def test_round_trip_and_added_tokens_as_text(spark):
    df = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    (row,) = bpe.encode(df, PATH, added_as_text=True).collect()
    assert row.decoded == "a<|endoftext|>b"
    assert 50256 not in np.frombuffer(row.ids, "<u4")


def test_every_token_encodes_as_merging_does():
    own = bpe.codec(PATH)
    texts = [t for t in (b.decode("utf-8", "ignore") for b in own.vocabulary.bytes[::7]) if t]
    for text in texts:
        data = text.encode()
        trie = own.encoder.encode_alone(data)
        assert np.frombuffer(trie, "<u4").tolist() == own.vocabulary.merge(data)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digest(df, PATH).collect() == []
