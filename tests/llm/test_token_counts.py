from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxcart.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, row long, key string, size long"
TEXTS = [
    None,
    "",
    " ",
    "   \n\t  ",
    "Hello  world's\n\n  end ",
    "a<|endoftext|>b <|endoftext|> <|endoftext|",
    "\x1c x\x85 y\xa0z  w ​ v",
    "naïve éé 東京 😀😀 123 4५६",
    "x" * 3000 + " " + "y" * 70 + " " + "word " * 2000,
    " 's 't don't I'LL we'll",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, doc_id, text):
    text = text or ""
    n = len(library.encode(text, add_special_tokens=False).ids)
    return doc_id, len(text.encode()), n, n > 1024


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# One frequent pre-token sends nearly all others through the shuffled join.
@pytest.mark.parametrize("frequent", [1, 100_000])
def test_hard_texts(spark, library, frequent):
    rng = random.Random(3)
    signs = "ab é東 \n\t\x1c'stl1२.,<|>😀\xa0"
    texts = TEXTS + ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(500)]
    rows = [(i if i % 9 else None, t, 7, "k", 1) for i, t in enumerate(texts)] + [(3, TEXTS[4], 1, "k", 2)] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = rows_of(token_counts.count(df, PATH, frequent=frequent))
    assert got == sorted((expected(library, r[0], r[1]) for r in rows), key=repr)


def test_documents(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = rows_of(token_counts.count(docs, PATH, frequent=500))
    assert got == sorted((expected(library, r.doc_id, r.text) for r in docs.collect()), key=repr)


def test_limit_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b")], "doc_id long, text string")
    assert [r.over_limit for r in token_counts.count(df, PATH, limit=2).orderBy("doc_id").collect()] == [True, False]
    assert token_counts.count(df.limit(0), PATH).collect() == []


def test_parts_are_borders():
    own = token_counts.pre_tokenizer(PATH)
    for text in filter(None, TEXTS):
        pieces = [p for part in token_counts.parts(text) for p in own.pattern.findall(part)]
        assert "".join(token_counts.parts(text)) == text
        assert pieces == own.pattern.findall(text)
