from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxcart.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
END = 2
TEXTS = [
    (5, "Hello  WORLD's \n tests 12345 naïve é café"),
    (3, None),
    (4, ""),
    (9, "東京 😀  a　b\x1cc\x85d\xa0e <|endoftext|>x<|startoftext|>"),
    (1, "word " * 5000 + "x" * 4000),
    (2, "same"),
    (2, "same"),
    (None, "no id"),
    (7, " ́a  ͅ ΑΣ Σ"),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [END]
        data = np.array(ids, dtype="<u4").tobytes()
        out.append((doc_id, start, len(ids), zlib.crc32(data)))
        start += len(ids)
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("length", [7, 2048])
def test_hard_texts(spark, library, length):
    df = spark.createDataFrame(
        [(*r, "x") for r in TEXTS], "doc_id long, text string, part string"
    ).repartition(4)
    manifest = token_files.write(df, PATH, END, length=length)
    assert rows_of(token_files.read_documents(manifest)) == expected(library, TEXTS)


def test_documents(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    manifest = token_files.write(docs, PATH, END)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(token_files.read_documents(manifest)) == expected(library, rows)


def test_random_access(spark, library):
    df = spark.createDataFrame([(1, "one two three " * 3000)], "doc_id long, text string")
    (row,) = token_files.write(df, PATH, END, length=16).collect()
    file = token_files.TokenFile(row.ids_file)
    ids = library.encode(df.first().text, add_special_tokens=False).ids + [END]
    for i in (0, 63, 64, 200):
        got, mask = file.sequence(i)
        assert got.tolist() == ids[16 * i : 16 * i + 16] and all(mask.to_pylist())
    last, mask = file.sequence((len(ids) - 1) // 16)
    assert last[mask.to_numpy(zero_copy_only=False)].tolist() == ids[(len(ids) - 1) // 16 * 16 :]
    assert not got.flags.owndata


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(token_files.read_documents(token_files.write(df, PATH, END))) == []
