"""The pipeline against brute force, stage by stage."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.test_bpe import expected as encoded
from tests.llm.test_native import exact_brute_force
from tests.llm.test_near_dedup import brute_force as near_brute_force
from tests.oracle import connect
from tokenizers import Tokenizer
from voxcart.llm import mixing
from voxcart.llm.oracles import ORACLES


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [
        "quality_rules", "exact_dedup", "minhash_dedup", "temperature_mix", "trie_bpe"
    ]
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, folder).cache()
    verdicts = connect(folder).sql(ORACLES["op2_quality_rules"]).df()
    assert {r.doc_id for r in good.collect()} == set(verdicts[verdicts.kept].doc_id)
    first = stages[1](spark, good, folder).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in first.collect()} == {r[0] for r in exact_brute_force(rows) if r[3]}
    apart = stages[2](spark, first, folder).cache()
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert {r.doc_id for r in apart.collect()} == {
        i for i, (_, _, kept) in near_brute_force(rows).items() if kept
    }
    mixed = stages[3](spark, apart, folder).cache()
    plan = {r.doc_id: r.copies for r in mixing.plan(apart, **corpus_pipeline.MIX).collect()}
    ids = [r.doc_id for r in mixed.collect()]
    assert sorted(ids) == sorted(i for i, n in plan.items() for _ in range(n))
    assert len(set(ids)) == len(ids) and all(d.columns == docs.columns for d in (good, first, apart, mixed))
    library = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    last = {r.doc_id: tuple(r)[1:] for r in stages[4](spark, mixed, folder).collect()}
    assert last == {r.doc_id: encoded(library, r.text) for r in mixed.collect()}
    run = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, folder).collect()}
    assert run == last


def test_rows_without_ids_repeated_ids_and_clashing_names(spark, tmp_path):
    """Rows without doc_id are decided by their text and never lost to another's copy."""
    good = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = [(i, t, "en", f"s{i % 3}", 1, 2) for i, t in enumerate(good)]
    rows += [(None, good[0], "en", "s1", 1, 2), (None, None, None, None, 1, 2), (5, good[7], "en", "s1", 1, 2)]
    rows += [(900, "", "en", None, 1, 2), (901, "w " * 30_000, None, "s1", 1, 2)]
    df = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, label int, node int"
    )
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    given = {r[0] for r in rows}
    assert {r.doc_id for r in out.collect()} <= given and out.count() > 10


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
