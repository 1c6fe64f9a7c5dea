"""A training-data pipeline: documents in, encoded documents out.

Each stage works on all that the one before it kept, is written as Parquet in the shared
folder and read again from there, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxcart.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from voxcart.llm.common import documents, scratch_scope, written

# No document is taken twice after duplicates have gone, so the mix is smaller than what
# comes in.
MIX = {"entropy_share": 0.95, "repeat_limit": 1.0, "budget_share": 0.75}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the first stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies one stays."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come closer to equal parts, within a budget of tokens."""
    return mixing.realise(docs, **MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text that they decode to."""
    return bpe.digest(docs, VOCABULARY)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("minhash_dedup", near),
    ("temperature_mix", mix),
    ("trie_bpe", encode),
]

# MinHash and BPE are beyond SQL; tests/llm/test_pipeline.py has brute force for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; working tables go with the stage that made them."""
    docs = documents(spark, sf_dir)
    with scratch_scope(spark) as whole:
        for name, stage in STAGES:
            with scratch_scope(spark) as own:
                docs = own.keep(written(stage(spark, docs, sf_dir), name))
        return whole.keep(docs)
