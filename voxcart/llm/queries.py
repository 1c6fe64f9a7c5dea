"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxcart.llm import (
    bpe,
    collocations,
    exact_dedup,
    langid,
    mixing,
    near_dedup,
    quality_gam,
    quality_rules,
    secrets,
    sharding,
    source_audit,
    token_counts,
    token_files,
)
from voxcart.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.mark(documents(spark, sf_dir))


def op4_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir))


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_gam.classify(documents(spark, sf_dir), labels)


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )
    return token_files.read_documents(manifest)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_spans(secrets.scan(documents(spark, sf_dir)))


def op9_piece_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(
        documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")
    )


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_quality_rules,
        op3_minhash_dedup,
        op4_temperature_mix,
        op5_quality_gam,
        op6_trie_bpe,
        op7_token_files,
        op8_secret_scan,
        op9_piece_langid,
        op10_byte_shards,
        op11_token_counts,
        op12_collocations,
        op13_source_audit,
    )
}
