"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from watchloom.llm import decontam, language, mixing, pii, secret_scan, sharding, simhash, tokens, toxicity, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_tokenizer() -> str:
    """Where the public tokenizer file is on this machine."""
    from public_tokenizers import path

    return path("word_bpe_49k.json")


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op2_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_language_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_documents(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op5_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op10_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_index(_table(spark, sf_dir, "documents"), default_tokenizer())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pii_bootstrap, op2_toxicity_kneser_ney, op3_language_byte_cnn, op4_mix_sources, op5_embedding_range_join, op6_rendezvous_shards, op7_huffman_tokens, op8_simhash_near_dedup, op9_secret_scan, op10_benchmark_tiling)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": mixing.ORACLE}
