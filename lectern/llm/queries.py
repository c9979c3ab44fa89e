"""The operators' registered queries: each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import ann, decontaminate, divergence, language_model, lexical, licenses, mixing, near_dup, pii, quality, sharding, token_counts, toxicity
from ._spark import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model_scores(spark, read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(spark, read(spark, sf_dir, "documents")).drop("node")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, read(spark, sf_dir, "embeddings"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, read(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(spark, read(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_pii": op1_pii,
    "op2_language_model": op2_language_model,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_licenses": op5_licenses,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_nearest": op10_nearest,
    "op11_sharding": op11_sharding,
    "op12_divergence": op12_divergence,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {"op12_divergence": divergence.SQL, "op13_lexical_search": lexical.SQL}
