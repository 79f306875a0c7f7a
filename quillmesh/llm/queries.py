"""Registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import licences, lines, mixing, packing, pii, quality, simhash, spans, token_counts, vectors
from quillmesh.llm.common import documents


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.query(documents(spark, sf_dir))


def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(documents(spark, sf_dir))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(documents(spark, sf_dir))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.query(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.query(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.query(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.query(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(documents(spark, sf_dir))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation_query(documents(spark, sf_dir))


def licence_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.base_query(documents(spark, sf_dir))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.source_targets(documents(spark, sf_dir))


def word_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.words_query(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_pii_bootstrap": op3_pii_bootstrap,
    "op4_source_mixing": op4_source_mixing,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
    "quality_ablations": quality_ablations,
    "licence_base": licence_base,
    "mixing_targets": mixing_targets,
    "word_rollup": word_rollup,
}

ORACLE_SQL: dict[str, str] = {
    "op5_embedding_near_dedup": vectors.ORACLE,
    "licence_base": licences.BASE_ORACLE,
    "mixing_targets": mixing.TARGETS_ORACLE,
    "word_rollup": token_counts.WORDS_ORACLE,
    "op6_line_dedup": lines.ORACLE,
    "op9_quality_rules": quality.ORACLE,
    "quality_ablations": quality.ABLATION_ORACLE,
}
