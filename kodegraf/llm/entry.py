"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kodegraf.llm import ann, bagminhash, mixing, packing, pii, quality_classifier, quality_rules, secret_scan, token_counts, toxicity
from kodegraf.llm.common import documents, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op2_bagminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_bagminhash_near_duplicates": op2_bagminhash_near_duplicates,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_token_counts": op4_token_counts,
        "op5_learned_partitions": op5_learned_partitions,
        "op6_secret_scan": op6_secret_scan,
        "op7_toxicity": op7_toxicity,
        "op8_pattern_packing": op8_pattern_packing,
        "op9_source_mixing": op9_source_mixing,
        "op10_personal_data": op10_personal_data,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.SQL}
