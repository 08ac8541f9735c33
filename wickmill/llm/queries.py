"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wickmill.llm import (
    conversation_repair,
    cotraining,
    decontamination,
    language,
    license_scan,
    line_dedup,
    merkle,
    mixing,
    near_dups,
    pseudonyms,
    quality_rules,
    secret_scan,
    sentence_pieces,
)
from wickmill.llm.common import documents, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op5_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.judge_lines(documents(spark, sf_dir), short_links=True)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentence_pieces.encoding_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language,
        op2_decontamination,
        op3_near_dups,
        op4_license_scan,
        op5_cotraining,
        op6_line_dedup,
        op7_quality_rules,
        op8_pseudonyms,
        op9_mixing,
        op10_secret_scan,
        op11_sentence_pieces,
        op12_conversation_repair,
        op13_merkle_manifest,
    )
}

ORACLES: dict[str, str] = {
    "op3_near_dups": near_dups.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op9_mixing": mixing.SQL,
    "op13_merkle_manifest": merkle.SQL,
}

__all__ = ["ORACLES", "QUERIES"]
