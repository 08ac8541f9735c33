"""Corpus pipeline: documents in, a weighted mix of clean and different documents out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The first four return the columns of
documents; the last adds ``copy_no``, the number of the copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wickmill.llm import decontamination, line_dedup, mixing, near_dups, quality_rules
from wickmill.llm.common import documents, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line has go; a document left without a word goes too."""
    return line_dedup.drop_lines(docs, short_copies=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dups.keep_one_of_each(docs, near_dups.STAGE_PERCENT)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks for."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("mix_sources", mix),
]

# The quality score hashes n-grams, which SQL here cannot; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
