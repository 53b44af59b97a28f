"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept. All stages but the last return the columns of ``documents``; the last
returns one row per packed piece. A stage's result is written as Parquet and
read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolesift.llm import line_dedup, mixing, near_dups, packing, repetition
from rolesift.llm.base import written

MIX_WEIGHTS = [5, 2, 1]
MIN_LINE_DOCUMENTS = 10


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return repetition.keep_acceptable(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand in ten documents or more."""
    return line_dedup.without_frequent_lines(docs, MIN_LINE_DOCUMENTS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: shingles of five words, similarity 0.8."""
    return near_dups.first_of_class(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice stands there twice."""
    return mixing.mixed_documents(docs, MIX_WEIGHTS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4,096 tokens, placed in sequences."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("source_mix", mixture),
    ("packing", packed),
]

# Signatures and token ids have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
