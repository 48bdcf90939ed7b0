"""From raw documents to packed training sequences: five stages, each written and reread.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last return
the columns of ``docs``; the last returns the pieces of the packed sequences.

Edge cases are those of the operators: no stage fails on nulls, empty or long texts,
repeated rows, empty tables or columns that it does not know. Null and empty texts fail
the quality rules. Of repeated rows near-dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airtide.llm import language_id, packing, quality_rules, secret_scan, simhash
from airtide.plans.staging import stage

#: A document goes if its score is below this: the language chosen for it hardly wins, or the
#: document is unlike that language's labelled texts. One without a letter goes, too.
MIN_LANGUAGE_SCORE = 0.25


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, and documents that lose too much or fail as a whole."""
    return quality_rules.clean(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go. Learns from the labels of ``docs``."""
    return language_id.keep_identified(docs, MIN_LANGUAGE_SCORE)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return simhash.deduplicate(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by marks."""
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences that mix the sources in their shares."""
    import public_tokenizers

    return packing.pack(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("simhash_near_dedup", dedup_stage),
    ("secret_scans", secrets_stage),
    ("packing", packing_stage),
]

#: Stages that train machines, link near copies or parse keys have no SQL; tests hold the
#: pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
