"""From raw documents to pieces: rules, near duplicates, benchmark leaks, secrets, encoding.

Each stage works on all rows that the one before kept and returns the columns of `documents`, but the last,
which returns ids. run() writes every stage as Parquet to the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import decontamination, near_duplicates, quality_rules, secret_scans, sentence_pieces
from tidegrid.session import materialize
from tidegrid.sources import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.stage(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return near_duplicates.without_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontamination.without(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; n_chars counts the new text."""
    return secret_scans.stage(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens, exact."""
    return sentence_pieces.encode(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("secret_scans", redact),
    ("sentence_pieces", encode),
]

#: SQL cannot express the stages for near duplicates, retrieval and pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents under sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
