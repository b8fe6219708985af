"""A corpus pipeline: documents in, tokenized clean documents out, one Parquet table after each stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carequeue.llm import bpe, decontaminate, language, secrets, simhash
from carequeue.llm.shared import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters, or of doubtful language, go."""
    return language.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id; of rows without ids, one."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mask."""
    return secrets.redact(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded bytes of each document."""
    return bpe.digests(bpe.encode_decode(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("bpe_round_trip", tokenized),
]

#: Language models and secret models are trained on the documents, which SQL does not express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each stage's rows written as Parquet and read again by the next.

    Null and empty texts go in the first stage (they have no language). Every stage judges rows by what they hold: rows
    without id and rows that share one go or stay as any other. Repeated rows are one after the second stage.
    An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
