"""The corpus pipeline: five stages from raw documents to the mixed training order.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is
written as Parquet and read again before the next. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflux.llm import decontamination, language, mixture, ngram_join, secrets
from folioflux.llm.common import dropped_since, fold, mark, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those between two languages."""
    model = language.fit(docs.where(fold("doc_id", 4) != 2))
    return language.filtered(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id."""
    return ngram_join.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage of the benchmark."""
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts by a mark."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: a row for each pass over a document, by position."""
    return mixture.mix(docs)


STAGES = [
    ("language", identify_language),
    ("ngram_join", deduplicate),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
]

#: Compression and hashing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begun = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped_since(spark, begun, path)  # the stage's own tables and its predecessor's result
    return STAGES[-1][1](spark, docs, sf_dir)
