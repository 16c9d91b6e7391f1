"""A corpus pipeline of five operators: quality rules, exact dedup, near dedup, mixing, tokenization.

Each stage gets all that its predecessor kept and returns a table; all but the last return the columns of
documents. SQL cannot express near-dedup, so ORACLE_SQL is None and the pipeline is tested by brute force.

Defined results: null and empty texts break the base rules and go in the first stage; very long texts are kept and read whole;
of repeated rows and equal texts one stays; of tied ids the row with the largest locator; rows with a null id are judged by
their text, and kept by near-dedup; null sources and languages are values of their own; an empty table gives an empty result; extra
columns, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, minhash, mixing, quality_rules
from tidemark.storage import Staging


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that rules or their host's verdict reject go."""
    return quality_rules.keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, A-Z in either case, the row with the largest doc_id stays."""
    return exact_dedup.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose five-word shingles are similar by 0.8 or more."""
    return minhash.keep(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens by target weights, no document twice."""
    return mixing.keep(docs, budget_share=0.9, max_epochs=1)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded bytes."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("minhash_dedup", near),
    ("mixing", mix),
    ("byte_bpe", tokenize),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder before the next one reads it."""
    stage = Staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage.table(step(spark, docs, sf_dir), name)
    return docs
