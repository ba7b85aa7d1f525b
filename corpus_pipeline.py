"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor, which are written as Parquet and read
again between stages. All but the last return the columns of documents, whatever other columns there are. Nulls in any column,
empty and very long texts, ties, repeated rows and empty tables have the results that the operators' docstrings state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import common, jaccard, mixing, pieces, quality, queries, substring


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects: of any length and script; null and empty texts go."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id (null first); texts without words stay."""
    return jaccard.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur in another place first; those of which nothing is left go."""
    return substring.remove(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture asks for; a null source or language is one of its own."""
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and the text that they decode to."""
    return pieces.encode(docs, queries.MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the encoder; the tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        after = common.materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.discard(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
