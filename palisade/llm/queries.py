"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import extraction, jaccard, mixing, pieces, quality, shards, substring, topk, urlfilter, warc

#: The SentencePiece model of the registered queries: a file of the box's public tokenizers.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_documents(spark, sf_dir), MODEL)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(_documents(spark, sf_dir))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_pages(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the compacted dataset, without the names of their shards, which differ from run to run."""
    return shards.compacted(_documents(spark, sf_dir)).drop("shard")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(_documents(spark, sf_dir))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = urlfilter.derived(_pages(spark, sf_dir))
    return urlfilter.judge(captures, entries).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_pages(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir)).select("doc_id", "keep")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_documents(spark, sf_dir))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20 against all rows."""
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), query=F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_sentencepiece,
            op2_source_mixing,
            op3_html_extraction,
            op4_sharding,
            op5_substring_dedup,
            op6_url_filter,
            op7_warc,
            op8_quality_rules,
            op9_jaccard_join,
            op10_topk_search,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_sharding": "SELECT * FROM documents",
        "op5_substring_dedup": substring.oracle_sql(),
        "op6_url_filter": urlfilter.ORACLE_SQL,
        "op7_warc": warc.ORACLE_SQL,
        "op8_quality_rules": quality.ORACLE_SQL,
        "op9_jaccard_join": jaccard.ORACLE_SQL,
        "op10_topk_search": topk.ORACLE_SQL,
    }
