"""Scalar helpers for SQL that Spark's dialect lacks or spells differently."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def similar_to(column: Column, pattern: str) -> Column:
    """``SIMILAR TO``: the whole text matches; ``%`` and ``_`` are wildcards, the rest is a regular expression."""
    return column.rlike("^(?:" + similar_pattern(pattern) + r")\z")


def similar_pattern(pattern: str) -> str:
    return re.sub(r"\\.|[%_.^$]", lambda m: {"%": "(?s:.*)", "_": "(?s:.)", ".": r"\.", "^": r"\^", "$": r"\$"}.get(m[0], m[0]), pattern)


def concat_skipping_nulls(*columns: Column) -> Column:
    """Concatenation that leaves nulls out."""
    return F.concat_ws("", *[c.cast("string") for c in columns])


def replace_first(column: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only, by plain text; the pattern has no groups of its own."""
    return F.when(column.rlike(pattern), F.regexp_replace(column, rf"(?s)\A(.*?)(?:{pattern})(.*)\z", f"$1{replacement}$2")).otherwise(column)


def register_error(spark: SparkSession) -> None:
    """Make ``error(message)`` callable in SQL: it raises with the message, or with a fallback for null."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION error(message STRING) RETURNS BIGINT RETURN raise_error(coalesce(message, 'Unknown Data Quality Error'))")
