"""Relational operators that Spark SQL has no syntax for, as compositions of those it has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def right_semi(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """The rows of ``right`` that have a partner."""
    return right.join(left, on, "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """The rows of ``right`` that have none."""
    return right.join(left, on, "left_anti")


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """``QUALIFY``: keep the rows for which a condition over window functions is true."""
    return df.withColumn("__qualify", condition).where("__qualify").drop("__qualify")


def limit_offset(df: DataFrame, count: int, skip: int = 0) -> DataFrame:
    return df.offset(skip).limit(count)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, tie: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """For each row of ``left`` the latest row of ``right`` with equal ``by`` and a time no later.

    Both sides are united, sorted once within the keys, and the last row of ``right`` seen is carried forward: one shuffle
    on the keys, no pairs. Among rows of one time the last in the order of ``tie`` counts. Columns of ``right`` get the prefix
    ``right_``; with ``how='left'`` rows without a partner stay. Null keys or times have no partner.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    payload = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    none = lambda df: F.lit(None).cast(df.select(F.struct("*").alias("s")).schema["s"].dataType)
    a = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct("*").alias("__l"), none(right).alias("__r"))
    b = right.where(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), none(left).alias("__l"), payload.alias("__r"))
    order = [F.col("__t").asc_nulls_first(), F.col("__side"), *[F.col(f"__r.{c}") for c in tie]]
    spot = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = a.unionByName(b).withColumn("__hit", F.last("__r", ignorenulls=True).over(spot)).where("__side = 1")
    matched = F.col("__hit").isNotNull()
    for key in by:
        matched = matched & F.col(f"`{key}`").isNotNull()
    kept = carried if how == "left" else carried.where(matched)
    return kept.select("__l.*", *[F.when(matched, F.col(f"__hit.`{c}`")).alias(f"right_{c}") for c in right.columns])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)
