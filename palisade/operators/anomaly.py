"""Anomalies against history: row counts, and z-scores of averages whose history leaves anomalous values out."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLAT = 1e-9


@dataclass(frozen=True)
class MetricState:
    """Running mean and population variance."""

    mean: float = 0.0
    variance: float = 0.0
    count: int = 0

    def add(self, value: float) -> MetricState:
        count = self.count + 1
        delta = value - self.mean
        mean = self.mean + delta / count
        return MetricState(mean, (self.variance * self.count + delta * (value - mean)) / count, count)


def row_count_check(current: int, previous: int | None, threshold: float = 0.1) -> str:
    """``no_history``, ``ok`` or ``anomaly``: a relative change of more than the threshold."""
    if previous is None:
        return "no_history"
    if previous == 0:
        return "ok"
    return "anomaly" if abs(current - previous) / previous > threshold else "ok"


def z_check(value: float, state: MetricState | None, threshold: float = 3.0) -> str:
    """``no_history`` below two values, ``ok`` without spread, else by the distance in deviations."""
    if state is None or state.count < 2:
        return "no_history"
    deviation = math.sqrt(state.variance)
    if deviation <= FLAT:
        return "ok"
    return "anomaly" if abs(value - state.mean) / deviation > threshold else "ok"


def z_update(value: float, state: MetricState | None, threshold: float = 3.0) -> tuple[str, MetricState]:
    """Check, and take the value into the history unless it is an anomaly."""
    state = state or MetricState()
    verdict = z_check(value, state, threshold)
    return verdict, state if verdict == "anomaly" else state.add(value)


def row_count_history(runs: DataFrame, order: str, count: str, threshold: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Each run with the one before: ``previous`` and ``verdict``."""
    previous = F.lag(count).over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(order))
    change = F.abs(F.col(count) - F.col("previous")) / F.col("previous")
    verdict = F.when(F.col("previous").isNull(), "no_history").when(F.col("previous") == 0, "ok").when(change > threshold, "anomaly").otherwise("ok")
    return runs.withColumn("previous", previous).withColumn("verdict", verdict)


def z_fold(runs: DataFrame, order: str, value: str, by: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """The fold of ``z_update`` over the runs of each key, on the JVM: key, ``order``, ``value``, ``verdict``.

    A verdict depends on which earlier values were taken in, so no window function can give it; the runs of a key
    are folded in order inside one row.
    """
    zero = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("verdicts"))

    def step(s, x):
        deviation = F.sqrt(s["var"])
        verdict = F.when(s["n"] < 2, "no_history").when(deviation <= FLAT, "ok").when(F.abs(x["v"] - s["mean"]) / deviation > threshold, "anomaly").otherwise("ok")
        n = s["n"] + 1
        mean = s["mean"] + (x["v"] - s["mean"]) / n
        var = (s["var"] * s["n"] + (x["v"] - s["mean"]) * (x["v"] - mean)) / n
        out = verdict == "anomaly"
        return F.struct(
            F.when(out, s["mean"]).otherwise(mean).alias("mean"), F.when(out, s["var"]).otherwise(var).alias("var"),
            F.when(out, s["n"]).otherwise(n).alias("n"), F.array_append(s["verdicts"], verdict).alias("verdicts"),
        )

    listed = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col(value).cast("double").alias("v")))).alias("runs"))
    folded = listed.withColumn("verdicts", F.aggregate("runs", zero, step)["verdicts"])
    pairs = folded.select(*by, F.explode(F.arrays_zip("runs", "verdicts")).alias("z"))
    return pairs.select(*by, F.col("z.runs.t").alias(order), F.col("z.runs.v").alias(value), F.col("z.verdicts").alias("verdict"))


def averages(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The averages of all columns in one pass; null ones are left out."""
    row = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in columns]).first() if columns else {}
    return {c: row[c] for c in columns if row[c] is not None}
