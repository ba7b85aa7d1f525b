"""Streams: masking and testing each micro-batch, and z-scores with state kept by the stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palisade.operators import anomaly, quality
from palisade.plans import policy


def write_guarded(stream: DataFrame, path: str, checkpoint: str, policies: policy.PolicySet, tests: dict[str, Sequence[str]] | None = None, warn: Callable[[str], None] = lambda m: None) -> StreamingQuery:
    """Mask every micro-batch, test it, and write it under its number; a failing test stops the query.

    A batch that runs again replaces what it wrote, so a restart neither loses nor repeats rows.
    """

    def batch(df: DataFrame, number: int) -> None:
        masked = policy.mask(df, policies)
        if tests:
            quality.run_tests(masked, tests, warn)
        masked.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def z_scores(stream: DataFrame, key: str, time: str, value: str, threshold: float = 3.0) -> DataFrame:
    """The verdicts of ``z_update`` over a stream, with each key's mean, variance and count as its state.

    Within a micro-batch the rows of a key are taken in the order of ``time``.
    """

    def step(keys: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        now = anomaly.MetricState(*state.get) if state.exists else anomaly.MetricState()
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        verdicts = []
        for x in rows[value].tolist():
            verdict, now = anomaly.z_update(float(x), now, threshold)
            verdicts.append(verdict)
        state.update((now.mean, now.variance, now.count))
        yield pd.DataFrame({"key": str(keys[0]), "time": rows[time].astype(str), "value": rows[value].astype(float), "verdict": verdicts})

    return stream.groupBy(key).applyInPandasWithState(step, "key string, time string, value double, verdict string", "mean double, variance double, count long", "append", "NoTimeout")
