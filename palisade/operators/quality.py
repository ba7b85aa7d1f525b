"""Data tests: each rule returns its violations as a DataFrame; ``run_tests`` fuses what can share one pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from palisade.operators import predicates
from palisade.operators.predicates import cosine, doubles, norm


class DataTestError(RuntimeError):
    """A data test found violations."""


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: for each column the number of nulls, all in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number. Null is a key like any other."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def referential_integrity(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent; null keys are no violation."""
    parents = parent.select(F.col(parent_key).alias("__key"))
    return child.where(F.col(key).isNotNull()).join(parents, F.col(key) == F.col("__key"), "left_anti")


def max_value(df: DataFrame, column: str, limit: float) -> DataFrame:
    return df.where(predicates.above(F.col(column), limit))


def min_value(df: DataFrame, column: str, limit: float) -> DataFrame:
    return df.where(predicates.below(F.col(column), limit))


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(predicates.not_among(F.col(column), values))


def regex_match(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(predicates.unlike(F.col(column), pattern))


def date_validity(df: DataFrame, column: str) -> DataFrame:
    """Texts that are no date."""
    return df.where(predicates.no_date(F.col(column)))


def date_range(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    return df.where(predicates.outside(F.col(column), first, last))


def sum_check(df: DataFrame, columns: Sequence[str], limit: float) -> DataFrame:
    """Rows whose columns sum up to more than ``limit``."""
    return df.where(predicates.above(predicates.total([F.col(c) for c in columns]), limit))


def embedding_dimension(df: DataFrame, vector: str, dims: int) -> DataFrame:
    return df.where(predicates.other_dimension(F.col(vector), dims))


def embedding_normalization(df: DataFrame, vector: str, epsilon: float = 1e-3) -> DataFrame:
    return df.where(predicates.not_unit(F.col(vector), epsilon))


def embedding_nan(df: DataFrame, vector: str) -> DataFrame:
    return df.where(predicates.has_nan(F.col(vector)))


def embedding_null(df: DataFrame, vector: str) -> DataFrame:
    return df.where(predicates.has_null(F.col(vector)))


def embedding_zero_vector(df: DataFrame, vector: str) -> DataFrame:
    return df.where(predicates.all_zero(F.col(vector)))


def embedding_range(df: DataFrame, vector: str, low: float, high: float) -> DataFrame:
    return df.where(predicates.beyond(F.col(vector), low, high))


def embedding_sparsity(df: DataFrame, vector: str, most: float) -> DataFrame:
    """Vectors with a share of zeros above ``most``."""
    return df.where(predicates.sparse(F.col(vector), most))


def embedding_distribution(df: DataFrame, vector: str) -> DataFrame:
    """Mean and deviation of each dimension."""
    long = df.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))


def centroid(df: DataFrame, vector: str) -> DataFrame:
    """One row: the mean vector."""
    means = embedding_distribution(df, vector)
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("centroid"))


def embedding_similarity(df: DataFrame, vector: str, reference: Sequence[float], least: float) -> DataFrame:
    """Vectors whose cosine with the reference is below ``least``."""
    return df.where(predicates.unlike_vector(F.col(vector), reference, least))


def embedding_consistency(a: DataFrame, b: DataFrame, key: str, vector: str, least: float, digits: int | None = None) -> DataFrame:
    """Keys whose vectors in two tables have a cosine below ``least``, after rounding to ``digits`` if they are given."""
    joined = a.select(key, F.col(vector).alias("__a")).join(b.select(key, F.col(vector).alias("__b")), key)
    value = cosine(F.col("__a"), F.col("__b"))
    return joined.select(key, (value if digits is None else F.round(value, digits)).alias("cosine")).where(F.col("cosine") < least)


def embedding_drift(before: DataFrame, after: DataFrame, vector: str) -> DataFrame:
    """One row: the Euclidean distance of the centroids."""
    pair = centroid(before, vector).withColumnRenamed("centroid", "a").crossJoin(centroid(after, vector).withColumnRenamed("centroid", "b"))
    return pair.select(norm(F.zip_with("a", "b", lambda x, y: x - y)).alias("drift"))


def embedding_outliers(df: DataFrame, key: str, vector: str, threshold: float = 3.0) -> DataFrame:
    """Vectors whose distance to the centroid lies more than ``threshold`` deviations above the mean distance."""
    middle = centroid(df, vector)
    distances = df.crossJoin(middle).select(key, norm(F.zip_with(doubles(F.col(vector)), "centroid", lambda x, y: x - y)).alias("distance"))
    spread = distances.agg(F.avg("distance").alias("m"), F.stddev_pop("distance").alias("s"))
    return distances.crossJoin(spread).where("s > 0").select(key, ((F.col("distance") - F.col("m")) / F.col("s")).alias("z")).where(F.col("z") > threshold)


def _near_pairs(least: float):
    def run(table: pa.Table) -> pa.Table:
        """Pairs of one block, or between two: near ones by a matrix product, then their cosines summed as ``cosine`` does."""
        ids, (p, q) = table.column("id").combine_chunks(), (table.column(c)[0].as_py() for c in ("p", "q"))
        block = table.column("block").to_numpy()
        data = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1)

        def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            total = np.zeros(len(x))
            for i in range(data.shape[1]):
                total += data[x, i] * data[y, i]
            return total

        with np.errstate(all="ignore"):
            every = np.arange(len(data))
            norms = np.sqrt(dots(every, every))
            rows, others = np.nonzero((block == p) & (norms != 0))[0], np.nonzero((block == q) & (norms != 0))[0]
            unit = data / norms[:, None]
            right, found = unit[others].T, []
            for low in range(0, len(rows), 256):
                part = rows[low : low + 256]
                # Bounds have a slack for rounding; NaN isn't below any, as in Spark's order.
                x, y = np.nonzero(~(unit[part] @ right < least - 1e-9))
                x, y = part[x], others[y]
                if p == q:
                    x, y = x[x < y], y[x < y]
                for first in range(0, len(x), 1_000_000):
                    a, b = x[first : first + 1_000_000], y[first : first + 1_000_000]
                    c = dots(a, b) / (norms[a] * norms[b])
                    kept = ~(c < least)
                    found.append((a[kept], b[kept], c[kept]))
        x, y, c = (np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(c)], names=["a", "b", "cosine"])

    return run


def embedding_duplicates(df: DataFrame, key: str, vector: str, least: float, within: Sequence[str] = (), block_rows: int = 8192) -> DataFrame:
    """Pairs of keys whose vectors have a cosine of at least ``least``, within equal values of the columns ``within``.

    All pairs are compared, of each group where ``within`` is given, by matrix products of blocks of about ``block_rows``
    rows. Pairs without a cosine are none: null or empty vectors, ones with nulls, of norm 0, or of different lengths.
    """
    named = [f"__w{i}" for i in range(len(within))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(within, named, strict=True)], F.col(key).alias("id"), doubles(F.col(vector)).alias("v"))
    rows = rows.where(reduce(lambda a, n: a & F.col(n).isNotNull(), named, F.col("id").isNotNull()) & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()))
    many = max(1, -(-df.count() // block_rows))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(many)).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda o: F.struct(F.least("block", o).alias("p"), F.greatest("block", o).alias("q"))))
    met = placed.select("*", F.size("v").alias("dims"), pair.alias("pair")).select(*named, "dims", "pair.*", "block", "id", "v")
    kind = rows.schema["id"].dataType
    out = StructType([StructField("a", kind), StructField("b", kind), StructField("cosine", DoubleType())])
    pairs = met.groupBy(*named, "dims", "p", "q").applyInArrow(_near_pairs(least), out)
    return pairs.where("a <> b").select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "cosine")


def embedding_uniqueness(df: DataFrame, vector: str) -> DataFrame:
    """One row: the share of distinct vectors."""
    return df.agg((F.count_distinct(vector) / F.count(vector)).alias("ratio"))


def embedding_completeness(df: DataFrame, vector: str) -> DataFrame:
    """One row: the share of vectors that aren't null."""
    return df.agg((F.count(vector) / F.count("*")).alias("ratio"))


def undocumented(df: DataFrame, documented: Sequence[str]) -> list[str]:
    """Columns that a contract doesn't list, whatever their case."""
    known = {c.lower() for c in documented}
    return sorted(c for c in df.columns if c.lower() not in known)


def measure(df: DataFrame, measures: Mapping[str, Column], unique: Sequence[str] = ()) -> dict[str, object]:
    """Named aggregates of a table in one pass, whatever the names; of each column of ``unique`` the number of repeated keys.

    All are one query, so that they run side by side and what a view shuffles for one serves the others.
    """
    asked = [df.agg(*[column.alias(f"m{i}") for i, column in enumerate(measures.values())])] if measures else []
    asked += [duplicates(df, [f"`{c}`"]).agg(F.count("*").alias(f"u{i}")) for i, c in enumerate(unique)]
    row = reduce(lambda a, b: a.crossJoin(b), asked).first() if asked else ()
    return dict(zip([*measures, *[f"repeated {c}" for c in unique]], row, strict=True))


def test_measures(tests: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """The aggregates that ``run_tests`` needs: the row count and the nulls of each column tested for them."""
    return {"rows": F.count("*")} | {f"null {c}": F.count_if(F.col(f"`{c}`").isNull()) for c, names in tests.items() if "not_null" in names}


def test_keys(tests: Mapping[str, Sequence[str]]) -> list[str]:
    """The columns that ``run_tests`` tests for uniqueness."""
    return [c for c, names in tests.items() if "unique" in names]


test_measures.__test__ = test_keys.__test__ = False


def run_tests(df: DataFrame, tests: Mapping[str, Sequence[str]], warn: Callable[[str], None] = lambda message: None, measured: Mapping[str, object] | None = None) -> int:
    """Run the named tests of each column in order and raise at the first that fails; returns the number of rows.

    Null counts, repeated keys and the row count come from one query, or from ``measured`` if they were made with others.
    An unknown test is warned of and passes.
    """
    measured = measure(df, test_measures(tests), test_keys(tests)) if measured is None else measured
    for column, names in tests.items():
        for name in names:
            if name == "not_null":
                if n := measured[f"null {column}"]:
                    raise DataTestError(f"Found {n} NULL values in {column}")
            elif name == "unique":
                if n := measured[f"repeated {column}"]:
                    raise DataTestError(f"Found {n} DUPLICATE values in {column}")
            else:
                warn(f"unknown test {name!r} on {column}")
    return measured["rows"]
