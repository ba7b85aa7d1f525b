"""What a row shows that violates a rule: one boolean expression each, so that many rules share one pass over a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def above(column: Column, limit: float) -> Column:
    return column > limit


def below(column: Column, limit: float) -> Column:
    return column < limit


def not_among(column: Column, values: Sequence) -> Column:
    return ~column.isin(list(values))


def unlike(column: Column, pattern: str) -> Column:
    return ~column.rlike(pattern)


def no_date(column: Column) -> Column:
    return column.isNotNull() & column.cast("string").try_cast("date").isNull()


def outside(column: Column, first: str, last: str) -> Column:
    return ~column.cast("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def any_null(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns])


# Embeddings. All sums are made in double precision.


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def other_dimension(vector: Column, dims: int) -> Column:
    return F.size(vector) != dims


def not_unit(vector: Column, epsilon: float) -> Column:
    return F.abs(norm(vector) - 1) > epsilon


def has_nan(vector: Column) -> Column:
    return F.exists(vector, F.isnan)


def has_null(vector: Column) -> Column:
    return vector.isNull() | F.exists(vector, lambda x: x.isNull())


def all_zero(vector: Column) -> Column:
    return F.forall(vector, lambda x: x == 0)


def beyond(vector: Column, low: float, high: float) -> Column:
    return (F.array_min(vector) < low) | (F.array_max(vector) > high)


def sparse(vector: Column, most: float) -> Column:
    """A share of zeros above ``most``."""
    return F.size(F.filter(vector, lambda x: x == 0)) / F.size(vector) > most


def unlike_vector(vector: Column, reference: Sequence[float], least: float) -> Column:
    return cosine(vector, F.array(*[F.lit(float(x)) for x in reference])) < least
