"""Quality rules of a project's configuration, run on the models they bear on.

A rule bears on every model that has the columns it names, or on those that its ``model`` or ``models`` lists. Rules about
single rows become one aggregate each, and all of a model's share one pass with its data tests; the others are jobs of
their own. A rule that lacks a parameter or names what isn't there is reported, never passed over in silence.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators import predicates, quality

_SUM = re.compile(r"^\s*(<=|>=|==|<|>|=)?\s*(-?[\d.]+)\s*$")
_HOLDS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq, "==": operator.eq, None: operator.eq}


class RuleError(ValueError):
    """A rule that can't be run."""


@dataclass
class Context:
    """What a rule may need beside its table: other relations by name, the columns that identify a row, and columns' names."""

    lookup: Callable[[str], DataFrame | None]
    keys: Sequence[str]


def _sum_violated(rule: Mapping) -> Column:
    m = _SUM.match(str(rule["expected_sum"]))
    if not m:
        raise RuleError(f"expected_sum {rule['expected_sum']!r} is no comparison")
    return ~_HOLDS[m[1]](predicates.total([F.col(c) for c in rule["columns"]]), float(m[2]))


def _vector(rule: Mapping) -> Column:
    return F.col(rule.get("column", "embedding"))


def _dimension_violated(rule: Mapping) -> Column:
    wrong = predicates.other_dimension(_vector(rule), rule["expected_dimensions"])
    return wrong | predicates.not_unit(_vector(rule), rule.get("epsilon", 1e-3)) if rule.get("check_normalization") else wrong


def _reference(rule: Mapping) -> list[float]:
    given = rule["reference_embeddings"]
    if not given or not all(isinstance(x, (int, float)) for x in given):
        raise RuleError("reference_embeddings must be the numbers of one vector")
    return given


#: Rules about single rows: the expression that a violating row makes true.
ROW: dict[str, Callable[[Mapping, Context], Column]] = {
    "no_null_primary_keys": lambda r, c: predicates.any_null([F.col(f"`{k}`") for k in c.keys]),
    "not_null_columns": lambda r, c: predicates.any_null([F.col(k) for k in r["columns"]]),
    "max_value": lambda r, c: predicates.above(F.col(r["column"]), r["max_value"]),
    "min_value": lambda r, c: predicates.below(F.col(r["column"]), r["min_value"]),
    "accepted_values": lambda r, c: predicates.not_among(F.col(r["column"]), r["values"]),
    "regex_match": lambda r, c: predicates.unlike(F.col(r["column"]), r["pattern"]),
    "date_validity": lambda r, c: predicates.no_date(F.col(r["column"])),
    "date_range": lambda r, c: predicates.outside(F.col(r["column"]), str(r["min_date"]), str(r["max_date"])),
    "sum_check": lambda r, c: _sum_violated(r),
    "embedding_dimension_check": lambda r, c: _dimension_violated(r),
    "embedding_normalization_check": lambda r, c: predicates.not_unit(_vector(r), r.get("epsilon", 1e-3)),
    "embedding_nan_check": lambda r, c: predicates.has_nan(_vector(r)),
    "embedding_null_check": lambda r, c: predicates.has_null(_vector(r)),
    "embedding_zero_vector_check": lambda r, c: predicates.all_zero(_vector(r)),
    "embedding_range_check": lambda r, c: predicates.beyond(_vector(r), r["min_value"], r["max_value"]),
    "embedding_sparsity_check": lambda r, c: predicates.sparse(_vector(r), r["sparsity_threshold"]),
    "embedding_similarity_check": lambda r, c: predicates.unlike_vector(_vector(r), _reference(r), r["similarity_threshold"]),
}


def _relation(rule: Mapping, context: Context, name: str) -> DataFrame:
    found = context.lookup(name)
    if found is None:
        raise RuleError(f"no relation {name!r}")
    return found


def _key(rule: Mapping, context: Context) -> str:
    key = rule.get("key") or next(iter(context.keys), None)
    if key is None:
        raise RuleError("a key is needed: name one, or test a column of the model for uniqueness")
    return key


def _distribution(df: DataFrame, rule: Mapping) -> DataFrame:
    """Dimensions whose mean or deviation lies further than ``tolerance`` (0.1) from what is expected."""
    off = lambda c, x: F.abs(F.col(c) - float(x)) > float(rule.get("tolerance", 0.1))
    return quality.embedding_distribution(df, rule.get("column", "embedding")).where(off("mean", rule["mean"]) | off("deviation", rule["std_dev"]))


def _drift(df: DataFrame, rule: Mapping) -> DataFrame:
    """One row if the centroid of the rows after the period lies too far from that of the rows within it."""
    first, _, last = str(rule["reference_period"]).partition(" to ")
    day = F.col(rule["date_column"]).cast("date")
    before, after = df.where(day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))), df.where(day > F.lit(last).cast("date"))
    return quality.embedding_drift(before, after, rule.get("column", "embedding")).where(F.col("drift") > float(rule["drift_threshold"]))


def _consistency(df: DataFrame, rule: Mapping, context: Context) -> DataFrame:
    """Keys whose vectors differ too much from those of any of the reference models."""
    key, vector, out = _key(rule, context), rule.get("column", "embedding"), None
    for name in rule["reference_models"]:
        found = quality.embedding_consistency(df, _relation(rule, context, name), key, vector, float(rule["consistency_threshold"])).select(key)
        out = found if out is None else out.unionByName(found)
    return out


#: The other rules: a table of violations.
TABLE: dict[str, Callable[[DataFrame, Mapping, Context], DataFrame]] = {
    "referential_integrity": lambda df, r, c: quality.referential_integrity(df, r["column"], _relation(r, c, r["reference_table"]), r["reference_column"]),
    "surrogate_key_uniqueness": lambda df, r, c: quality.duplicates(df, [r["column"]]),
    "unique_ids": lambda df, r, c: quality.duplicates(df, [r["column"]]),
    "embedding_distribution_check": lambda df, r, c: _distribution(df, r),
    "embedding_consistency_check": _consistency,
    "embedding_drift_check": lambda df, r, c: _drift(df, r),
    "embedding_outlier_check": lambda df, r, c: quality.embedding_outliers(df, _key(r, c), r.get("column", "embedding"), r["outlier_threshold"]),
    "embedding_duplicates_check": lambda df, r, c: quality.embedding_duplicates(df, _key(r, c), r.get("column", "embedding"), r["duplicate_threshold"]),
    "embedding_uniqueness_check": lambda df, r, c: quality.embedding_uniqueness(df, r.get("column", "embedding")).where(F.col("ratio") < r["uniqueness_threshold"]),
    "embedding_completeness_check": lambda df, r, c: quality.embedding_completeness(df, r.get("column", "embedding")).where(F.col("ratio") < r["completeness_threshold"]),
}


def bears_on(rule: Mapping, model: str, columns: Sequence[str], keys: Sequence[str]) -> bool:
    """Whether a rule concerns a model: by its list of models if it has one, and by the columns it names."""
    models = rule.get("models") or ([rule["model"]] if "model" in rule else None)
    if models is not None:
        return model in models
    have = {c.lower() for c in columns}
    kind = rule.get("name", "")
    if kind == "no_null_primary_keys":
        return bool(keys)
    needed = [rule["column"]] if "column" in rule else list(rule.get("columns", []))
    if kind.startswith("embedding_") and not needed:
        needed = ["embedding"]
    return bool(needed) and all(c.lower() in have for c in needed)


def row_measures(rules: Sequence[Mapping], context: Context, report: Callable[[Mapping, str], None]) -> dict[int, Column]:
    """Of the rules about rows: the number of violations as an aggregate, by the rule's place."""
    out = {}
    for i, rule in enumerate(rules):
        make = ROW.get(rule.get("name"))
        if make is not None:
            try:
                out[i] = F.count_if(make(rule, context))
            except (KeyError, RuleError) as e:
                report(rule, f"can't be run: {e}")
        elif rule.get("name") not in TABLE:
            report(rule, "is unknown")
    return out


def table_violations(df: DataFrame, rules: Sequence[Mapping], context: Context, report: Callable[[Mapping, str], None]) -> dict[int, int]:
    """Of the other rules: the number of violations, by the rule's place; a job for each."""
    out = {}
    for i, rule in enumerate(rules):
        make = TABLE.get(rule.get("name"))
        if make is not None:
            try:
                out[i] = make(df, rule, context).count()
            except (KeyError, RuleError) as e:
                report(rule, f"can't be run: {e}")
    return out
