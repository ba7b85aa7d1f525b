"""Governance values and the masking of a model at its boundary."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import masks

MASKING = ("hash", "redact", "nullify", "partial", "mask_email", "entity_preserving")
POLICIES = (*MASKING, "encryption", "drop")
LIFECYCLE = ("provisioning", "active", "deprecated", "erased")
EMPTY_COLUMN = "_all_dropped"


class SecurityLevel(IntEnum):
    PUBLIC = 0
    INTERNAL = 1
    CONFIDENTIAL = 2
    RESTRICTED = 3

    @classmethod
    def parse(cls, text: str | None, default: SecurityLevel | None = None) -> SecurityLevel:
        if text is None:
            return cls.INTERNAL if default is None else default
        try:
            return cls[text.strip().upper()]
        except KeyError:
            raise ValueError(f"unknown security level {text!r}") from None

    def __str__(self) -> str:
        return self.name.lower()


def parse_policy(text: str) -> str:
    """A policy's name; a misspelled one is an error, never silently no policy."""
    name = text.strip().lower()
    if name not in POLICIES:
        raise ValueError(f"unknown policy {text!r}")
    return name


def can_transition(before: str, after: str) -> bool:
    """A lifecycle goes forward by one step or stays."""
    return 0 <= LIFECYCLE.index(after) - LIFECYCLE.index(before) <= 1


class PolicySet:
    """Column policies by lower-case name."""

    def __init__(self, policies: Mapping[str, str] | None = None) -> None:
        self._by_name = {k.lower(): parse_policy(v) for k, v in (policies or {}).items()}

    @classmethod
    def from_pairs(cls, pairs: Iterable[tuple[str, str]]) -> PolicySet:
        """Of several policies of one column the last counts."""
        return cls(dict((k.lower(), v) for k, v in pairs))

    def get(self, column: str) -> str | None:
        return self._by_name.get(column.lower())

    def __len__(self) -> int:
        return len(self._by_name)

    def is_masked(self, column: str) -> bool:
        """Whether a masking policy applies; encryption and drop are none."""
        return self.get(column) in MASKING


def fuzzy_policy(column: str, patterns: Iterable[tuple[str, str]]) -> str | None:
    """The policy of the first pattern found in the column's name, unless the name says that it is masked already."""
    if column.lower().endswith(("_pii", "_masked", "_hash")):
        return None
    return next((parse_policy(policy) for pattern, policy in patterns if re.search(pattern, column)), None)


def mask(df: DataFrame, policies: PolicySet, salt: str | None = None) -> DataFrame:
    """Mask every column that has a policy, exactly once; without policies ``df`` comes back as it is.

    Columns without a policy stay, documented or not. If all columns are dropped, a frame of one column and no rows is left.
    """
    if not len(policies) or not any(policies.get(c) for c in df.columns):
        return df
    out = []
    for name in df.columns:
        policy, column = policies.get(name), F.col(f"`{name}`")
        if policy == "drop":
            continue
        if policy in ("hash", "encryption") and salt is not None:
            column = masks.hashed(column, salt)
        elif policy is not None:
            column = masks.apply(policy, column)
        out.append(column.alias(name))
    if not out:
        return df.select(F.lit(1).alias(EMPTY_COLUMN)).limit(0)
    return df.select(out)


def combined(models: Mapping[str, Mapping[str, str]]) -> PolicySet:
    """One policy set over all models; of conflicting policies that of the model that comes last by name counts."""
    return PolicySet.from_pairs((c, p) for name in sorted(models) for c, p in models[name].items())
