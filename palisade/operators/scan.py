"""Scans for personal data: lint of unflagged columns, pattern scan, and the guard that decides what a finding means."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ACTIONS = ("block", "warn", "mask", "ignore")
SEVERITIES = ("low", "medium", "high", "critical")

EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
CREDIT_CARD = r"\b(?:\d[ -]*?){13,16}\b"


class GovernanceError(RuntimeError):
    """Personal data where there must be none."""


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    severity: str = "medium"
    action: str = "warn"
    strategy: str = "redact"

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES or self.action not in ACTIONS:
            raise ValueError(f"bad severity or action in pattern {self.name!r}")
        re.compile(self.regex)


DEFAULT_PATTERNS = (
    Pattern("email", EMAIL, "high", "mask"),
    Pattern("phone", r"\+33[1-9][0-9]{8}", "medium", "mask"),
    Pattern("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "critical", "block"),
    Pattern("credit_card", CREDIT_CARD, "critical", "block"),
)


@dataclass(frozen=True)
class Violation:
    rule: str
    severity: str
    action: str
    matched: str


def scan_text(text: str, patterns: Sequence[Pattern] = DEFAULT_PATTERNS, enabled: bool = True) -> list[Violation]:
    """The first match of each pattern in one text."""
    if not enabled:
        return []
    return [Violation(p.name, p.severity, p.action, m[0]) for p in patterns if (m := re.search(p.regex, text))]


def scan(df: DataFrame, column: str, patterns: Sequence[Pattern] = DEFAULT_PATTERNS, keep: Sequence[str] = ()) -> DataFrame:
    """The first match of each pattern in each row: the kept columns, ``rule``, ``severity``, ``action``, ``matched``."""
    hits = [F.struct(F.lit(p.name).alias("rule"), F.lit(p.severity).alias("severity"), F.lit(p.action).alias("action"), F.regexp_extract(column, p.regex, 0).alias("matched")) for p in patterns]
    found = F.filter(F.array(*hits), lambda h: h["matched"] != "")
    return df.where(F.col(column).isNotNull()).select(*keep, F.explode(found).alias("hit")).select(*keep, "hit.*")


def mask_matches(df: DataFrame, columns: Sequence[str], patterns: Sequence[Pattern]) -> DataFrame:
    """Replace in text columns what patterns with the action mask match: by a tag, or with the strategy ``entity_preserving`` by one with its length."""
    out = {}
    for name in columns:
        column = F.col(f"`{name}`")
        for p in patterns:
            if p.action == "mask":
                first = F.regexp_extract(column, p.regex, 0)
                # Matches of one text get the tag of the first; its length is all that the tag tells.
                tag = F.concat(F.lit("[PRESERVED_"), F.char_length(first), F.lit("]")) if p.strategy == "entity_preserving" else F.lit("[REDACTED]")
                column = F.when(first != "", F.regexp_replace(column, F.lit(p.regex), tag)).otherwise(column)
        out[name] = column
    return df.withColumns(out) if out else df


def audit(violations: Iterable[Violation], strict: bool, context: str = "") -> list[str]:
    """Warnings for what was found; in strict mode a finding to block raises."""
    messages = []
    for v in violations:
        if v.action == "ignore":
            continue
        if v.action == "block" and strict:
            raise GovernanceError(f"{context}: {v.rule} blocked")
        messages.append(f"{context}: {v.rule} ({v.severity}, {v.action})")
    return messages


def decide(hits: DataFrame, strict: bool) -> DataFrame:
    """The same decision for a scanned table: ``rule``, ``severity``, ``action``, ``n`` and what becomes of them."""
    verdict = F.when((F.col("action") == "block") & F.lit(strict), "error").when(F.col("action") == "ignore", "ignored").otherwise("warning")
    return hits.groupBy("rule", "severity", "action").agg(F.count("*").alias("n")).withColumn("verdict", verdict)


def check_boundary(level: str, violations: Iterable[Violation]) -> None:
    """Public and internal data must hold nothing of high or critical severity."""
    if level in ("public", "internal") and any(v.severity in ("high", "critical") for v in violations):
        raise GovernanceError(f"severe findings in {level} data")


def lint(df: DataFrame, flagged: Iterable[str], sample_rows: int = 500) -> list[str]:
    """Unflagged text columns in which the first rows show e-mail addresses or card numbers; one aggregate over the sample."""
    skip = set(flagged)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in skip]
    if not texts:
        return []
    row = df.limit(sample_rows).agg(*[F.max(F.col(f"`{c}`").rlike(EMAIL) | F.col(f"`{c}`").rlike(CREDIT_CARD)).alias(c) for c in texts]).first()
    return [c for c in texts if row[c]]
