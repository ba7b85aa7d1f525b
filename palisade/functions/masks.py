"""Column masks. All are built-in expressions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "REDACTED"


def hashed(column: Column, salt: str | None = None) -> Column:
    """SHA-256 in hex of the text form. Null stays null, but with a salt gives the hash of the salt."""
    text = column.cast("string")
    return F.sha2(text if salt is None else F.concat_ws("", text, F.lit(salt)), 256)


def redact(column: Column) -> Column:
    """A constant, for nulls too."""
    return F.lit(REDACTED)


def nullify(column: Column) -> Column:
    return F.lit(None).cast("string")


def partial(column: Column) -> Column:
    """The first two characters and three stars; null gives the stars."""
    return F.concat_ws("", F.left(column.cast("string"), F.lit(2)), F.lit("***"))


def mask_email(column: Column) -> Column:
    """The first character, four stars, and all from the last ``@`` on; a text without ``@`` is left as it is."""
    return F.regexp_replace(column.cast("string"), r"(?d)(^.).*(@.*\z)", "$1****$2")


def entity_preserving(column: Column) -> Column:
    """The length of the text in a tag; null gives a tag without a length."""
    return F.concat_ws("", F.lit("[PRESERVED_"), F.char_length(column.cast("string")).cast("string"), F.lit("]"))


def encrypt(column: Column) -> Column:
    """A stand-in for encryption: the hash."""
    return hashed(column)


#: Every mask that turns one column into another; ``drop`` removes the column and is handled where rows are selected.
MASKS: dict[str, Callable[[Column], Column]] = {
    "hash": hashed,
    "redact": redact,
    "nullify": nullify,
    "partial": partial,
    "mask_email": mask_email,
    "entity_preserving": entity_preserving,
    "encryption": encrypt,
}


def apply(strategy: str, column: Column) -> Column:
    if strategy not in MASKS:
        raise ValueError(f"unknown mask {strategy!r}")
    return MASKS[strategy](column)
