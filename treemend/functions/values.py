"""Text, number and hash expressions used by rules and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted number text, characters removed from keys, pad width.
NUMBER_PATTERN = r"^\s*[+-]?([0-9][0-9,]*(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
REMOVED_CHARACTERS = "_-#*.@~ \t\n\r"
PAD_WIDTH = 14


def to_number(text: Column) -> Column:
    """Double of a number text with optional thousands commas; null otherwise."""
    # text that is no number extracts as '', which does not cast; one mention of the text
    return F.regexp_replace(F.regexp_extract(text, NUMBER_PATTERN, 0), r"[,\s]", "").try_cast("double")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"\S")


def _strip(text: Column, chars: str) -> Column:
    # translate drops every listed character that has no counterpart
    return F.replace(F.translate(text, chars, ""), F.lit("&"), F.lit("AND"))


def normalize(text: Column, chars: str | None = None) -> Column:
    """Remove separators, spell out ``&``, upper-case."""
    return F.upper(_strip(text, chars or REMOVED_CHARACTERS))


def normalize14(text: Column) -> Column:
    """Remove separators, spell out ``&``, zero-pad on the right to 14; never cut."""
    bare = _strip(text, REMOVED_CHARACTERS)
    return F.when(F.length(bare) < PAD_WIDTH, F.rpad(bare, PAD_WIDTH, "0")).otherwise(bare)


def sha256_key(text: Column) -> Column:
    return F.sha2(text, 256)


def data_key(pairs: list[tuple[str, Column]]) -> Column:
    """``K1 = 'v1' AND K2 = 'v2'``."""
    parts = [F.concat(F.lit(f"{name} = '"), F.coalesce(value.cast("string"), F.lit("")), F.lit("'")) for name, value in pairs]
    return F.concat_ws(" AND ", *parts)


def lithology(value: Column) -> Column:
    """Rock class of a smoothed gamma-ray value."""
    # Half-open class limits.
    return (
        F.when((value >= 0) & (value < 10), "Salt")
        .when((value >= 10) & (value < 20), "Limestone")
        .when((value >= 20) & (value < 55), "Sandstone")
        .when((value >= 55) & (value < 150), "Shale")
        .otherwise("Unknown")
    )
