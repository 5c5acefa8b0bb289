"""Text repair and parsing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions.values import MISSING_TOKENS, STATE_PATTERNS, WHITE_SPACE

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"


def strip(text: Column) -> Column:
    """Text without white space at both ends: tabs, line ends and no-break spaces too."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def has_text(text: Column) -> Column:
    """True where something is left after :func:`strip`."""
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def missing_to_null(text: Column, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """NULL for cells that stand for a missing value."""
    return F.when(~text.isin(*tokens), text)


def to_number(text: Column) -> Column:
    """Double, or NULL where the text is not a plain number (``1,000``, ``1.0d``, ``NaN``)."""
    bare = strip(text)
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def normal_key(text: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Join key of a name: trimmed, lower case, single spaces, known aliases replaced."""
    key = F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " ")
    if not aliases:
        return key
    pairs = [F.lit(part) for item in aliases.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def search(columns: Sequence[Column], query: str) -> Column:
    """True where any column contains the query text, upper or lower case."""
    needle = query.lower()
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(F.contains(F.lower(column), F.lit(needle)), F.lit(False))
    return found


def duration_days(text: Column) -> Column:
    """``struct(min_days, max_days)`` from ``145-150`` or ``120``; NULL without digits."""
    days = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda d: d.try_cast("int"))
    return F.when(
        F.size(days) > 0,
        F.struct(F.array_min(days).alias("min_days"), F.array_max(days).alias("max_days")),
    )


def money_range(text: Column) -> Column:
    """``struct(low, high)`` from a text such as ``₹42,000 - ₹48,000``."""
    amounts = F.transform(
        F.regexp_extract_all(text, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), 1),
        lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("double"),
    )
    return F.when(
        F.size(amounts) > 0,
        F.struct(F.array_min(amounts).alias("low"), F.array_max(amounts).alias("high")),
    )


def zones(text: Column, patterns: Mapping[str, str] | None = None) -> Column:
    """Names whose pattern occurs in the text, as an array in the order of the patterns."""
    hits = [
        F.when(text.rlike(pattern), F.lit(name))
        for name, pattern in (patterns or STATE_PATTERNS).items()
    ]
    return F.array_compact(F.array(*hits))
