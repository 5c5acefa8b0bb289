"""Labels and display formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions.values import (
    ASSISTANT_FALLBACK,
    ASSISTANT_RULES,
    CONDITION_FALLBACK,
    CONDITION_RULES,
)

DAY_MS = 86_400_000

Rules = Sequence[tuple[str, Sequence[str]]]


def keyword_label(text: Column, rules: Rules, default: str, ignore_case: bool = True) -> Column:
    """Label of the first rule one of whose keywords occurs in the text.

    Keywords match inside words as well. NULL text gets the default.
    """
    subject = F.lower(text) if ignore_case else text
    label = None
    for name, keywords in rules:
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | F.contains(subject, F.lit(keyword))
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return F.lit(default) if label is None else label.otherwise(default)


def intent(text: Column) -> Column:
    """Topic of a message to the assistant."""
    return keyword_label(text, ASSISTANT_RULES, ASSISTANT_FALLBACK)


def condition_class(text: Column) -> Column:
    """Icon of a weather condition; upper and lower case differ."""
    return keyword_label(text, CONDITION_RULES, CONDITION_FALLBACK, ignore_case=False)


def speaker(kind: Column, assistant: str = "Assistant") -> Column:
    """Who says a message of the given type."""
    return F.when(kind == "user", "You").when(kind == "error", "Error").otherwise(assistant)


def days_left(deadline: Column, now: Column) -> Column:
    """Whole days from ``now`` to midnight UTC of the deadline (a date or ISO text), rounded up."""
    due = F.unix_date(deadline.try_cast("date")).cast("long") * DAY_MS
    return F.ceil((due - F.unix_millis(now)) / F.lit(float(DAY_MS)))


def deadline_label(days: Column) -> Column:
    return F.when(days > 0, F.concat(days.cast("string"), F.lit(" days left"))).otherwise("Expired")


def urgency(days: Column) -> Column:
    """``urgent`` below seven days, passed deadlines included."""
    return F.when(days < 7, "urgent").otherwise("normal")


def trend_direction(trend: Column) -> Column:
    """Anything but ``up`` counts as down."""
    return F.when(trend == "up", "up").otherwise("down")


def growth_direction(growth: Column) -> Column:
    """Growth above zero is up; zero is down."""
    return F.when(growth > 0, "up").otherwise("down")


def percent_text(change: Column) -> Column:
    return F.concat(change.cast("string"), F.lit("%"))


def thousands(amount: Column) -> Column:
    """Number with comma groups and at most three decimals."""
    return F.call_function("format_number", amount, F.lit("#,##0.###"))


def short_time(moment: Column) -> Column:
    return F.date_format(moment, "HH:mm")


def short_date(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")
