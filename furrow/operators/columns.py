"""Columns of a table by name, whatever characters a raw header holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRACTIONS = (T.DoubleType, T.FloatType)


def named(name: str) -> Column:
    """The column of exactly this name; dots and back-ticks are part of it."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str) -> Column:
    """The column as double, NaN as NULL."""
    return F.nanvl(named(name).cast("double"), F.lit(None))


def is_missing(df: DataFrame, name: str) -> Column:
    """True for NULL, and for NaN in a column of fractions."""
    value = named(name)
    if isinstance(df.schema[name].dataType, FRACTIONS):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def of_type(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]
