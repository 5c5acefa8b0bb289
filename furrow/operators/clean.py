"""Cleaning: missing cells, types, fills, duplicates, white space."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions import text as X
from furrow.functions.values import MISSING_TOKENS
from furrow.operators import ordered
from furrow.operators.columns import FRACTIONS, is_missing, named, number, of_type


def _chosen(df: DataFrame, columns: Sequence[str] | str) -> list[str]:
    return df.columns if columns == "*" else list(columns)


def blank_to_null(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """NULL for text cells that stand for a missing value, and for NaN."""
    changes = {c: X.missing_to_null(named(c), tokens) for c in of_type(df, T.StringType)}
    changes |= {c: F.nanvl(named(c), F.lit(None)) for c in of_type(df, *FRACTIONS)}
    return df.withColumns(changes) if changes else df


def drop_blank_rows(df: DataFrame, columns: Sequence[str] | str = "*") -> DataFrame:
    """Drop rows in which every one of the columns is missing."""
    return df.where(reduce(or_, [~is_missing(df, c) for c in _chosen(df, columns)]))


def rename_by_position(df: DataFrame, first: str = "Crop", prefix: str = "Year_") -> DataFrame:
    """New name for the first column, a prefix for all others."""
    return df.toDF(first, *[f"{prefix}{c}" for c in df.columns[1:]])


def trim_headers(df: DataFrame) -> DataFrame:
    """Column names without white space at their ends."""
    return df.toDF(*[c.strip() for c in df.columns])


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as double; what is not a number becomes NULL."""
    texts = of_type(df, T.StringType)
    return df.withColumns({c: X.to_number(named(c)) if c in texts else number(c) for c in columns})


def forward_fill(
    df: DataFrame,
    columns: Sequence[str] | str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Replace missing cells by the last value before them; ``"*"`` fills every column.

    Cells before the first value stay missing. ``options`` go to
    :func:`furrow.operators.ordered.along`.
    """
    fixed = {*order_by, *partition_by}
    names = [c for c in _chosen(df, columns) if c not in fixed]
    filled = ordered.along(
        df, partition_by, order_by, {f"__fill_{c}": ordered.last_known(c) for c in names}, **options
    )
    return filled.select(
        *[named(f"__fill_{c}").alias(c) if c in names else named(c) for c in df.columns]
    )


def mean_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace missing cells by the mean of their column; a column without values stays missing."""
    places = {c: f"m{i}" for i, c in enumerate(columns)}
    means = df.agg(F.struct(*[F.avg(number(c)).alias(place) for c, place in places.items()]).alias("m")).scalar()
    filled = {c: F.coalesce(number(c), F.col("__means")[place]) for c, place in places.items()}
    return df.withColumn("__means", means).withColumns(filled).drop("__means")


def drop_duplicate_rows(df: DataFrame, trim_first: bool = False) -> DataFrame:
    """One of each set of equal rows, NULLs counting as equal.

    Text that differs in white space alone counts as different unless ``trim_first``.
    """
    return (strip_text(df) if trim_first else df).dropDuplicates()


def strip_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns without white space at both ends."""
    names = of_type(df, T.StringType) if columns is None else columns
    return df.withColumns({c: X.strip(named(c)) for c in names}) if names else df


def keep_with_text(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is not blank."""
    return df.where(X.has_text(named(column)))
