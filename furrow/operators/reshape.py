"""Wide and long tables, nested records, row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators import ordered
from furrow.operators.columns import named


def melt(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str] | None = None,
    variable: str = "variable",
    value: str = "value",
) -> DataFrame:
    """One row per id and value column; missing cells keep their row."""
    columns = [c for c in df.columns if c not in ids] if values is None else list(values)
    return df.unpivot([named(c) for c in ids], [named(c) for c in columns], variable, value)


def remove_text(df: DataFrame, column: str, part: str) -> DataFrame:
    """Take every occurrence of a literal text out of a column."""
    return df.withColumn(column, F.replace(F.col(column), F.lit(part), F.lit("")))


def split_measure(df: DataFrame, column: str = "variable") -> DataFrame:
    """``"<measure> <period>"`` labels as two columns, cut at the last space."""
    label = F.rtrim(F.col(column))
    return df.select(
        *[c for c in df.columns if c != column],
        F.regexp_extract(label, r"^(.*\S)\s+(\S+)$", 1).alias("measure"),
        F.substring_index(label, " ", -1).alias("period"),
    )


def spread(df: DataFrame, ids: Sequence[str], names: str, values: str, wanted: Sequence[str]) -> DataFrame:
    """One column per wanted name; the list saves Spark a job to find the names.

    A cell with more than one row fails the job: which value is meant is for the caller to say, by another id column.
    """
    repeated = F.raise_error(F.concat(F.lit("several rows for one cell of "), F.max(named(names).cast("string"))))
    cell = F.when(F.count(F.lit(1)) <= 1, F.max(values)).otherwise(repeated.cast(df.schema[values].dataType))
    return df.groupBy(*ids).pivot(names, list(wanted)).agg(cell)


def sort_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.orderBy(*columns)


def row_index(df: DataFrame, order_by: Sequence[str], name: str = "index", **options) -> DataFrame:
    """Number the rows from 0 along an order without ties."""
    numbered = ordered.along(
        df.withColumn("__one", F.lit(1).cast("long")), [], order_by,
        {name: ordered.running_sum("__one")}, **options,
    )
    return numbered.drop("__one").withColumn(name, F.col(name) - 1)


def explode_records(df: DataFrame, keep: Sequence[str | Column], array: str, position: str = "pos") -> DataFrame:
    """One row per element of an array of records, with its position and fields."""
    return df.select(*keep, F.posexplode(array).alias(position, "__record")).select(
        "*", "__record.*"
    ).drop("__record")
