"""Reports on a table. All are DataFrames; names and types come from the schema alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.columns import is_missing, named, number
from furrow.operators.stats import SEARCH_FROM, quantile_columns


def column_names(df: DataFrame) -> list[str]:
    return df.columns


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def preview(df: DataFrame, order_by: Sequence[str | Column], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def columns_report(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Type, rows, missing cells and distinct values of each column.

    Approximate figures take one pass. Exact distinct values are counted column by column: several in one aggregate would send
    each row once per column, with all columns. So files are read once more, each time one column; store a computed table first.
    """
    names = list(columns or df.columns)
    types = dict(df.dtypes)
    figures = [F.count(F.lit(1)).alias("__rows")]
    records = []
    for i, name in enumerate(names):
        gone = is_missing(df, name)
        known = F.when(~gone, named(name))
        figures.append(F.count_if(gone).alias(f"__missing{i}"))
        if approximate:
            figures.append(F.approx_count_distinct(known).alias(f"__distinct{i}"))
            distinct = F.col(f"__distinct{i}")
        else:
            distinct = df.select(known.alias("v")).distinct().agg(F.count("v")).scalar()
        records.append(F.struct(
            F.lit(name).alias("column"),
            F.lit(types[name]).alias("data_type"),
            F.col("__rows").alias("n_rows"),
            F.col(f"__missing{i}").alias("n_missing"),
            distinct.alias("n_distinct"),
        ))
    return df.agg(*figures).select(F.inline(F.array(*records)))


def missing_total(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table."""
    counts = [F.count_if(is_missing(df, c)) for c in df.columns]
    return df.agg(sum(counts[1:], counts[0]).alias("n_missing"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(named(column)).distinct()


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(named(column)).alias("n_distinct"))


def value_range(df: DataFrame, column: str) -> DataFrame:
    """Least and greatest value; text compares by its characters."""
    return df.agg(F.min(named(column)).alias("first"), F.max(named(column)).alias("last"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    groups = df.groupBy(*[named(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates"))


def describe(df: DataFrame, columns: Sequence[str], search_from: int = SEARCH_FROM) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles as ``(column, metric, value)``."""
    quartiles = quantile_columns(df, columns, (0.25, 0.5, 0.75), search_from)
    figures, records = [], []
    for i, name in enumerate(columns):
        value = number(name)
        figures += [
            F.count(value).cast("double").alias(f"__count{i}"),
            F.avg(value).alias(f"__mean{i}"),
            F.stddev_samp(value).alias(f"__std{i}"),
            F.min(value).alias(f"__min{i}"),
            F.max(value).alias(f"__max{i}"),
            quartiles[name].alias(f"__q{i}"),
        ]
        metrics = {
            "count": F.col(f"__count{i}"),
            "mean": F.col(f"__mean{i}"),
            "std": F.col(f"__std{i}"),
            "min": F.col(f"__min{i}"),
            "25%": F.col(f"__q{i}")[0],
            "50%": F.col(f"__q{i}")[1],
            "75%": F.col(f"__q{i}")[2],
            "max": F.col(f"__max{i}"),
        }
        records += [
            F.struct(F.lit(name).alias("column"), F.lit(metric).alias("metric"), column.alias("value"))
            for metric, column in metrics.items()
        ]
    return df.agg(*figures).select(F.inline(F.array(*records)))
