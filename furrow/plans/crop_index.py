"""From a raw index table to clean wide, long and summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators import clean, profile, reshape, stats, timeseries
from furrow.operators.columns import named
from furrow.sources.files import write_tables

KEY, PERIOD, INDEX = "Crop", "Year", "Index_Value"
CHANGE, GROWTH = "YoY_Pct_Change", "Cumulative_Growth"
PREFIX = "Year_"
#: Place of a row among those of one name and year, so that repeated names have one order.
ORDER = "__order"


def clean_wide(raw: DataFrame, order_by: Sequence[str] = (), trim_first: bool = False, **options) -> DataFrame:
    """The clean wide table; see :func:`ordered_wide`."""
    return ordered_wide(raw, order_by, trim_first, **options).drop(ORDER)


def ordered_wide(raw: DataFrame, order_by: Sequence[str] = (), trim_first: bool = False, **options) -> DataFrame:
    """Blank rows out, columns renamed, cells numeric, gaps filled, duplicates out, names trimmed.

    The first column that is not an order column is the key. A missing key takes the one of
    the row before, for which ``order_by`` must give the order; without it such rows stay as
    they are. Means are taken before duplicates go, and names are trimmed after, unless
    ``trim_first``. So a name can stand on several rows; their column ``__order`` says which comes first: the place of
    the first of the equal rows in ``order_by``, or without it the values of the row.
    """
    values = [c for c in raw.columns if c not in order_by]
    df = clean.drop_blank_rows(clean.blank_to_null(raw), values)
    df = df.select(
        named(values[0]).alias(KEY), *[named(c).alias(f"{PREFIX}{c}") for c in values[1:]], *order_by
    )
    years = [f"{PREFIX}{c}" for c in values[1:]]
    df = clean.to_numeric(df, years)
    if order_by:
        # Without a missing key there is nothing to fill, and no need to bring rows into order.
        if not df.where(F.col(KEY).isNull()).isEmpty():
            df = clean.forward_fill(df, [KEY], order_by, **options)
    place = F.struct(*map(named, order_by)).alias(ORDER) if order_by else F.lit(None).alias(ORDER)
    df = clean.mean_fill(df.select(KEY, *years, place), years)
    if trim_first:
        df = clean.strip_text(df, [KEY])
    values = F.min(ORDER) if order_by else F.struct(*map(named, years))
    return clean.strip_text(df.groupBy(KEY, *years).agg(values.alias(ORDER)), [KEY])


def to_long(wide: DataFrame, bounded: bool = False) -> DataFrame:
    """One row per crop and year with the change to the year before and the growth since the first.

    Rows of one name and year follow each other by ``__order``, where the table has it, and else by all their values.
    ``bounded=True`` promises that no name stands on very many rows and saves counting them.
    """
    years = [c for c in wide.columns if c not in (KEY, ORDER)]
    if ORDER not in wide.columns:
        wide = wide.withColumn(ORDER, F.struct(*map(named, years)))
    long = reshape.remove_text(reshape.melt(wide, [KEY, ORDER], years, PERIOD, INDEX), PERIOD, PREFIX)
    metrics = timeseries.series_metrics(long, [KEY], [PERIOD, ORDER], INDEX, CHANGE, GROWTH, bounded=bounded)
    return metrics.drop(ORDER)


def summarise(long: DataFrame) -> DataFrame:
    return stats.group_summary(long, KEY, INDEX, CHANGE)


def crop_index(
    raw: DataFrame, order_by: Sequence[str] = (), bounded: bool = False, **options
) -> dict[str, DataFrame]:
    """The three tables, not yet computed."""
    wide = ordered_wide(raw, order_by, **options)
    long = to_long(wide, bounded)
    return {"wide": wide.drop(ORDER), "long": long, "summary": summarise(long)}


def report(wide: DataFrame, long: DataFrame) -> DataFrame:
    """Closing figures of a run as one row, from one pass over the long table: equal rows are counted first.

    ``wide`` gives nothing that ``long`` does not, as every crop has rows there.
    """
    rows = long.groupBy(*long.columns).agg(F.count(F.lit(1)).alias("__n"))
    per_crop = rows.groupBy(KEY).agg(
        F.sum("__n").alias("n"),
        F.min(PERIOD).alias("first"),
        F.max(PERIOD).alias("last"),
        F.sum(sum((named(c).isNull().cast("long") for c in long.columns), F.lit(0)) * F.col("__n")).alias("missing"),
        F.sum(F.col("__n") - 1).alias("twice"),
    )
    return per_crop.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"),
        F.min("first").alias("first_year"),
        F.max("last").alias("last_year"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("n_missing"),
        F.count(KEY).alias("n_crops"),
        F.coalesce(F.sum("twice"), F.lit(0)).alias("n_duplicates"),
    )


def describe(long: DataFrame, **options) -> DataFrame:
    """The usual figures of index, change and growth over all crops."""
    return profile.describe(long, [INDEX, CHANGE, GROWTH], **options)


def outliers(long: DataFrame, **options) -> DataFrame:
    """Rows whose change lies beyond 1.5 times the range between the quartiles of all changes."""
    return stats.iqr_outliers(long, CHANGE, **options)


def run(raw: DataFrame, base: str, order_by: Sequence[str] = (), format: str = "parquet") -> None:
    """Compute and write all tables of the run, in order of name and year; each later table starts from a written one.

    Tables: wide, long, summary, describe, crop_stats, outliers, report; ``ordered`` is wide with the order of its rows.
    """
    spark = raw.sparkSession
    working = f"{base.rstrip('/')}"

    def written(name: str, df: DataFrame) -> DataFrame:
        write_tables({name: df}, working)
        return spark.read.schema(df.schema).parquet(f"{working}/{name}")

    ordered_rows = written("ordered", ordered_wide(raw, order_by))
    wide = written("wide", ordered_rows.orderBy(KEY, ORDER).drop(ORDER))
    long = written("long", to_long(ordered_rows).orderBy(KEY, PERIOD, INDEX, CHANGE, GROWTH))
    later = {
        "summary": summarise(long).orderBy(KEY),
        "describe": describe(long),
        "crop_stats": stats.group_stats(long, [KEY], INDEX).orderBy(KEY),
        "outliers": outliers(long).orderBy(KEY, PERIOD),
        "report": report(wide, long),
    }
    for name, df in later.items():
        written(name, df)
    if format != "parquet":
        tables = {n: spark.read.parquet(f"{working}/{n}") for n in ("wide", "long", *later)}
        write_tables({f"{n}_{format}": df for n, df in tables.items()}, working, format)
