"""Layouts of the raw farming tables, read as text by position and then typed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions import text as X
from furrow.functions.numbers import round_half_even
from furrow.functions.zones import zones_but
from furrow.operators import clean, reshape
from furrow.sources.files import read_csv

# Columns of the raw tables, in the order of the files.
INDEX_YEARS = ("2004-05", "2005-06", "2006-07", "2007-08", "2008-09", "2009-10", "2010-11", "2011-12")
MEASURE_YEARS = ("2006-07", "2007-08", "2008-09", "2009-10", "2010-11")
MEASURES = ("Production", "Area", "Yield")
COST_COLUMNS = ("crop", "state", "cost_a2fl", "cost_c2", "cost_per_quintal", "yield_quintal")
VARIETY_COLUMNS = ("crop", "variety", "duration", "zone", "unused")
NUTRIENTS = ("zn", "fe", "cu", "mn", "b", "s")

# A fixed layout: that of the weather records.
WEATHER = T.StructType([
    T.StructField("current", T.StructType([
        T.StructField("temp", T.IntegerType()),
        T.StructField("condition", T.StringType()),
        T.StructField("humidity", T.IntegerType()),
        T.StructField("rainfall", T.IntegerType()),
    ])),
    T.StructField("forecast", T.ArrayType(T.StructType([
        T.StructField("day", T.StringType()),
        T.StructField("temp", T.IntegerType()),
        T.StructField("condition", T.StringType()),
        T.StructField("rain", T.IntegerType()),
    ]))),
])


def read_index_wide(spark: SparkSession, path: str) -> DataFrame:
    """Index per crop and year, untyped, with the order of the file."""
    return read_csv(spark, path, ("Crop", *INDEX_YEARS), with_order=True)


def read_cost_yield(spark: SparkSession, path: str) -> DataFrame:
    """Cost of cultivation and yield per crop and state."""
    raw = clean.strip_text(read_csv(spark, path, COST_COLUMNS))
    return clean.drop_blank_rows(clean.to_numeric(raw, COST_COLUMNS[2:]))


def read_measures(spark: SparkSession, path: str) -> DataFrame:
    """Production, area and yield index per crop and year, as ``(crop, year, <measures>)``."""
    columns = ["crop", *[f"{m} {y}" for m in MEASURES for y in MEASURE_YEARS]]
    return standardise_measures(clean.strip_text(read_csv(spark, path, columns)))


def standardise_measures(wide: DataFrame, id_column: str = "crop", digits: int = 2) -> DataFrame:
    """``"<Measure> <year>"`` columns as one row per id and year with a column per measure.

    Values are rounded half to even to take out artefacts of decimal fractions.
    """
    columns = [c for c in wide.columns if c != id_column]
    measures = list(dict.fromkeys(c.strip().rsplit(" ", 1)[0] for c in columns))
    long = reshape.split_measure(reshape.melt(clean.to_numeric(wide, columns), [id_column], columns))
    long = long.withColumn("value", round_half_even(F.col("value"), digits))
    return reshape.spread(long, [id_column, "period"], "measure", "value", measures).select(
        id_column, F.col("period").alias("year"), *[F.col(m).alias(m.lower()) for m in measures]
    )


def read_varieties(spark: SparkSession, path: str) -> DataFrame:
    """Varieties with the days they take and the states they suit."""
    raw = clean.strip_text(read_csv(spark, path, VARIETY_COLUMNS))
    return parse_varieties(raw.drop("unused"))


def parse_varieties(df: DataFrame, duration: str = "duration", zone: str = "zone", patterns=None) -> DataFrame:
    """Duration text as least and greatest days, zone text as a list of states.

    States that a bracket excepts are taken off; excepted parts of states are in ``excepted``, see :func:`zones_but`.
    """
    others = [c for c in df.columns if c not in (duration, zone)]
    days = X.duration_days(F.col(duration))
    found = zones_but(F.col(zone), patterns)
    return df.select(
        *others,
        days["min_days"].alias("min_days"),
        days["max_days"].alias("max_days"),
        found["states"].alias("states"),
        found["parts"].alias("excepted"),
    )


def read_soil(spark: SparkSession, path: str) -> DataFrame:
    """Percentages of six nutrients per district."""
    raw = clean.strip_text(read_csv(spark, path, ("district", *NUTRIENTS)))
    return clean.to_numeric(raw, NUTRIENTS)
