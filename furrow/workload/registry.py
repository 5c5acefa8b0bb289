"""Registration of queries and the derived inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its own name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Events with gaps: the value and type of error events count as missing.
GAPS = """gaps AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_type <> 'error' THEN event_type END AS kind,
         CASE WHEN event_type <> 'error' THEN value END AS v
  FROM events)"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_known = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "user_id",
        F.when(is_known, F.col("event_type")).alias("kind"),
        F.when(is_known, F.col("value")).alias("v"),
    )


# Order value per priority and year, summed in cents so that the order of adding is no matter.
YEARLY = """yearly AS (
  SELECT o_orderpriority AS priority, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS total
  FROM orders GROUP BY 1, 2)"""


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"))
        .agg((F.sum(cents) / F.lit(100.0)).alias("total"))
    )
