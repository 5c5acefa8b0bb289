"""Market dashboard: price, demand, scheme and weather tables ready to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import labels as L
from furrow.operators import ranking, reshape


def price_table(prices: DataFrame) -> DataFrame:
    return prices.select(
        "crop",
        "mandi",
        L.thousands(F.col("minPrice")).alias("min_price"),
        L.thousands(F.col("maxPrice")).alias("max_price"),
        L.trend_direction(F.col("trend")).alias("direction"),
        L.percent_text(F.col("change")).alias("change"),
    )


def demand_table(demand: DataFrame, n: int) -> DataFrame:
    """The n crops in highest demand; that the highest come first is our definition."""
    top = ranking.best(demand, [F.desc("demand"), F.asc("name")], n)
    return top.select(
        "name",
        "demand",
        L.growth_direction(F.col("growth")).alias("direction"),
        F.abs("growth").alias("growth"),
    )


def scheme_table(schemes: DataFrame, now: Column) -> DataFrame:
    days = L.days_left(F.col("deadline"), now)
    return schemes.select(
        "title",
        "description",
        L.short_date(F.col("deadline").try_cast("date")).alias("deadline"),
        days.alias("days_left"),
        L.deadline_label(days).alias("label"),
        L.urgency(days).alias("urgency"),
    )


def forecast_table(weather: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    days = reshape.explode_records(weather, keep, "forecast")
    return days.withColumn("icon", L.condition_class(F.col("condition")))
