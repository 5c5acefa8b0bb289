"""Change and growth along a series, buckets and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators import ordered


def _percent_change(value: Column, before: Column) -> Column:
    return (F.try_divide(value, before) - 1) * 100


def series_metrics(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value: str,
    change: str | None = "pct_change",
    growth: str | None = "base_index",
    **options,
) -> DataFrame:
    """Percent change to the row before and percent of the first row, per group.

    A zero before or at the start gives NULL, and so does a missing key. Both figures share
    one window. ``options`` go to :func:`furrow.operators.ordered.along`.
    """
    wanted = {}
    if change:
        wanted["__before"] = ordered.previous(value)
    if growth:
        wanted["__start"] = ordered.first(value)
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    steps = ordered.along(df, keys, order_by, wanted, **options)
    figures = []
    if change:
        figures.append(F.when(known, _percent_change(F.col(value), F.col("__before"))).alias(change))
    if growth:
        figures.append(F.when(known, F.try_divide(F.col(value), F.col("__start")) * 100).alias(growth))
    return steps.select(*df.columns, *figures)


def pct_change(df: DataFrame, keys, order_by, value: str, name: str = "pct_change", **options) -> DataFrame:
    """Percent change to the row before, per group."""
    return series_metrics(df, keys, order_by, value, name, None, **options)


def base_index(df: DataFrame, keys, order_by, value: str, name: str = "base_index", **options) -> DataFrame:
    """Percent of the group's first row."""
    return series_metrics(df, keys, order_by, value, None, name, **options)


def price_buckets(
    df: DataFrame, keys: Sequence[str], moment: str, price: str, unit: str = "day", change: bool = True
) -> DataFrame:
    """Least, greatest and mean price per time bucket, and the change of the mean (our definition)."""
    buckets = df.groupBy(*keys, F.date_trunc(unit, F.col(moment)).alias("bucket")).agg(
        *price_figures(price)
    )
    if not change:
        return buckets
    # One row per bucket: by the hour or longer, the calendar bounds the rows of a key.
    is_coarse = unit.lower() in ("hour", "day", "week", "month", "quarter", "year")
    return pct_change(buckets, keys, ["bucket"], "avg_price", "change", bounded=is_coarse)


def price_figures(price: str) -> list[Column]:
    return [
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.avg(price).alias("avg_price"),
        F.count(price).alias("n_prices"),
    ]


def last_days(df: DataFrame, moment: str, days: int, as_of: Column | None = None) -> DataFrame:
    """Rows of the last days before ``as_of``, or before the latest row (our definition)."""
    end = df.agg(F.max(moment)).scalar() if as_of is None else as_of
    start = end - F.make_interval(days=F.lit(days))
    return df.where((F.col(moment) > start) & (F.col(moment) <= end))


def period_growth(
    df: DataFrame,
    keys: Sequence[str],
    moment: str,
    price: str,
    as_of: Column,
    periods: dict[str, int] | None = None,
) -> DataFrame:
    """Mean price of the last week, month and year against the period before (our definition)."""
    figures = []
    for name, days in (periods or {"week": 7, "month": 30, "year": 365}).items():
        edges = [as_of - F.make_interval(days=F.lit(days * n)) for n in range(3)]
        means = [
            F.avg(F.when((F.col(moment) > edges[n + 1]) & (F.col(moment) <= edges[n]), F.col(price)))
            for n in range(2)
        ]
        figures.append(_percent_change(*means).alias(f"{name}_growth"))
    return df.groupBy(*keys).agg(*figures)


def linear_trend(df: DataFrame, keys: Sequence[str], time: str, value: str, ahead: float = 1.0) -> DataFrame:
    """Straight line per group by least squares, and its value after the last time (our definition)."""
    x, y = F.col(time).cast("double"), F.col(value).cast("double")
    line = df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.max(F.when(y.isNotNull(), x)).alias("__last"),
    )
    forecast = F.col("intercept") + F.col("slope") * (F.col("__last") + ahead)
    return line.select(*keys, "slope", "intercept", (F.col("__last") + ahead).alias("at"), forecast.alias("forecast"))


def start_year(label: Column) -> Column:
    """Year number of a label such as ``2004-05``."""
    return F.substring(label, 1, 4).try_cast("int")
