"""Exponential smoothing with errors of forecasts from rolling origins, for series of any length (our definition).

The level starts at the first value and moves by ``rate`` of each error. That is linear in the level a stretch of values starts
from, and the squared errors are quadratic in it. So each stretch is folded once, in its own group, to the coefficients of both;
a second fold puts the stretches of a series in order. Series above
``rows_per_task`` (see :mod:`furrow.operators.ordered`) are numbered in ranges and folded by many tasks; smaller ones stay in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators import ordered
from furrow.operators.columns import named, number

RATES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
#: Values folded as one array.
STRETCH = 10_000


def _fold(values: Column, rate: Column) -> Column:
    """Coefficients of a stretch: from a level ``base + x`` it ends at ``base + c * x + d``, its squared errors sum up to ``p - 2 * q * x + r * x * x``."""
    base = values[0]["value"]

    def step(state: Column, item: Column) -> Column:
        error = item["value"] - base - state["d"]
        return F.struct(
            (state["c"] * (1 - rate)).alias("c"),
            (state["d"] + rate * error).alias("d"),
            (state["p"] + error * error).alias("p"),
            (state["q"] + error * state["c"]).alias("q"),
            (state["r"] + state["c"] * state["c"]).alias("r"),
        )

    start = F.struct(*[F.lit(1.0 if name == "c" else 0.0).alias(name) for name in "cdpqr"])
    return F.aggregate(values, start, step)


def _join_up(stretches: Column) -> Column:
    """Level and sum of squared errors at the end of all stretches of a series."""

    def step(state: Column, item: Column) -> Column:
        x = state["level"] - item["base"]
        more = item["p"] - 2 * item["q"] * x + item["r"] * x * x
        return F.struct(
            (item["base"] + item["c"] * x + item["d"]).alias("level"),
            (state["squares"] + F.greatest(more, F.lit(0.0))).alias("squares"),
        )

    return F.aggregate(stretches, F.struct(stretches[0]["base"].alias("level"), F.lit(0.0).alias("squares")), step)


def rolling_errors(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str,
    rates: Sequence[float] = RATES, stretch: int = STRETCH, **options,
) -> DataFrame:
    """Per series and rate: keys, rate, n_values, forecast of the next value, and rmse of each value's forecast from those before it.

    ``order_by`` must order the rows of a series without ties. Missing values and rows with a missing key are left out. A series
    of one value has that value as forecast and no rmse. ``options`` go to :func:`furrow.operators.ordered.along`.
    """
    if not rates or not all(0 < r <= 1 for r in rates):
        raise ValueError("rates lie above 0 and up to 1")
    keys = list(keys)
    if {"rate", "n_values", "forecast", "rmse"} & set(keys):
        raise ValueError("keys are named like a column of the result")
    rows = df.dropna(subset=keys) if keys else df
    rows = rows.select(
        *[named(k) for k in keys],
        *[named(c).alias(f"__order{i}") for i, c in enumerate(order_by)],
        number(value).alias("__value"), F.lit(1).alias("__one"),
    ).where("__value IS NOT NULL")
    counted = ordered.along(rows, keys, [f"__order{i}" for i in range(len(order_by))], {"__no": ordered.running_sum("__one")}, **options)
    stretches = counted.groupBy(*map(named, keys), F.floor((F.col("__no") - 1) / stretch).alias("__stretch")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("__no").alias("no"), F.col("__value").alias("value")))).alias("__values")
    )
    folded = stretches.select(
        *map(named, keys), "__stretch", F.col("__values")[0]["value"].alias("__base"), F.size("__values").alias("__size"),
        F.explode(F.transform(F.array(*[F.lit(float(r)) for r in rates]), lambda r: F.struct(r.alias("rate"), _fold(F.col("__values"), r).alias("at")))).alias("__fold"),
    )
    series = folded.groupBy(*map(named, keys), F.col("__fold.rate").alias("rate")).agg(
        F.sum("__size").alias("n_values"),
        F.sort_array(F.collect_list(F.struct(F.col("__stretch").alias("no"), F.col("__base").alias("base"), F.col("__fold.at.*")))).alias("__all"),
    )
    ends = series.select(*map(named, keys), "rate", "n_values", _join_up(F.col("__all")).alias("__end"))
    return ends.select(
        *map(named, keys), "rate", "n_values", F.col("__end.level").alias("forecast"),
        F.when(F.col("n_values") > 1, F.sqrt(F.col("__end.squares") / (F.col("n_values") - 1))).alias("rmse"),
    )


def smoothed(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str, **options) -> DataFrame:
    """Per series the row of :func:`rolling_errors` with the least rmse, ties to the smaller rate."""
    errors = rolling_errors(df, keys, order_by, value, **options)
    rest = ["rate", "n_values", "forecast", "rmse"]
    best = F.min(F.struct(F.col("rmse").alias("by"), F.col("rate").alias("then"), F.struct(*rest).alias("row")))
    return errors.groupBy(*map(named, keys)).agg(best.alias("__best")).select(*map(named, keys), *[F.col(f"__best.row.{c}") for c in rest])
