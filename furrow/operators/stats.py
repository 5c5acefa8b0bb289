"""Quantiles, outliers and summaries by group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.numbers import round_half_even
from furrow.operators import ordered
from furrow.operators.columns import number
from furrow.session import shared_dir

# Spark's exact percentile keeps one entry per distinct value of a group in one task, so groups
# beyond this many rows are not left to it.
ROWS_PER_TASK = 1_000_000
# Beyond this many distinct values a search over the whole column is the faster way.
SEARCH_FROM = 50_000
# Columns searched together: each keeps up to SEARCH_FROM values per position in one task.
COLUMNS_PER_PASS = 16
ACCURACY = 10_000


def _fractions(probs: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(p)) for p in probs])


def quantile_columns(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], search_from: int = SEARCH_FROM
) -> dict[str, Column]:
    """For each column an expression for use in ``df.agg``: array of exact quantiles.

    Quantiles interpolate between the two nearest values; missing cells do not count.
    """
    known = df.agg(*[
        F.struct(F.approx_count_distinct(number(c)).alias("distinct"), F.count(number(c)).alias("n"))
        for c in columns
    ]).first()
    wide = [c for c, sizes in zip(columns, known) if sizes["distinct"] > search_from]
    found: dict[str, Column] = {}
    for at in range(0, len(wide), COLUMNS_PER_PASS):
        some = wide[at : at + COLUMNS_PER_PASS]
        # The search compares values seen in one job with those of the next, so they are computed once and stored.
        shared_dir(df.sparkSession)
        stored = df.select(*[number(c).alias(f"v{i}") for i, c in enumerate(some)]).checkpoint()
        totals = stored.agg(*[F.count(c) for c in stored.columns]).first()
        values = _search(stored, dict(zip(stored.columns, totals)), probs, search_from)
        found |= {c: F.array(*map(F.lit, row)) for c, row in zip(some, values)}
    return {c: found[c] if c in found else F.percentile(number(c), _fractions(probs)) for c in columns}


def _search(
    df: DataFrame, totals: dict[str, int], probs: Sequence[float], small: int
) -> list[list[float]]:
    """Exact quantiles of columns too varied for one task, given their number of values.

    Each wanted position in the sorted column is enclosed by two approximate percentiles, and
    counts say whether it is one of them or lies between. Every round leaves thousands of times
    fewer rows, without a shuffle of rows and with only these few numbers on the driver. The last
    ``small`` rows at most around a position are sorted in one task.
    """
    values = [number(c) for c in totals]
    places = {i: [p * (total - 1) for p in probs] for i, total in enumerate(totals.values())}
    found: dict[tuple[int, int], float] = {}
    # (column, position) -> open interval, how many rows lie at or below its start, how many inside.
    gaps = {
        (i, k): (None, None, 0, total)
        for i, total in enumerate(totals.values())
        for place in places[i]
        for k in (math.floor(place), math.ceil(place))
    }

    def within(i: int, low: float | None, high: float | None) -> Column:
        inside = values[i].isNotNull() if low is None else values[i] > low
        return inside if high is None else inside & (values[i] < high)

    step = 2.0 / ACCURACY
    while wide := {key: gap for key, gap in gaps.items() if gap[3] > small}:
        shared: dict[tuple, list] = {}
        for (i, k), (low, high, below, inside) in wide.items():
            share = (k - below) / inside
            shared.setdefault((i, low, high), []).append(((i, k), share))
        guesses = df.agg(*[
            F.percentile_approx(
                F.when(within(i, low, high), values[i]),
                _fractions([
                    edge for _, share in wanted for edge in (max(0.0, share - step), min(1.0, share + step))
                ]),
                ACCURACY,
            )
            for (i, low, high), wanted in shared.items()
        ]).first()
        edges = {}
        for guess, wanted in zip(guesses, shared.values()):
            for n, (key, _) in enumerate(wanted):
                edges[key] = (guess[2 * n], guess[2 * n + 1])
        counts = df.agg(*[
            F.array(
                F.count_if(within(i, *wide[i, k][:2]) & (values[i] < left)),
                F.count_if(values[i] == left),
                F.count_if(within(i, left, right)),
                F.count_if((values[i] == right) & (values[i] > left)),
            )
            for (i, k), (left, right) in edges.items()
        ]).first()
        for (key, (left, right)), (under, at_left, between, at_right) in zip(edges.items(), counts):
            low, high, below, inside = gaps.pop(key)
            k, upto = key[1], below + under
            if k < upto:
                gaps[key] = (low, left, below, under)
            elif k < upto + at_left:
                found[key] = left
            elif k < upto + at_left + between:
                gaps[key] = (left, right, upto + at_left, between)
            elif k < upto + at_left + between + at_right:
                found[key] = right
            else:
                passed = under + at_left + between + at_right
                gaps[key] = (right, high, below + passed, inside - passed)

    if gaps:
        # Positions in one gap share its rows.
        shared = {}
        for (i, k), (low, high, below, _) in gaps.items():
            shared.setdefault((i, low, high, below), []).append(k)
        last = df.agg(*[
            F.transform(
                F.array(*[F.lit(k - below + 1) for k in wanted]),
                _element_of(F.array_sort(F.collect_list(F.when(within(i, low, high), values[i])))),
            )
            for (i, low, high, below), wanted in shared.items()
        ]).first()
        for row, ((i, *_), wanted) in zip(last, shared.items()):
            found.update({(i, k): value for k, value in zip(wanted, row)})

    def between_nearest(i: int, place: float) -> float:
        low, high = math.floor(place), math.ceil(place)
        if low == high:
            return found[i, low]
        return (high - place) * found[i, low] + (place - low) * found[i, high]

    return [[between_nearest(i, place) for place in places[i]] for i in range(len(totals))]


def _element_of(values: Column):
    return lambda place: F.element_at(values, place)


def quantiles(
    df: DataFrame,
    column: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    search_from: int = SEARCH_FROM,
    name: str = "quantiles",
) -> DataFrame:
    """Quantiles of a column, per group if ``by`` is given: key columns and an array.

    Exact unless ``accuracy`` asks for approximate percentiles.
    """
    if accuracy:
        return df.groupBy(*by).agg(
            F.percentile_approx(number(column), _fractions(probs), accuracy).alias(name)
        )
    if not by:
        return df.agg(quantile_columns(df, [column], probs, search_from)[column].alias(name))
    values = df.select(*by, number(column).alias("__v"))
    small, large, _ = ordered.by_size(values, by, rows_per_task)
    cut = []
    if small is not None:
        cut.append(small.groupBy(*by).agg(F.percentile("__v", _fractions(probs)).alias(name)))
    if large is not None:
        cut.append(_by_counts(large, probs, list(by), name, rows_per_task))
    return cut[0] if len(cut) == 1 else cut[0].unionByName(cut[1])


def _by_counts(values: DataFrame, probs, by, name, rows_per_task) -> DataFrame:
    """Exact quantiles of large groups: count each value, then add the counts up in order."""
    shared_dir(values.sparkSession)
    counts = (
        values.groupBy(*by, "__v")
        .agg(F.count("__v").alias("__n"))
        .checkpoint()
    )
    upto = ordered.along(
        counts, by, ["__v"], {"__upto": ordered.running_sum("__n")}, rows_per_task=rows_per_task
    )
    totals = counts.groupBy(*[F.col(k).alias(f"__total_{k}") for k in by]).agg(
        F.sum("__n").alias("__total")
    )
    # One row per large group, of which there are few: their sums are small to send along.
    joined = upto.join(F.broadcast(totals), ordered.same(by, [f"__total_{k}" for k in by]))
    ends, result = [], []
    for i, p in enumerate(probs):
        place = (F.col("__total") - 1) * F.lit(float(p))
        for end, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            ends.append(F.min(F.when(F.col("__upto") > at, F.col("__v"))).alias(f"__{end}{i}"))
        place = (F.col("__all") - 1) * F.lit(float(p))
        low, high = F.col(f"__low{i}"), F.col(f"__high{i}")
        result.append(
            F.when(F.floor(place) == F.ceil(place), low)
            .otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)
        )
    return (
        joined.groupBy(*by)
        .agg(F.max("__total").alias("__all"), *ends)
        .select(*by, F.array(*result).alias(name))
    )


def iqr_bounds(df: DataFrame, column: str, by: Sequence[str] = (), factor: float = 1.5, **options) -> DataFrame:
    """First and third quartile and the limits beyond which a value is an outlier."""
    quartiles = quantiles(df, column, (0.25, 0.75), by, name="__q", **options)
    q1, q3 = F.col("__q")[0], F.col("__q")[1]
    return quartiles.select(
        *by,
        q1.alias("q1"),
        q3.alias("q3"),
        (q1 - factor * (q3 - q1)).alias("lower"),
        (q3 + factor * (q3 - q1)).alias("upper"),
    )


def outside(value: Column, lower: Column, upper: Column) -> Column:
    """Strictly below or above the limits; a missing value is neither."""
    return (value < lower) | (value > upper)


def iqr_outliers(df: DataFrame, column: str, by: Sequence[str] = (), **options) -> DataFrame:
    """Rows whose value lies outside the limits of the whole table, or of their group."""
    bounds = iqr_bounds(df, column, by, **options)
    value = number(column)
    if not by:
        limits = bounds.select(F.struct("lower", "upper")).scalar()
        return df.where(outside(value, limits["lower"], limits["upper"]))
    named = bounds.select(
        *[F.col(k).alias(f"__bound_{k}") for k in by], F.col("lower").alias("__lower"), F.col("upper").alias("__upper")
    )
    match = ordered.same(by, [f"__bound_{k}" for k in by])
    return df.join(named, match & outside(value, F.col("__lower"), F.col("__upper"))).select(*df.columns)


def group_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, least, greatest and sample deviation per group; rows with a missing key are left out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_samp(value).alias("std"),
    )


def group_summary(
    df: DataFrame,
    key: str = "Crop",
    index: str = "Index_Value",
    change: str = "YoY_Pct_Change",
    digits: int = 2,
) -> DataFrame:
    """Six figures per group, rounded half to even."""
    figures = {
        "Mean_Index": F.avg(index),
        "Min_Index": F.min(index),
        "Max_Index": F.max(index),
        "Std_Index": F.stddev_samp(index),
        "Mean_YoY_Change": F.avg(change),
        "Std_YoY_Change": F.stddev_samp(change),
    }
    return df.dropna(subset=[key]).groupBy(key).agg(
        *[round_half_even(figure, digits).alias(name) for name, figure in figures.items()]
    )
