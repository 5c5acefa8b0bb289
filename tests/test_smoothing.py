"""Exponential smoothing in stretches against the plain recurrence."""

import math
import random

import pytest

from furrow.operators import smoothing


def plain(values, rate):
    level, squares = values[0], 0.0
    for x in values[1:]:
        squares += (x - level) ** 2
        level += rate * (x - level)
    return level, math.sqrt(squares / (len(values) - 1)) if len(values) > 1 else None


def table(spark, rows):
    return spark.createDataFrame(rows, "crop string, t int, v double")


@pytest.mark.parametrize("stretch, options", [(10_000, {}), (7, {}), (1, {}), (7, {"rows_per_task": 30})])
def test_equals_the_recurrence(spark, stretch, options):
    rng = random.Random(5)
    series = {"long": [1e6 + rng.gauss(0, 3) for _ in range(200)], "walk": [sum(rng.gauss(0, 1) for _ in range(i)) for i in range(1, 60)], "one": [4.0], "same": [2.5] * 20}
    rows = [(k, t, v) for k, values in series.items() for t, v in enumerate(values)]
    rows += [("long", 500, None), ("long", -1, float("nan")), (None, 1, 2.0), ("none", 1, None)]
    rng.shuffle(rows)
    df = table(spark, rows)
    got = smoothing.rolling_errors(df, ["crop"], ["t"], "v", rates=(0.2, 0.5, 1.0), stretch=stretch, **options).collect()
    assert len(got) == 3 * len(series)
    for r in got:
        level, rmse = plain(series[r.crop], r.rate)
        assert r.n_values == len(series[r.crop]) and r.forecast == pytest.approx(level, rel=1e-12)
        assert r.rmse is None if rmse is None else r.rmse == pytest.approx(rmse, rel=1e-7, abs=1e-7)
    best = {r.crop: r for r in smoothing.smoothed(df, ["crop"], ["t"], "v", rates=(0.2, 0.5, 1.0), stretch=stretch, **options).collect()}
    assert best.keys() == series.keys() and best["one"].rate == best["same"].rate == 0.2
    for crop in ("long", "walk"):
        assert best[crop].rate == min((0.2, 0.5, 1.0), key=lambda a: plain(series[crop], a)[1])


def test_without_keys_and_without_rows(spark):
    df = table(spark, [("a", 1, 2.0), ("b", 2, 4.0)])
    row = smoothing.smoothed(df, [], ["t"], "v", rates=(0.5,)).first()
    assert (row.n_values, row.forecast, row.rmse) == (2, 3.0, 2.0)
    assert smoothing.smoothed(df.where("false"), ["crop"], ["t"], "v").count() == 0


def test_rates_and_names_are_checked(spark):
    df = table(spark, [("a", 1, 2.0)])
    for rates in ((), (0.0,), (1.5,)):
        with pytest.raises(ValueError):
            smoothing.rolling_errors(df, ["crop"], ["t"], "v", rates=rates)
    with pytest.raises(ValueError):
        smoothing.rolling_errors(df.withColumnRenamed("crop", "rate"), ["rate"], ["t"], "v")
