"""Quantiles, outliers, summaries and ranks against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from furrow.operators import ranking, stats

PROBS = (0.0, 0.25, 0.5, 0.9, 1.0)


def frame(spark, values):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "v double").repartition(5)


def by_hand(values, probs):
    """Linear interpolation in the sorted values."""
    ordered = sorted(values)
    result = []
    for p in probs:
        place = p * (len(ordered) - 1)
        low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
        result.append(low if low == high else low + (high - low) * (place - math.floor(place)))
    return result


def shapes():
    rng = random.Random(3)
    yield "normal", [rng.gauss(0, 10) for _ in range(5000)]
    yield "two heavy values around many rare ones", [0.0] * 2500 + [1.0] * 2499 + [rng.random() for _ in range(300)]
    yield "one heavy value", [7.0] * 3000 + [rng.gauss(7, 1) for _ in range(400)]
    yield "few values", [float(rng.randrange(4)) for _ in range(1000)]
    yield "missing and infinite", [None, float("nan"), float("inf"), float("-inf")] + [rng.random() for _ in range(999)]
    yield "single", [3.5]


@pytest.mark.parametrize("name,values", list(shapes()))
@pytest.mark.parametrize("search_from", [1, 10, 100_000])
def test_quantiles(spark, name, values, search_from):
    known = [v for v in values if v is not None and v == v]
    got = stats.quantiles(frame(spark, values), "v", PROBS, search_from=search_from).first()[0]
    assert got == pytest.approx(by_hand(known, PROBS), rel=1e-12)
    if all(map(math.isfinite, known)):
        assert got == pytest.approx(list(np.quantile(known, PROBS)), rel=1e-12)


def test_small_quantile_by_hand(spark):
    assert stats.quantiles(frame(spark, [1, 2, 4, 8]), "v", (0.25, 0.5)).first()[0] == [1.75, 3.0]
    assert stats.quantiles(frame(spark, range(1, 5)), "v", (0.5,), accuracy=1000).first()[0] == [2.0]


@pytest.mark.parametrize("rows_per_task", [1, 50, 1_000_000])
def test_quantiles_by_group(spark, rows_per_task):
    rng = random.Random(5)
    groups = {"hot": [rng.gauss(0, 1) for _ in range(900)], "b": [1.0, 2.0], None: [4.0], "empty": [None]}
    rows = [(k, v) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = stats.quantiles(df, "v", PROBS, ["k"], rows_per_task=rows_per_task)
    result = {r.k: r.quantiles for r in got.collect()}
    for key, values in groups.items():
        if key != "empty":
            assert result[key] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12)


def test_value_on_the_limit_is_no_outlier(spark):
    # Quartiles 2 and 4, so the limits are -1 and 7.
    values = [-1, 2, 2, 2, 3, 3, 4, 4, 4, 7]
    bounds = stats.iqr_bounds(frame(spark, values), "v").first()
    assert (bounds.lower, bounds.upper) == (-1.0, 7.0)
    assert stats.iqr_outliers(frame(spark, values), "v").count() == 0
    assert stats.iqr_outliers(frame(spark, [*values, None]), "v").count() == 0


def test_outliers_of_a_group(spark):
    rows = [("a", float(i)) for i in range(10)] + [("a", 100.0)] + [("b", 100.0 + i) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert [tuple(r) for r in stats.iqr_outliers(df, "v", ["k"]).collect()] == [("a", 100.0)]
    assert [tuple(r) for r in stats.iqr_outliers(df, "v", ["k"], rows_per_task=2).collect()] == [("a", 100.0)]


def test_summary_rounds_half_to_even_and_drops_missing_keys(spark):
    rows = [("x", 109.0, None), ("x", 109.25, 1.0), ("y", 5.0, None), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "Crop string, Index_Value double, YoY_Pct_Change double")
    got = {r.Crop: tuple(r)[1:] for r in stats.group_summary(df).collect()}
    assert got == {"x": (109.12, 109.0, 109.25, 0.18, 1.0, None), "y": (5.0, 5.0, 5.0, None, None, None)}


def test_group_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), (None, 9.0)], "k string, v double")
    got = {r.k: tuple(r)[1:] for r in stats.group_stats(df, ["k"], "v").collect()}
    assert got == {"a": (2.0, 1.0, 3.0, pytest.approx(2**0.5)), "b": (2.0, 2.0, 2.0, None)}


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("by", [["k"], []])
def test_ranks_of_large_groups(spark, descending, by):
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        key = "hot" if i % 3 == 0 else rng.choice("abcdefg") if i % 7 else None
        rows.append((i, key, None if i % 10 == 0 else 5 if i % 4 == 0 else rng.randrange(60)))
    df = spark.createDataFrame(rows, "id int, k string, v int").repartition(4)
    names = {"rank": "r", "dense_rank": "d", "percent_rank": "p"}
    got = ranking.ranks(df, by, "v", descending, **names, rows_per_task=20)
    plain = ranking.ranks(df, by, "v", descending, **names, bounded=True)
    assert got.columns == plain.columns == ["id", "k", "v", "r", "d", "p"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    order = F.desc("v") if descending else F.asc("v")
    window = Window.partitionBy(*by).orderBy(order)
    known = df.where("v IS NOT NULL").select("id", F.rank().over(window).alias("r"), F.percent_rank().over(window).alias("p"))
    expected = {r.id: (r.r, r.p) for r in known.collect()}
    assert {r.id: (r.r, r.p) for r in got.collect() if r.v is not None} == expected


def test_best_per_group_drops_surplus_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    best = ranking.best_per_group(df, ["k"], [F.desc("id")], 2)
    assert sorted((r.k, r.id, r.place) for r in best.collect()) == [
        (0, 996, 2), (0, 999, 1), (1, 994, 2), (1, 997, 1), (2, 995, 2), (2, 998, 1)
    ]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_quantiles_of_sums_that_change_with_every_run(spark):
    """Sums of doubles differ in their last bits between runs; the search must not compare one run with the next."""
    rows = spark.range(4000).select((F.col("id") % 500).alias("k"), (F.hash("id") / 7e3).alias("v"))
    exact = rows.groupBy("k").agg(F.sum("v").alias("v")).agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
    for _ in range(5):
        mixed = rows.repartition(5, F.hash(F.current_timestamp(), "v")).groupBy("k").agg(F.sum("v").alias("v"))
        assert stats.quantiles(mixed, "v", (0.25, 0.75), search_from=1).first()[0] == pytest.approx(exact)


def test_best_beyond_the_limit_of_the_engine(spark):
    """Above Spark's own threshold the surplus of a group goes in two steps, with the same rows left."""
    rows = spark.range(6000).select((F.col("id") % 2).alias("k"), F.hash("id").alias("v"), "id")
    got = ranking.best_per_group(rows, ["k"], [F.desc("v"), F.asc("id")], 1001)
    assert got.columns == ["k", "v", "id", "place"]
    window = Window.partitionBy("k").orderBy(F.desc("v"), F.asc("id"))
    want = rows.withColumn("place", F.row_number().over(window)).where("place <= 1001")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "__piece" in plan
