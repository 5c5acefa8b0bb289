"""Ranges that hold amounts, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from furrow.operators import intervals, recommend

POINTS, RANGES = "id int, k string, x double", "j int, k string, lo double, hi double, w int"


def units(value):
    return None if value is None else int(abs(value) * 100 + 0.5) * (1 if value >= 0 else -1)


def holds(p, r):
    return p[2] is not None and p[1] == r[1] and (r[2] is None or units(r[2]) <= units(p[2])) and (r[3] is None or units(p[2]) <= units(r[3]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    points = [(i, rng.choice("ab"), rng.choice([None, 5.0, 5.0, rng.randrange(-300, 300) / 10, 1e9])) for i in range(120)]
    ranges = [(j, rng.choice(["a", "b", None]), *[rng.choice([None, rng.randrange(-300, 300) / 10, 5.0]) for _ in "xy"], rng.randrange(5)) for j in range(90)]
    return points + points[:5], ranges + ranges[:4]


def test_pairs_as_by_all_pairs(spark, rows):
    points, ranges = rows
    want = sorted((p[0], r[0]) for p in points for r in ranges if holds(p, r))
    found = intervals.containing(spark.createDataFrame(points, POINTS), spark.createDataFrame(ranges, RANGES), "x", "lo", "hi", same=["k"])
    assert sorted((r.id, r.j) for r in found.collect()) == want and len(want) > 200
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_best_as_by_all_pairs(spark, rows):
    points, ranges = rows
    want = []
    for p in points:
        fit = sorted((r for r in ranges if holds(p, r)), key=lambda r: (-r[4], r[0]))[:3]
        want += [(p[0], k, r[0]) for k, r in enumerate(fit, 1)] or [(p[0], 0, -1)]
    found = intervals.best_containing(
        spark.createDataFrame(points, POINTS), spark.createDataFrame(ranges, RANGES), "x", "lo", "hi", [F.desc("w"), F.asc("j")], 3, same=["k"]
    )
    assert sorted((r.id, r.place or 0, -1 if r.j is None else r.j) for r in found.collect()) == sorted(want)


def test_empty_sides_and_clashing_names(spark):
    points, ranges = spark.createDataFrame([(1, "a", 2.0)], POINTS), spark.createDataFrame([(1, "a", 1.0, 3.0, 0)], RANGES)
    assert intervals.containing(points, ranges.where("false"), "x", "lo", "hi", same=["k"]).count() == 0
    assert intervals.containing(points.where("false"), ranges, "x", "lo", "hi", same=["k"]).count() == 0
    alone = intervals.best_containing(points, ranges.where("false"), "x", "lo", "hi", [F.asc("j")], 2, same=["k"])
    assert [tuple(r) for r in alone.select("id", "j", "place").collect()] == [(1, None, None)]
    with pytest.raises(ValueError, match="both sides"):
        intervals.containing(points, ranges, "x", "lo", "hi")


def test_a_wide_range_has_few_cells(spark):
    row = spark.range(1).select(F.size(intervals.cells(F.lit(-123456789), F.lit(987654321))).alias("n"), F.size(intervals.cells(F.lit(5), F.lit(4))).alias("none"))
    assert row.first().n <= 62 and row.first().none == 0


def test_within_budget(spark):
    crops = spark.createDataFrame([
        ("Rich", "₹90,000 - ₹95,000", 50000.0, None), ("Fair", "₹40,000 - ₹45,000", 10000.0, 30000.0), ("Fine", "₹40,000 - ₹60,000", None, 30000.0),
        ("Poor", "₹9,000", 0.0, 20000.0), ("Odd", None, 0.0, 90000.0),
    ], "name string, profit string, cost_low double, cost_high double")
    asked = spark.createDataFrame([(1, 20000.0, 0), (2, 20000.01, 45000), (3, 60000.0, None), (4, None, 0), (5, 20000.0, 40000)], "id int, budget double, least int")
    got = {}
    for r in sorted(recommend.within_budget(asked, crops, 3, least="least").collect(), key=lambda r: (r.id, r.place or 0)):
        got.setdefault(r.id, []).append(r.name)
    assert got == {1: ["Fair", "Fine", "Poor"], 2: [None], 3: ["Rich"], 4: [None], 5: ["Fair", "Fine"]}


def test_ranges_are_spread_over_tasks_and_cut_to_the_span_of_the_points(spark, rows, monkeypatch):
    points, ranges = rows
    monkeypatch.setattr(intervals, "RANGES_PER_TASK", 10)
    few = [p for p in points if p[2] is None or p[2] < 1e9]
    dealt = spark.createDataFrame(ranges, RANGES).coalesce(1)
    found = intervals.best_containing(spark.createDataFrame(few, POINTS), dealt, "x", "lo", "hi", [F.desc("w"), F.asc("j")], 3, same=["k"])
    assert "Exchange hashpartitioning" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan
    want = []
    for p in few:
        want += [(p[0], r[0]) for r in sorted((r for r in ranges if holds(p, r)), key=lambda r: (-r[4], r[0]))[:3]] or [(p[0], None)]
    key = lambda x: (x[0], x[1] or -1)
    assert sorted(((r.id, r.j) for r in found.collect()), key=key) == sorted(want, key=key)
    keyed = intervals._keyed(spark.createDataFrame(few, POINTS), "x", 100, ["k"])
    cut, top = intervals._ranged(dealt, "lo", "hi", 100, ["k"], keyed)
    assert cut.rdd.getNumPartitions() >= 5 and top <= 13  # the span is below 6000 units
    assert cut.where("lo IS NULL AND hi IS NULL").groupBy("j").count().agg(F.max("count")).first()[0] <= 26


def test_figures_as_by_all_pairs(spark, rows):
    points, ranges = rows
    want = []
    for p in points:
        if fit := [r for r in ranges if holds(p, r)]:
            weights = [r[4] for r in fit]
            want.append((p[0], len(fit), min(weights), max(weights), sum(weights), sum(r[2] is not None for r in fit)))
    figures = {"n": ("count", F.lit(1)), "least": ("min", F.col("w")), "most": ("max", F.col("w")), "all": ("sum", F.col("w")), "bounded": ("count", F.col("lo"))}
    points, ranges = spark.createDataFrame(points, POINTS), spark.createDataFrame(ranges, RANGES)
    found = intervals.containing(points, ranges, "x", "lo", "hi", same=["k"], figures=figures)
    assert sorted(tuple(r) for r in found.select("id", *figures).collect()) == sorted(want) and len(want) > 50
    assert intervals.containing(points, ranges.where("false"), "x", "lo", "hi", same=["k"], figures=figures).count() == 0
    with pytest.raises(ValueError, match="points and figures"):
        intervals.containing(points, ranges, "x", "lo", "hi", figures={"ID": ("count", F.lit(1))})


def test_figures_make_no_pairs(spark):
    """4 million pairs of few amounts and ranges: no operator may put out as many rows."""
    points = spark.range(2000).select("id", (F.col("id") % 7 + 10).alias("x"))
    ranges = spark.range(2000).select(F.col("id").alias("j"), (F.col("id") % 10).alias("lo"), (F.col("id") % 11 + 16).alias("hi"))
    found = intervals.containing(points, ranges, "x", "lo", "hi", figures={"n": ("count", F.lit(1))})
    assert found.agg(F.sum("n"), F.count("*")).first()[:] == (4_000_000, 2000)
    assert not {"j", "lo"} & set(found.columns) and "Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()
