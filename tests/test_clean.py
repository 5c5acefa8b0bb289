"""Edge rows of the cleaning, profiling and reshaping operators."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import labels as L
from furrow.functions import text as X
from furrow.functions.numbers import round_half_even
from furrow.operators import clean, profile, reshape, timeseries


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("cell,number", [
    ("", None), (" 5 ", 5.0), ("\t7 ", 7.0), ("NA", None), ("-", None), ("1.0d", None), ("1,000", None),
    ("1e3", 1000.0), ("NaN", None), ("-.5", -0.5), ("5.", 5.0), ("+2", 2.0), ("inf", float("inf")), (None, None),
    ("0x10", None), ("1 2", None), ("1e", None),
])
def test_to_number(spark, cell, number):
    assert one(spark, X.to_number(F.lit(cell).cast("string"))) == number


@pytest.mark.parametrize("text,bare", [
    ("Rice ", "Rice"), ("\t Rice\n", "Rice"), (" Rice ", "Rice"), ("a  b", "a  b"), ("\x1cRice\x1f", "Rice"), (" ", ""),
])
def test_strip_matches_python(spark, text, bare):
    assert text.strip() == bare
    assert one(spark, X.strip(F.lit(text))) == bare


def test_to_numeric_of_each_type(spark):
    df = spark.createDataFrame([("1", 2, float("nan")), ("x", 3, 1.5)], "a string, b int, c double")
    out = clean.to_numeric(df, ["a", "b", "c"])
    assert out.dtypes == [("a", "double"), ("b", "double"), ("c", "double")]
    assert [tuple(r) for r in out.collect()] == [(1.0, 2.0, None), (None, 3.0, 1.5)]


def test_blank_rows(spark):
    df = spark.createDataFrame([("", "NA", None), ("", "x", None), (None, None, 1.0)], "a string, b string, c double")
    kept = clean.drop_blank_rows(clean.blank_to_null(df))
    assert [tuple(r) for r in kept.collect()] == [(None, "x", None), (None, None, 1.0)]


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], "` Crop ` int, `2004-05 ` int")
    assert clean.rename_by_position(clean.trim_headers(df)).columns == ["Crop", "Year_2004-05"]


def test_raw_headers(spark):
    """Names with dots, back-ticks and spaces, as raw files have them."""
    names = ["Crop", "Cost (`/Hectare) A2+FL", "Zn %", "a.b"]
    df = spark.createDataFrame([(" x ", "1", "2", ""), ("", "", "", ""), ("y", "3", "NA", "5")], "a string, b string, c string, d string").toDF(*names)
    rows = clean.strip_text(clean.drop_blank_rows(clean.blank_to_null(df)))
    rows = clean.mean_fill(clean.to_numeric(rows, names[1:]), names[1:])
    assert sorted(map(tuple, rows.collect())) == [("x", 1.0, 2.0, 5.0), ("y", 3.0, 2.0, 5.0)]
    assert {r.column: r.n_distinct for r in profile.columns_report(rows).collect()} == dict(zip(names, (2, 2, 1, 1)))
    assert {r.column for r in profile.describe(rows, names[1:], search_from=0).collect()} == set(names[1:])
    assert profile.duplicate_count(rows).first()[0] == 0 and profile.missing_total(rows).first()[0] == 0
    assert profile.distinct_values(rows, "a.b").first()[0] == 5.0
    long = reshape.melt(rows, ["Crop"])
    assert {r.variable for r in long.collect()} == set(names[1:])
    filled = clean.forward_fill(df.withColumn("n", F.monotonically_increasing_id()), "*", ["n"], bounded=True)
    assert filled.columns == [*names, "n"]


def test_mean_fill(spark):
    df = spark.createDataFrame(
        [(1.0, None, 3), (1.0, None, 3), (None, None, None), (float("nan"), None, 6)], "a double, b double, c int"
    )
    filled = clean.mean_fill(df, ["a", "b", "c"])
    assert sorted(tuple(r) for r in filled.fillna(-1.0).collect()) == [
        (1.0, -1.0, 3.0), (1.0, -1.0, 3.0), (1.0, -1.0, 4.0), (1.0, -1.0, 6.0)
    ]
    assert filled.where("b IS NOT NULL").count() == 0


def test_duplicates(spark):
    df = spark.createDataFrame([("Rice", None), ("Rice", None), ("Rice ", None)], "a string, b int")
    assert clean.drop_duplicate_rows(df).count() == 2
    assert clean.drop_duplicate_rows(df, trim_first=True).count() == 1
    assert profile.duplicate_count(df).first()[0] == 1
    assert profile.duplicate_count(df.limit(0)).first()[0] == 0


def test_profile(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), (None, 1.0)], "k string, v double")
    for approximate in (False, True):
        report = {r.column: tuple(r)[1:] for r in profile.columns_report(df, approximate=approximate).collect()}
        assert report == {"k": ("string", 3, 1, 2), "v": ("double", 3, 1, 1)}
    assert tuple(profile.shape(df).first()) == (3, 2)
    assert profile.missing_total(df).first()[0] == 2
    assert tuple(profile.value_range(df, "k").first()) == ("a", "b")
    assert profile.distinct_count(df, "k").first()[0] == 2
    assert {r.k for r in profile.distinct_values(df, "k").collect()} == {"a", "b", None}
    assert [r.k for r in profile.preview(df, [F.desc("k")], 1).collect()] == ["b"]
    assert profile.column_names(df) == ["k", "v"]
    assert profile.column_types(df) == [("k", "string"), ("v", "double")]


def test_melt_keeps_missing_cells(spark):
    df = spark.createDataFrame([("x", 1.0, None), ("y", None, None)], "k string, Year_1 double, Year_2 double")
    long = reshape.remove_text(reshape.melt(df, ["k"], None, "Year", "v"), "Year", "Year_")
    assert sorted((r.k, r.Year, r.v) for r in long.collect() if r.v is None) == [("x", "2", None), ("y", "1", None), ("y", "2", None)]
    assert long.count() == 4


def test_series_edges(spark):
    rows = [
        ("zero", 1, 0.0), ("zero", 2, 5.0), ("gap", 1, None), ("gap", 2, 4.0), ("gap", 3, 6.0),
        ("one", 1, 3.0), (None, 1, 1.0), (None, 2, 2.0),
    ]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    for options in ({"bounded": True}, {"rows_per_task": 1}):
        got = {(r.k, r.t): (r.pct_change, r.base_index)
               for r in timeseries.series_metrics(df, ["k"], ["t"], "v", **options).collect()}
        assert got == {
            ("zero", 1): (None, None), ("zero", 2): (None, None),
            ("gap", 1): (None, None), ("gap", 2): (None, None), ("gap", 3): (50.0, None),
            ("one", 1): (None, 100.0), (None, 1): (None, None), (None, 2): (None, None),
        }


def test_trend(spark):
    df = spark.createDataFrame([("a", x, 2.0 * x + 1) for x in range(5)] + [("a", 9, None), (None, 1, 1.0)], "k string, t int, v double")
    [row] = timeseries.linear_trend(df, ["k"], "t", "v").collect()
    assert (row.k, row["at"]) == ("a", 5.0)
    assert (row.slope, row.intercept, row.forecast) == pytest.approx((2.0, 1.0, 11.0))
    assert [one(spark, timeseries.start_year(F.lit(y))) for y in ("2004-05", "x")] == [2004, None]


def test_deadlines(spark):
    now = F.lit(datetime.datetime(2023, 9, 30, 6, 0, 0)).cast("timestamp")
    cases = {
        "2023-09-30": (0, "Expired", "urgent"), "2023-10-01": (1, "1 days left", "urgent"),
        "2023-10-07": (7, "7 days left", "normal"), "2023-09-01": (-29, "Expired", "urgent"),
        "soon": (None, "Expired", "normal"),
    }
    for text, expected in cases.items():
        days = L.days_left(F.lit(text), now)
        row = spark.range(1).select(days.alias("d"), L.deadline_label(days).alias("l"), L.urgency(days).alias("u")).first()
        assert tuple(row) == expected
    exactly = F.lit(datetime.datetime(2023, 9, 30)).cast("timestamp")
    assert one(spark, L.deadline_label(L.days_left(F.lit("2023-09-30"), exactly))) == "Expired"


@pytest.mark.parametrize("text,icon", [
    ("Sunny", "sun"), ("Partly Cloudy", "cloud"), ("Rainy", "drop"), ("sunny", "drop"), (None, "drop"), ("Cloudy, then Sunny", "sun"),
])
def test_condition(spark, text, icon):
    assert one(spark, L.condition_class(F.lit(text).cast("string"))) == icon


@pytest.mark.parametrize("text,topic", [
    ("Which is this?", "greeting"), ("market weather", "weather"), ("PRICES", "market"), ("advice", "crop"),
    ("a new Scheme", "scheme"), ("pest", "fallback"), (None, "fallback"),
])
def test_intent(spark, text, topic):
    assert one(spark, L.intent(F.lit(text).cast("string"))) == topic


def test_small_labels(spark):
    assert [one(spark, L.growth_direction(F.lit(g))) for g in (1, 0, -3)] == ["up", "down", "down"]
    assert [one(spark, L.trend_direction(F.lit(t).cast("string"))) for t in ("up", "down", "flat", None)] == ["up", "down", "down", "down"]
    assert [one(spark, L.speaker(F.lit(t), "Helper")) for t in ("user", "error", "assistant")] == ["You", "Error", "Helper"]
    assert [one(spark, L.thousands(F.lit(n))) for n in (2150, 900, 1234567, 2.5)] == ["2,150", "900", "1,234,567", "2.5"]
    assert one(spark, L.percent_text(F.lit(2.5))) == "2.5%"
    moment = F.lit("2024-01-02 03:04:05").cast("timestamp")
    assert (one(spark, L.short_time(moment)), one(spark, L.short_date(moment))) == ("03:04", "2024-01-02")


def test_rounding_is_that_of_numpy(spark):
    values = [109.125, 108.125, 1.015, 2.675, -0.125, 98.09999999999999, 1e12 + 0.125, 0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.x for r in df.select(round_half_even(F.col("v"), 2).alias("x")).collect()]
    assert got == [None if v is None else float(np.round(v, 2)) for v in values]


def test_search(spark):
    df = spark.createDataFrame([("Wheat", None), ("rice", "near WHEAT"), (None, None)], "a string, b string")
    assert df.where(X.search([F.col("a"), F.col("b")], "wheat")).count() == 2


def test_money_and_days(spark):
    assert tuple(one(spark, X.money_range(F.lit("₹42,000 - ₹48,000")))) == (42000.0, 48000.0)
    assert tuple(one(spark, X.money_range(F.lit("about 1,250.50")))) == (1250.5, 1250.5)
    assert one(spark, X.money_range(F.lit("none"))) is None
    days = {"120": (120, 120), "145-150": (145, 150), "167 irrigated   & 180 rainfed": (167, 180), "NA": None, "-": None, "Mid-early": None}
    for text, expected in days.items():
        got = one(spark, X.duration_days(F.lit(text)))
        assert (tuple(got) if got else None) == expected


def test_spread_tells_of_two_rows_for_one_cell(spark):
    rows = [("Rice", "area", 5.0), ("Rice", "yield", None), ("Oat", "area", 2.0)]
    table = spark.createDataFrame(rows, "crop string, measure string, v double")
    got = reshape.spread(table, ["crop"], "measure", "v", ["area", "yield"])
    assert sorted(map(tuple, got.collect())) == [("Oat", 2.0, None), ("Rice", 5.0, None)]
    with pytest.raises(Exception, match="several rows for one cell of area"):
        reshape.spread(table.union(table.limit(1)), ["crop"], "measure", "v", ["area", "yield"]).collect()
