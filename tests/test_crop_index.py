"""The index run against the shipped results."""

import statistics

import pytest

from furrow.operators import profile, stats
from furrow.plans import crop_index
from furrow.sources import datasets, files
from tests.data import INDEX_HEADER, INDEX_ROWS, SUMMARY_ROWS, write_quoted


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = write_quoted(tmp_path_factory.mktemp("raw") / "index.csv", INDEX_HEADER, INDEX_ROWS)
    raw = datasets.read_index_wide(spark, path)
    return {name: df.cache() for name, df in crop_index.crop_index(raw, files.FILE_ORDER).items()}


def test_wide(tables):
    assert tables["wide"].columns == ["Crop", *[f"Year_{y}" for y in INDEX_HEADER[1:]]]
    rows = {tuple(r) for r in tables["wide"].collect()}
    assert rows == {(r[0].strip(), *map(float, r[1:])) for r in INDEX_ROWS[:-1]}


def test_long_is_exact(tables):
    expected = set()
    for name, *cells in INDEX_ROWS[:-1]:
        values = [float(c) for c in cells]
        for i, (year, value) in enumerate(zip(INDEX_HEADER[1:], values)):
            change = (value / values[i - 1] - 1) * 100 if i else None
            expected.add((name.strip(), year, value, change, value / values[0] * 100))
    assert {tuple(r) for r in tables["long"].collect()} == expected
    # Cells of the shipped long table.
    assert ("All Agriculture", "2005-06", 99.0, -1.0000000000000009, 99.0) in expected
    assert ("Rice", "2011-12", 110.0, -5.982905982905984, 110.00000000000001) in expected


def test_summary_is_exact(tables):
    assert sorted(tuple(r) for r in tables["summary"].collect()) == SUMMARY_ROWS


def test_report_and_profile(tables):
    report = crop_index.report(tables["wide"], tables["long"]).first().asDict()
    assert report == {
        "n_records": 96, "first_year": "2004-05", "last_year": "2011-12",
        "n_missing": 12, "n_crops": 12, "n_duplicates": 0,
    }
    figures = {r.metric: r.value for r in profile.describe(tables["long"], ["Index_Value"]).collect()}
    values = [float(c) for r in INDEX_ROWS[:-1] for c in r[1:]]
    assert figures["count"] == 96 and figures["mean"] == 108.8125
    assert figures["std"] == pytest.approx(statistics.stdev(values), abs=1e-12)
    assert (figures["25%"], figures["75%"]) == (100.0, 117.25)


def test_outlier(tables):
    bounds = stats.iqr_bounds(tables["long"], "Index_Value").first()
    assert (bounds.lower, bounds.upper) == (74.125, 143.125)
    found = stats.iqr_outliers(tables["long"], "Index_Value").collect()
    assert [(r.Crop, r.Year, r.Index_Value) for r in found] == [("Pulses", "2009-10", 146.0)]


def test_steps_keep_their_order(spark):
    raw = spark.createDataFrame(
        [("Rice", "10", "x"), ("Rice", "10", "x"), ("Rice ", "10", "4"), ("Oat", "", "8"), (None, None, None)],
        "Crop string, `2001` string, `2002` string",
    )
    wide = crop_index.clean_wide(raw)
    # Means come before duplicates go, so the repeated row counts twice; names are trimmed last.
    assert sorted(tuple(r) for r in wide.collect()) == [
        ("Oat", 10.0, 8.0), ("Rice", 10.0, 4.0), ("Rice", 10.0, 6.0)
    ]
    raw = spark.createDataFrame([("Rice", "1"), ("Rice ", "1"), ("Oat", "7")], "Crop string, `2001` string")
    assert crop_index.clean_wide(raw).count() == 3
    assert crop_index.clean_wide(raw, trim_first=True).count() == 2


def test_missing_key_takes_the_one_before(spark):
    raw = spark.createDataFrame(
        [(1, "Rice", "1"), (2, None, "2"), (3, "Oat", "3")], "n int, Crop string, `2001` string"
    )
    wide = crop_index.clean_wide(raw, ["n"])
    assert sorted(tuple(r) for r in wide.collect()) == [("Oat", 3.0), ("Rice", 1.0), ("Rice", 2.0)]


def test_run_writes_three_tables(spark, tmp_path):
    path = write_quoted(tmp_path / "index.csv", INDEX_HEADER, INDEX_ROWS)
    crop_index.run(datasets.read_index_wide(spark, path), f"{tmp_path}/out", files.FILE_ORDER, format="csv")
    back = files.read_tables(spark, f"{tmp_path}/out", ["wide", "long", "summary"])
    assert [back[n].count() for n in ("wide", "long", "summary")] == [12, 96, 12]
    text = files.read_csv(spark, f"{tmp_path}/out/summary_csv")
    assert sorted(r.Crop for r in text.collect()) == [r[0] for r in SUMMARY_ROWS]


def test_repeated_names_follow_the_file(spark):
    """Rows whose names become one by trimming or filling: the first of equal rows comes first, then file order."""
    raw = [(3, "Rice ", "30"), (1, "Rice", "10"), (2, "Oat", "5"), (4, None, "40"), (5, "Rice", "10"), (6, "Oat ", "8")]
    want = [("Oat", 5.0, None), ("Oat", 8.0, 60.0), ("Rice", 10.0, None), ("Rice", 30.0, 200.0), ("Rice", 40.0, 33.333)]
    for n in (1, 2, 3, 7):
        df = spark.createDataFrame(raw, "n int, Crop string, `2001` string").repartition(n)
        long = crop_index.crop_index(df, ["n"])["long"]
        got = sorted((r.Crop, r.Index_Value, r.YoY_Pct_Change and round(r.YoY_Pct_Change, 3)) for r in long.collect())
        assert got == want


def test_without_an_order_the_values_decide(spark):
    raw = [("Rice ", "30", "1"), ("Rice", "10", "2"), ("Rice  ", "20", "3")]
    results = set()
    for n in (1, 2, 3, 5):
        df = spark.createDataFrame(raw, "Crop string, `2001` string, `2002` string").repartition(n)
        results.add(str(sorted(map(str, crop_index.crop_index(df)["long"].collect()))))
    assert len(results) == 1


def test_run_writes_statistics_too(spark, tmp_path):
    path = write_quoted(tmp_path / "index.csv", INDEX_HEADER, INDEX_ROWS)
    crop_index.run(datasets.read_index_wide(spark, path), f"{tmp_path}/out", files.FILE_ORDER)
    back = files.read_tables(spark, f"{tmp_path}/out", ["long", "describe", "crop_stats", "outliers", "report"])
    assert [back[n].count() for n in ("describe", "crop_stats", "report")] == [24, 12, 1]
    assert back["report"].first().asDict()["n_records"] == 96
    rows = [(r.Crop, r.Year) for r in back["long"].collect()]
    assert rows == sorted(rows)
    assert back["outliers"].count() == crop_index.outliers(back["long"]).count()
