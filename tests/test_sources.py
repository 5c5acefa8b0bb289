"""Files in and out."""

import json

from pyspark.sql import functions as F

from furrow.plans import assistant, dashboard
from furrow.sources import datasets, documents, files
from tests.data import COST_ROWS, SOIL_ROWS, VARIETY_ROWS, write_quoted


def test_csv_cells(spark, tmp_path):
    path = write_quoted(tmp_path / "a.csv", ["Name ", "v"], [["Eggs, Fish", "1"], ['say "hi"', "NA"], ["", ""]])
    df = files.read_csv(spark, path)
    assert df.columns == ["Name", "v"] and {t for _, t in df.dtypes} == {"string"}
    assert [tuple(r) for r in df.collect()] == [("Eggs, Fish", "1"), ('say "hi"', None), (None, None)]


def test_csv_round_trip_keeps_space_quotes_and_gaps(spark, tmp_path):
    rows = [(" padded ", 1.5), ('a "quoted", cell', None), (None, -2.0), ("back\\slash", 0.1)]
    df = spark.createDataFrame(rows, "name string, v double")
    files.write_csv(df, f"{tmp_path}/out")
    files.write_csv(df, f"{tmp_path}/out")
    back = files.read_csv(spark, f"{tmp_path}/out", ["name", "v"])
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(
        [(n, None if v is None else str(v)) for n, v in rows], key=repr
    )


def test_csv_line_ends_inside_quotes(spark, tmp_path):
    path = write_quoted(tmp_path / "a.csv", ["a", "b"], [["one\ntwo", "x"]])
    assert files.read_csv(spark, path, multi_line=True).first().a == "one\ntwo"


def test_file_order(spark, tmp_path):
    for name in ("b", "a"):
        write_quoted(tmp_path / f"{name}.csv", ["v"], [[f"{name}{i:05}"] for i in range(20_000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.read_csv(spark, str(tmp_path), ["v"], with_order=True)
        assert rows.rdd.getNumPartitions() > 4
        got = [r.v for r in rows.orderBy(*files.FILE_ORDER).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"{n}{i:05}" for n in "ab" for i in range(20_000)]


def test_table_bundle(spark, tmp_path):
    tables = {"one": spark.range(3).toDF("a"), "two": spark.range(2).toDF("b")}
    files.write_tables(tables, f"{tmp_path}/deep/base")
    files.write_tables(tables, f"{tmp_path}/deep/base")
    back = files.read_tables(spark, f"{tmp_path}/deep/base", ["one", "two"])
    assert [back["one"].count(), back["two"].count()] == [3, 2]


def test_log(spark, tmp_path):
    messages = spark.createDataFrame([("user", "price of wheat"), ("error", "  ")], "type string, message string")
    for _ in range(2):
        files.append_log(messages, f"{tmp_path}/log")
    log = files.read_log(spark, f"{tmp_path}/log")
    assert log.count() == 4 and log.where("timestamp IS NULL").count() == 0
    assert [tuple(r) for r in assistant.count_intents(log).collect()] == [("market", 2)]
    shown = assistant.display(log, "Helper").select("speaker", "message").distinct()
    assert sorted(map(tuple, shown.collect())) == [("Error", "  "), ("You", "price of wheat")]


def test_nested_json(spark):
    inner = {"cells": [{"cell_type": "markdown", "source": ["# a\n", "b"]}, {"cell_type": "code", "source": []}]}
    text = json.dumps(inner, indent=1)
    pieces = [text[i : i + 7] for i in range(0, len(text), 7)]
    good = json.dumps({"cells": [{"source": pieces}, {"source": ["ignored"]}], "nbformat": 4})
    rows = [
        ("good", good),
        ("bad inner", json.dumps({"cells": [{"source": ['{"cells": [']}]})),
        ("bad outer", good[:-9]),
        ("no cells", json.dumps({"cells": []})),
        ("missing", None),
    ]
    df = documents.unwrap_json(spark.createDataFrame(rows, "id string, d string"), "d", ["id"])
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert [g for g in got if g[0] == "good"] == [
        ("good", False, 0, "markdown", "# a\nb"), ("good", False, 1, "code", "")
    ]
    assert [g for g in got if g[0] != "good"] == [
        (name, True, None, None, None) for name in ("bad inner", "bad outer", "missing", "no cells")
    ]
    assert documents.bad_documents(df).first()[0] == 4


def test_raw_tables(spark, tmp_path):
    costs = datasets.read_cost_yield(spark, write_quoted(tmp_path / "c.csv", list("abcdef"), COST_ROWS))
    assert sorted(map(tuple, costs.collect())) == sorted(COST_ROWS)

    header = ["District ", "Zn %", "Fe%", "Cu %", "Mn %", "B %", "S %"]
    soil = datasets.read_soil(spark, write_quoted(tmp_path / "s.csv", header, SOIL_ROWS))
    assert tuple(soil.where("district = 'Nowhere'").first())[1:] == (None,) * 6

    header = ["Crop   ", *[f"{m} {y}" for m in datasets.MEASURES for y in datasets.MEASURE_YEARS]]
    row = ["Arhar ", *[str(v) for v in range(14)], "98.09999999999999"]
    measures = datasets.read_measures(spark, write_quoted(tmp_path / "m.csv", header, [row]))
    assert [tuple(r) for r in measures.orderBy("year").collect()] == [
        ("Arhar", y, float(i), float(i + 5), 98.1 if i == 4 else float(i + 10))
        for i, y in enumerate(datasets.MEASURE_YEARS)
    ]

    header = ["Crop", "Variety", "Season/ duration in days", "Recommended Zone", ""]
    rows = [(*r, "") for r in VARIETY_ROWS]
    varieties = datasets.read_varieties(spark, write_quoted(tmp_path / "v.csv", header, rows))
    got = {r.variety: (r.min_days, r.max_days, r.states) for r in varieties.collect()}
    assert got["wet"] == (None, None, ["Kerala", "Manipur", "Mizoram", "Tripura"])
    assert got["blank"] == (None, None, [])
    assert got["late"][:2] == (100, 110)
    assert got["hill"] == (150, 165, ["Jammu and Kashmir", "Meghalaya", "Nagaland"])
    assert got["plain"] == (None, None, ["Maharashtra", "Punjab"])
    assert got["short"][2] == ["Goa", "Madhya Pradesh", "Tamil Nadu", "Uttar Pradesh"]
    assert got["dry"][2] == ["Andhra Pradesh", "Karnataka", "Kerala", "Tamil Nadu"]


def test_dashboard(spark):
    prices = spark.createDataFrame(
        [("Oats", "Northgate", 1900, 2050, "up", 1.5), ("Leek", "Hillside", 700, 1300, None, 3.2)],
        "crop string, mandi string, minPrice int, maxPrice int, trend string, change double",
    )
    assert [tuple(r) for r in dashboard.price_table(prices).collect()] == [
        ("Oats", "Northgate", "1,900", "2,050", "up", "1.5%"), ("Leek", "Hillside", "700", "1,300", "down", "3.2%")
    ]
    demand = spark.createDataFrame([("Dates", 11, -2), ("Saffron", 41, 9), ("Millet", 20, 0)], "name string, demand int, growth int")
    assert [tuple(r) for r in dashboard.demand_table(demand, 2).collect()] == [
        ("Saffron", 41, "up", 9), ("Millet", 20, "down", 0)
    ]
    days = [("Mon", 18, "Sunny", 5), ("Tue", 17, "Partly Cloudy", 30), ("Wed", 15, "Rainy", 70)]
    weather = spark.createDataFrame([((18, "Sunny", 50, 8), days)], datasets.WEATHER)
    assert [(r.pos, r.day, r.icon) for r in dashboard.forecast_table(weather).orderBy("pos").collect()] == [
        (0, "Mon", "sun"), (1, "Tue", "cloud"), (2, "Wed", "drop")
    ]
    schemes = spark.createDataFrame([("MSP", "x", "2023-09-30")], "title string, description string, deadline string")
    now = F.lit("2023-09-20 12:00:00").cast("timestamp")
    assert tuple(dashboard.scheme_table(schemes, now).first()) == ("MSP", "x", "2023-09-30", 10, "10 days left", "normal")


def test_columns_are_found_by_each_files_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('crop ,state,x\nRice,Goa,1\nRice,Goa,1,9,extra\n\nOat\n"Eggs, ""big""",Goa,NA\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("\ufeffstate,x,crop,more\nBihar,2,Oat,m\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("state,crop\nBihar,Oat\n", encoding="utf-8")
    rows, rejected = files.read_csv_by_header(spark, str(tmp_path), ["crop", "state", "x"])
    assert sorted(map(tuple, rows.collect()), key=str) == [("Eggs, \"big\"", "Goa", None), ("Oat", "Bihar", "2"), ("Rice", "Goa", "1")]
    got = sorted((r.file[-5:], r.line, r.n_cells, r.n_header, r.text, r.missing) for r in rejected.collect())
    assert got == [("a.csv", 3, 5, 3, "Rice,Goa,1,9,extra", None), ("a.csv", 5, 1, 3, "Oat", None), ("c.csv", 1, 2, 2, "state,crop", ["x"])]


def test_lines_of_files_in_many_blocks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,v\n" + "".join(f"{i},{'x' if i % 100 else 'x,y'}\n" for i in range(2, 20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows, rejected = files.read_csv_by_header(spark, str(tmp_path), ["v", "n"])
        assert rows.count() == 19_998 - 199
        assert all(r.line == int(r.text.split(",")[0]) and r.n_cells == 3 for r in rejected.collect()) and rejected.count() == 199
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
