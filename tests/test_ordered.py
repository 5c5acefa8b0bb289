"""Values along an order: every way of cutting gives what one window gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from furrow.operators import clean, ordered, reshape

VALUES = {
    "known": ordered.last_known("v"),
    "before": ordered.previous("v"),
    "start": ordered.first("v"),
    "total": ordered.running_sum("w"),
}


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows in one group, missing keys and values, ties in the first order column."""
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "d", None, "alone"] + [f"k{j}" for j in range(50)])
        data.append((key, rng.randrange(20), i, None if rng.random() < 0.4 else float(rng.randrange(100)), rng.randrange(9)))
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, t int, id int, v double, w long").repartition(6).cache()


def expected(df, keys, order):
    window = Window.partitionBy(*keys).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    return {
        r.id: tuple(r)
        for r in df.select(
            "id",
            F.last("v", ignorenulls=True).over(upto).alias("known"),
            F.lag("v").over(window).alias("before"),
            F.first("v").over(upto).alias("start"),
            F.sum("w").over(upto).alias("total"),
        ).collect()
    }


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("rows_per_task", [50, 400, 10_000])
def test_cut_by_range(rows, keys, rows_per_task):
    order = ["t", "id"]
    result = ordered.along(rows, keys, order, VALUES, rows_per_task=rows_per_task)
    assert result.columns == [*rows.columns, *VALUES]
    got = {r.id: tuple(r) for r in result.select("id", *VALUES).collect()}
    assert got == expected(rows, keys, order)


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
@pytest.mark.parametrize("keys", [["k"], []])
def test_cut_by_width(rows, keys, width):
    got = {r.id: tuple(r) for r in ordered.along(rows, keys, ["id"], VALUES, width=width).select("id", *VALUES).collect()}
    assert got == expected(rows, keys, ["id"])


def test_no_task_gets_a_large_group(rows):
    """After the cut no window group holds more rows than its share."""
    parts = rows.where("k = 'hot'").repartitionByRange(8, "k", "t", "id").withColumn("p", F.spark_partition_id())
    assert parts.groupBy("k", "p").count().agg(F.max("count")).first()[0] < 400


def test_order_is_required(rows):
    with pytest.raises(ValueError):
        clean.forward_fill(rows, ["v"], [])


def test_fill_leaves_known_cells_alone(rows):
    filled = clean.forward_fill(rows, ["v"], ["t", "id"], ["k"], rows_per_task=100)
    assert filled.columns == rows.columns
    before = {r.id: r.v for r in rows.collect()}
    after = {r.id: r.v for r in filled.collect()}
    assert before.keys() == after.keys()
    assert all(after[i] == v for i, v in before.items() if v is not None)


def test_leading_and_whole_gaps_stay(spark):
    df = spark.createDataFrame(
        [("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, None), ("b", 2, None)], "k string, t int, v double"
    )
    for options in ({}, {"rows_per_task": 1}, {"bounded": True}):
        filled = clean.forward_fill(df, ["v"], ["t"], ["k"], **options)
        assert sorted((r.k, r.t, r.v) for r in filled.collect()) == [
            ("a", 1, None), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 1, None), ("b", 2, None)
        ]


def test_fill_of_every_column(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, None, None), (3, "y", None)], "t int, a string, v double")
    assert [tuple(r) for r in clean.forward_fill(df, "*", ["t"]).orderBy("t").collect()] == [
        (1, "x", 1.0), (2, "x", 1.0), (3, "y", 1.0)
    ]


@pytest.mark.parametrize("rows_per_task", [100, 10_000])
def test_row_index(rows, rows_per_task):
    numbered = reshape.row_index(rows, ["t", "id"], rows_per_task=rows_per_task).collect()
    in_order = sorted(numbered, key=lambda r: (r.t, r.id))
    assert [r["index"] for r in in_order] == list(range(3000))


def test_sparse_order_with_width_is_cut_by_rows(spark, monkeypatch):
    """As many stretches as rows: ranges of the rows serve as parts, and the result is the same."""
    rows = spark.range(300).select((F.col("id") * 10**9).alias("at"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    monkeypatch.setattr(ordered, "MAX_PARTS", 50)
    got = ordered.along(rows, [], ["at"], {"known": ordered.last_known("v")}, width=100, rows_per_task=40)
    assert all(r.known == r.at // 10**9 // 7 * 7 for r in got.collect())
    plan = ordered.along(rows, [], ["at"], {"known": ordered.last_known("v")}, width=100, rows_per_task=40)
    assert "div" not in plan._jdf.queryExecution().executedPlan().toString()
