"""Profiles from stored sketches against exact ones."""

import random

from pyspark.sql import functions as F

from furrow.operators import sketches

ROWS = "day int, name string, x double, n long"


def test_profile_of_a_grown_table(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i % 6, rng.choice([None, f"v{rng.randrange(3000)}"]), rng.choice([None, float("nan"), rng.gauss(0, 5)]), rng.randrange(10**12)) for i in range(20000)]
    df = spark.createDataFrame(rows, ROWS)
    path = str(tmp_path / "sketches")
    sketches.keep(sketches.sketch(df.where("day < 3"), ["name", "x", "n"], "day"), path)
    sketches.keep(sketches.sketch(df.where("day >= 3"), ["name", "x", "n"], "day"), path)
    sketches.keep(sketches.sketch(df.where("day = 5"), ["name", "x", "n"], "day"), path)  # again: replaced, not added
    got = {r.column: r for r in sketches.profile(sketches.kept(spark, path), [0.1, 0.5, 0.9]).collect()}
    values = {
        "name": [r[1] for r in rows if r[1] is not None],
        "x": [r[2] for r in rows if r[2] is not None and r[2] == r[2]],
        "n": [float(r[3]) for r in rows],
    }
    for column, known in values.items():
        row = got[column]
        exact = len(set(known))
        assert (row.n_rows, row.n_missing) == (20000, 20000 - len(known))
        assert abs(row.n_distinct - exact) <= 4 * 1.04 / 2 ** (sketches.HLL_BITS / 2) * exact
        if column == "name":
            assert row.quantiles is None and row.least is None
            continue
        assert (row.least, row.greatest) == (min(known), max(known))
        for p, value in zip((0.1, 0.5, 0.9), row.quantiles):
            assert abs(sum(v <= value for v in known) / len(known) - p) < 0.03


def test_parts_merge_to_the_same_as_one(spark):
    df = spark.range(5000).select((F.col("id") % 9).cast("int").alias("day"), (F.col("id") % 700).alias("n"))
    many = sketches.profile(sketches.sketch(df, ["n"], "day")).first()
    one = sketches.profile(sketches.sketch(df.withColumn("day", F.lit(1)), ["n"], "day")).first()
    assert many.n_distinct == one.n_distinct and many.n_rows == one.n_rows == 5000


def test_parts_without_values_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None, None), (None, "a", -0.0, 1), (None, "a", 0.0, 1)], ROWS)
    got = {r.column: r for r in sketches.profile(sketches.sketch(df, ["name", "x", "n"], "day")).collect()}
    assert (got["x"].n_rows, got["x"].n_missing, got["x"].n_distinct) == (3, 1, 1)
    alone = sketches.profile(sketches.sketch(df.where("day = 1"), ["x"], "day")).first()
    assert (alone.n_distinct, alone.least, alone.quantiles) == (0, None, None)
    assert sketches.profile(sketches.sketch(df.where("false"), ["x"], "day")).count() == 0
