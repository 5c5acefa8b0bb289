"""The stream gives what the batch gives for the windows that are closed."""

import datetime

import pytest
from pyspark.sql import functions as F

from furrow.operators import timeseries
from furrow.streaming import market


def test_windows_match_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(hours=3 * i), "ab"[i % 2], float(i % 11)) for i in range(80)]
    df = spark.createDataFrame(rows, "ts timestamp, crop string, price double")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    prices = market.read_stream(spark, f"{tmp_path}/in", df.schema, files_per_batch=10)
    windows = market.price_windows(prices, ["crop"], "ts", "price")
    market.write_windows(windows, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r.bucket, r.crop): (r.min_price, r.max_price, r.avg_price, r.n_prices)
           for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = timeseries.price_buckets(df, ["crop"], "ts", "price", change=False)
    closed = rows[-1][0] - datetime.timedelta(hours=1)
    expected = {(r.bucket, r.crop): (r.min_price, r.max_price, r.avg_price, r.n_prices) for r in batch.collect()
                if r.bucket + datetime.timedelta(days=1) <= closed}
    assert got == expected and len(got) == 18


def test_resumes_from_checkpoint(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)

    def add(day):
        rows = [(start + datetime.timedelta(days=day, hours=h), "a", float(h)) for h in range(0, 24, 6)]
        spark.createDataFrame(rows, "ts timestamp, crop string, price double").write.mode("append").parquet(f"{tmp_path}/in")

    def work():
        schema = "ts timestamp, crop string, price double"
        prices = market.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        windows = market.price_windows(prices, ["crop"], "ts", "price")
        market.write_windows(windows, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return sorted(r.bucket.day for r in spark.read.schema(windows.schema).parquet(f"{tmp_path}/out").collect())

    add(0)
    assert work() == []
    add(1)
    assert work() == [1]
    add(2)
    assert work() == [1, 2]


def _feeds(spark, path, n):
    """Files whose rows are out of time order: the first file holds the latest rows."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(hours=6 * i), "a", float(i)) for i in range(4 * n)]
    for k in range(n):
        part = spark.createDataFrame(rows[4 * (n - 1 - k) : 4 * (n - k)], "ts timestamp, crop string, price double")
        part.coalesce(1).write.mode("append").parquet(path)
    return part.schema


def test_files_out_of_time_order_lose_nothing(spark, tmp_path):
    schema = _feeds(spark, f"{tmp_path}/in", 4)
    windows = market.price_windows(market.read_stream(spark, f"{tmp_path}/in", schema), ["crop"], "ts", "price")
    market.finish(market.write_windows(windows, f"{tmp_path}/out", f"{tmp_path}/state"))
    assert spark.read.parquet(f"{tmp_path}/out").selectExpr("sum(n_prices)").first()[0] == 12  # the last day is open


def test_rows_behind_the_watermark_are_told(spark, tmp_path):
    schema = _feeds(spark, f"{tmp_path}/in", 4)
    prices = market.read_stream(spark, f"{tmp_path}/in", schema, files_per_batch=1)
    windows = market.price_windows(prices, ["crop"], "ts", "price")
    with pytest.raises(RuntimeError, match="late rows"):
        market.finish(market.write_windows(windows, f"{tmp_path}/out", f"{tmp_path}/state"))


def test_rows_that_come_late_are_corrections(spark, tmp_path):
    """Any order of the files gives the batch figures; what comes after its window closed is counted as late."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(hours=5 * i), "ab"[i % 2], float(i % 7)) for i in range(60)] + [(None, "a", 1.0)]
    df = spark.createDataFrame(rows, "ts timestamp, crop string, price double")
    batch = {(r.bucket, r.crop): (r.min_price, r.max_price, r.avg_price, r.n_prices)
             for r in timeseries.price_buckets(df.dropna(), ["crop"], "ts", "price", change=False).collect()}
    latest = max(r[0] for r in rows if r[0])
    closed = {k: v for k, v in batch.items() if k[0] + datetime.timedelta(hours=25) <= latest}
    late = {}
    for name, order in (("up", [0, 1, 2]), ("down", [2, 1, 0]), ("mixed", [1, 2, 0])):
        for part in order:
            some = spark.createDataFrame(rows[20 * part : 20 * part + 20] + rows[60:] * (part == 1), df.schema)
            some.write.mode("append").parquet(f"{tmp_path}/{name}/in")
            prices = market.read_stream(spark, f"{tmp_path}/{name}/in", df.schema)
            market.write_arrivals(prices, f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/state").awaitTermination()
        arrivals = spark.read.parquet(f"{tmp_path}/{name}/out")
        assert arrivals.count() == 61 and arrivals.select("arrival").distinct().count() == 3
        revised = market.revisions(arrivals, ["crop"], "ts", "price")
        got = market.settled(revised, ["crop"], F.lit(latest)).collect()
        assert {(r.bucket, r.crop): (r.min_price, r.max_price, pytest.approx(r.avg_price), r.n_prices) for r in got} == closed
        late[name] = sum(r.n_late for r in got)
    assert late["up"] == 0 < late["mixed"] < late["down"]


def test_a_query_with_more_batches_than_progress_is_an_error(spark, tmp_path):
    schema = _feeds(spark, f"{tmp_path}/in", 3)
    prices = market.read_stream(spark, f"{tmp_path}/in", schema, files_per_batch=1)
    windows = market.price_windows(prices, ["crop"], "ts", "price", lateness="30 days")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        with pytest.raises(RuntimeError, match="progress"):
            market.finish(market.write_windows(windows, f"{tmp_path}/out", f"{tmp_path}/state"))
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
