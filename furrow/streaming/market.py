"""Market prices as a stream (our definition; the figures are those of the batch form)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from furrow.operators.timeseries import price_figures


def read_stream(
    spark: SparkSession, path: str, schema: StructType, format: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """The files as a stream. Without a limit all files that are there form one batch, so their order is no matter.

    With a limit the watermark moves on between batches, and rows of a later file that lie behind it are dropped;
    :func:`finish` tells.
    """
    reader = spark.readStream.schema(schema).format(format)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def price_windows(
    prices: DataFrame, keys: Sequence[str], moment: str, price: str, length: str = "1 day", lateness: str = "1 hour"
) -> DataFrame:
    """Price figures per key and window. A window is given out once the watermark has passed
    its end; rows that come later are dropped, and counted by :func:`finish`."""
    return (
        prices.withColumn(moment, F.col(moment).cast("timestamp"))
        .withWatermark(moment, lateness)
        .groupBy(F.window(moment, length), *keys)
        .agg(*price_figures(price))
        .select(F.col("window.start").alias("bucket"), *keys, "min_price", "max_price", "avg_price", "n_prices")
    )


def write_windows(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to a parquet table, working through what is there now."""
    return (
        windows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def finish(query: StreamingQuery) -> None:
    """Wait for a query over what is there now; rows dropped behind the watermark are an error, not a silent loss.

    Spark keeps the progress of the last batches only, so a query with more batches than that is an error too: there set
    ``spark.sql.streaming.numRecentProgressUpdates`` higher, or use :func:`write_arrivals`, which drops nothing.
    """
    query.awaitTermination()
    seen = query.recentProgress
    dropped = sum(state["numRowsDroppedByWatermark"] for batch in seen for state in batch["stateOperators"])
    if dropped:
        raise RuntimeError(f"{dropped} groups of late rows were dropped: allow more lateness, or more files in a batch")
    if len(seen) >= int(SparkSession.active().conf.get("spark.sql.streaming.numRecentProgressUpdates")) - 1:
        raise RuntimeError(f"only the progress of the last {len(seen)} batches is kept; late rows of earlier ones cannot be told")


def write_arrivals(prices: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all rows of a stream to a parquet table, each with the time of its batch as ``arrival``.

    There is no state and no watermark, so no row is ever dropped; the sink's log keeps a batch that runs again from
    counting twice, and gives it the same arrival. See :func:`revisions`.
    """
    return write_windows(prices.withColumn("arrival", F.current_timestamp()), path, checkpoint)


def _window_end(bucket: str, length: str) -> Column:
    return F.col(bucket) + F.expr(f"INTERVAL {length}")


def revisions(
    arrivals: DataFrame, keys: Sequence[str], moment: str, price: str, length: str = "1 day", lateness: str = "1 hour"
) -> DataFrame:
    """What each batch adds to each window: bucket, keys, arrival, is_late, min_price, max_price, sum_price, n_prices.

    A window closes once rows at least ``lateness`` behind its end have arrived in an earlier batch; what comes for it later
    is a correction, ``is_late``. All figures add up in any order, so windows and corrections together are the batch result.
    Rows without a time are in no window.
    """
    rows = arrivals.where(F.col(moment).isNotNull()).withColumn(moment, F.col(moment).cast("timestamp"))
    # One row per batch of the stream, so the running greatest time is a small window.
    before = Window.orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    marks = rows.groupBy("arrival").agg(F.max(moment).alias("__latest")).select("arrival", F.max("__latest").over(before).alias("__mark"))
    parts = rows.groupBy(F.window(moment, length).alias("__w"), *keys, "arrival").agg(
        F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.sum(price).alias("sum_price"), F.count(price).alias("n_prices")
    )
    is_late = F.coalesce(F.col("__w.end") <= F.col("__mark") - F.expr(f"INTERVAL {lateness}"), F.lit(False))
    return parts.join(marks, "arrival").select(
        F.col("__w.start").alias("bucket"), *keys, "arrival", is_late.alias("is_late"), "min_price", "max_price", "sum_price", "n_prices"
    )


def settled(revised: DataFrame, keys: Sequence[str], latest: Column, length: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Windows that are closed at time ``latest`` with their corrections: the figures of :func:`price_windows`, n_late and n_corrections."""
    closed = revised.where(_window_end("bucket", length) <= latest - F.expr(f"INTERVAL {lateness}"))
    return closed.groupBy("bucket", *keys).agg(
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
        F.try_divide(F.sum("sum_price"), F.sum("n_prices")).alias("avg_price"),
        F.sum("n_prices").alias("n_prices"),
        F.sum(F.when(F.col("is_late"), F.col("n_prices")).otherwise(0)).alias("n_late"),
        F.count_if("is_late").alias("n_corrections"),
    )
