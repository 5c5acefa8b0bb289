"""Assistant messages: topics, counts and display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import labels as L
from furrow.operators.clean import keep_with_text


def label_messages(messages: DataFrame, text: str = "message") -> DataFrame:
    """Messages with text, and the topic of each."""
    return keep_with_text(messages, text).withColumn("intent", L.intent(F.col(text)))


def count_intents(messages: DataFrame, text: str = "message") -> DataFrame:
    return label_messages(messages, text).groupBy("intent").agg(F.count(F.lit(1)).alias("n_messages"))


def display(log: DataFrame, assistant: str = "Assistant") -> DataFrame:
    return log.select(
        L.speaker(F.col("type"), assistant).alias("speaker"),
        L.short_time(F.col("timestamp")).alias("time"),
        "message",
    )
