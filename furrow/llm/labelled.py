"""Training rows for classifiers: labelled documents outside the held-out fold, at most a stated number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import remainder

#: Rows whose crc32(doc_id) modulo FOLDS is 0 are held out.
FOLDS = 5
#: Most labelled documents a classifier is fitted on; beyond it those with the least hash of the id are taken.
SAMPLE = 20_000


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the held-out fold; a row without an id is not in it, as it can have no label."""
    return F.coalesce(remainder(doc_id, FOLDS) == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of at most ``bound`` training ids: small enough to broadcast.

    Rows with a null id or label are left out; of an id labelled more than once the greatest label counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, value: str, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, label, value) of the training ids found in ``docs``; of rows with one id the greatest value counts."""
    rows = docs.select("doc_id", value).join(F.broadcast(training_labels(labels, label, bound)), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.max(value).alias(value))
