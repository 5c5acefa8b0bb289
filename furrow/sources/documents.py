"""JSON documents that hold another JSON document as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTER = "cells array<struct<source: array<string>>>, __bad string"
INNER = "cells array<struct<cell_type: string, source: array<string>>>, __bad string"
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}


def unwrap_json(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Cells of the JSON document held as a list of strings by the first cell of another.

    One row per inner cell: its position, type and joined source. A document that cannot be
    read gives one row without a cell, with ``is_bad`` set.
    """
    outer = F.from_json(F.col(column), OUTER, OPTIONS)
    opened = df.select(*keep, outer.alias("__outer"))
    text = F.array_join(F.get(F.col("__outer.cells"), 0)["source"], "")
    parsed = opened.select(*keep, "__outer", F.from_json(text, INNER, OPTIONS).alias("__inner"))
    is_bad = (
        F.col("__outer.__bad").isNotNull()
        | F.col("__inner.__bad").isNotNull()
        | F.col("__inner.cells").isNull()
    )
    cells = F.when(~is_bad, F.col("__inner.cells"))
    return parsed.select(*keep, is_bad.alias("is_bad"), F.posexplode_outer(cells).alias("pos", "__cell")).select(
        *keep,
        "is_bad",
        "pos",
        F.col("__cell.cell_type").alias("cell_type"),
        F.array_join("__cell.source", "").alias("source"),
    )


def bad_documents(unwrapped: DataFrame) -> DataFrame:
    """How many documents could not be read."""
    return unwrapped.agg(F.count_if("is_bad").alias("n_bad"))
