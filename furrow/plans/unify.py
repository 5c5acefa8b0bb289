"""One table from the index, cost, measure and variety tables (our definition)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.values import CROP_ALIASES
from furrow.operators import keys
from furrow.operators.farming import variety_by_state


def one_per_key(df: DataFrame, by: list[str], figures: dict[str, str]) -> DataFrame:
    """Means of the figures, one row per key, so that a join cannot repeat rows."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(name) for name, c in figures.items()])


def unified(
    costs: DataFrame, index: DataFrame, measures: DataFrame, varieties: DataFrame, aliases=CROP_ALIASES
) -> DataFrame:
    """Every cost row with the mean index, mean measures and varieties of its crop.

    ``costs`` is per crop and state in rupees and quintals; ``index`` and ``measures`` are index
    numbers, so their columns keep ``index`` in their names. The number of rows stays the same.
    """
    left = keys.with_key(costs, "crop", aliases=aliases)
    by_index = one_per_key(keys.with_key(index, "Crop", aliases=aliases), ["crop_key"],
                           {"mean_index": "Index_Value"})
    by_measure = one_per_key(keys.with_key(measures, "crop", aliases=aliases), ["crop_key"],
                             {"production_index": "production", "area_index": "area", "yield_index": "yield"})
    named = keys.with_key(varieties, "crop", aliases=aliases).drop("crop").withColumnRenamed("crop_key", "crop")
    by_state = variety_by_state(named).withColumnRenamed("crop", "crop_key")
    table = keys.join_on_key(left, by_index, "crop_key")
    table = keys.join_on_key(table, by_measure, "crop_key")
    return keys.join_on_key(table, by_state, ["crop_key", "state"])
