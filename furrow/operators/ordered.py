"""Window values along an order, safe for groups of any size.

Spark evaluates a window group in one task. A group that holds a third of all rows would
therefore be one task. Groups up to ``rows_per_task`` rows go through a plain window; larger
ones are cut into range partitions along the order, each part gets its own window, and what
earlier parts contribute is joined in from a table with one row per part.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.columns import named
from furrow.session import shared_dir

ROWS_PER_TASK = 5_000_000
MAX_PARTS = 50_000  # range partitions are cut from a sample of at most a million rows

GROUP = "__group"
PART = "__part"
NEW_PART = "__new_part"


@dataclass(frozen=True)
class Along:
    """A value taken along the order: its kind and the column it reads."""

    kind: str  # last_known | previous | first | running_sum
    column: str


def last_known(column: str) -> Along:
    """The latest value that is not NULL, up to the row itself."""
    return Along("last_known", column)


def previous(column: str) -> Along:
    """The value of the row before; NULL on the first row."""
    return Along("previous", column)


def first(column: str) -> Along:
    """The value of the first row of the group, NULL or not."""
    return Along("first", column)


def running_sum(column: str) -> Along:
    """The sum up to and including the row."""
    return Along("running_sum", column)


def along(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    values: Mapping[str, Along],
    *,
    bounded: bool = False,
    width: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add one column per entry of ``values``.

    ``order_by`` names columns, ascending, that must order the rows of a group without ties. ``bounded=True`` promises that
    no group exceeds ``rows_per_task`` and saves the count. ``width`` is for a single whole-number
    order column without repeats: stretches of that length hold at most ``width`` rows, so
    they serve as parts, if there are no more than ``MAX_PARTS`` of them, and no range partitioning is needed.
    """
    if not order_by:
        raise ValueError("an order is required: rows have none of their own")
    keys, order_by = list(keys), list(order_by)
    if width:
        part = F.call_function("div", named(order_by[0]), F.lit(int(width)))
        stretches = df.withColumn(PART, part)
        # Sparse order columns can have as many stretches as rows; then ranges of the rows serve as parts.
        if stretches.select(*map(named, keys), PART).distinct().count() <= MAX_PARTS:
            return _across_parts(stretches, keys, order_by, values, small_carry=False)
    if bounded:
        return _plain(df, keys, order_by, values)

    small, large, large_rows = by_size(df, keys, rows_per_task)
    if large is None:
        return _plain(small, keys, order_by, values)
    parts = min(max(2, math.ceil(2 * large_rows / rows_per_task)), MAX_PARTS)
    cut = _by_range(large, keys, order_by, values, parts)
    return cut if small is None else _plain(small, keys, order_by, values).unionByName(cut)


def by_size(
    df: DataFrame, keys: Sequence[str], rows_per_task: int
) -> tuple[DataFrame | None, DataFrame | None, int]:
    """Rows of the small groups, rows of the large groups and their number; None where there are none."""
    sizes = df.groupBy(*map(named, keys)).agg(F.count(F.lit(1)).alias("__n"))
    is_large = F.col("__n") > rows_per_task
    large_rows = sizes.agg(F.sum(F.when(is_large, F.col("__n")))).first()[0]
    if not large_rows:
        return df, None, 0
    if not keys:
        return None, df, large_rows
    # At most (all rows / rows_per_task) groups are large, so their list can be broadcast.
    shared_dir(df.sparkSession)
    large = sizes.where(is_large).select(*[named(k).alias(f"__large_{k}") for k in keys]).checkpoint()
    match = same(keys, large.columns)
    return df.join(F.broadcast(large), match, "left_anti"), df.join(F.broadcast(large), match, "left_semi"), large_rows


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Condition that the columns are equal one by one, a missing value equal to a missing one."""
    condition = F.lit(True)
    for a, b in zip(left, right):
        condition = condition & named(a).eqNullSafe(named(b))
    return condition


def _local(kind: str, column: Column, window) -> Column:
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return {
        "last_known": lambda: F.last(column, ignorenulls=True).over(upto),
        "previous": lambda: F.lag(column).over(window),
        "first": lambda: F.first(column).over(upto),
        "running_sum": lambda: F.sum(column).over(upto),
    }[kind]()


def _plain(df: DataFrame, keys, order_by, values) -> DataFrame:
    window = Window.partitionBy(*map(named, keys)).orderBy(*map(named, order_by))
    added = [_local(value.kind, named(value.column), window).alias(name) for name, value in values.items()]
    return df.select("*", *added)


def _by_range(df: DataFrame, keys, order_by, values, parts: int) -> DataFrame:
    # The checkpoint fixes which row is in which part: both readers below must agree on it.
    shared_dir(df.sparkSession)
    ranged = (
        df.repartitionByRange(parts, *map(named, [*keys, *order_by]))
        .withColumn(PART, F.spark_partition_id())
        .checkpoint()
    )
    return _across_parts(ranged, keys, order_by, values, small_carry=True)


def _across_parts(df: DataFrame, keys, order_by, values, small_carry: bool) -> DataFrame:
    # The keys as one struct: it equals another with the same gaps, so the join below can use
    # the partitioning of the window.
    group = [GROUP] if keys else []
    rows = df.select(
        *[F.struct(*map(named, keys)).alias(GROUP) for _ in group],
        *[named(c) for c in df.columns if c not in keys],
    )
    position = F.struct(*map(named, order_by))

    def at(name: str) -> Column:
        return F.col(GROUP)[name] if name in keys else named(name)

    sums = []
    for name, value in values.items():
        column = at(value.column)
        sums.append({
            "last_known": lambda: F.max_by(column, F.when(column.isNotNull(), position)),
            "previous": lambda: F.max_by(F.struct(column.alias("v")), position),
            "first": lambda: F.min_by(F.struct(column.alias("v")), position),
            "running_sum": lambda: F.sum(column),
        }[value.kind]().alias(name))
    per_part = rows.groupBy(*group, PART).agg(*sums)

    # One row per part of a group; a group has at most as many parts as there are ranges.
    order = Window.partitionBy(*group).orderBy(PART)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for name, value in values.items():
        column = named(name)
        carried.append({
            "last_known": lambda: F.last(column, ignorenulls=True).over(before),
            "previous": lambda: F.lag(column).over(order),
            "first": lambda: F.first(column).over(before),
            "running_sum": lambda: F.sum(column).over(before),
        }[value.kind]().alias(f"__carry_{name}"))
    carry = (
        per_part.select(*group, PART, F.row_number().over(order).alias("__part_no"), *carried)
        .where("__part_no > 1")
        .drop("__part_no")
    )
    if small_carry:
        # Each range adds at most one part that continues a group of the range before.
        carry = F.broadcast(carry)

    window = Window.partitionBy(*group, PART).orderBy(*map(named, order_by))
    local = rows.select(
        "*",
        (F.row_number().over(window) == 1).alias(NEW_PART),
        *[_local(value.kind, at(value.column), window).alias(f"__local_{name}") for name, value in values.items()],
    )
    joined = local.join(carry, [*group, PART], "left")
    final = []
    for name, value in values.items():
        here, there = named(f"__local_{name}"), named(f"__carry_{name}")
        final.append({
            "last_known": lambda: F.coalesce(here, there),
            "previous": lambda: F.when(F.col(NEW_PART), there["v"]).otherwise(here),
            "first": lambda: F.coalesce(there, F.struct(here.alias("v")))["v"],
            "running_sum": lambda: F.coalesce(here + there, here, there),
        }[value.kind]().alias(name))
    kept = [at(c).alias(c) for c in df.columns if c != PART]
    return joined.select(*kept, *final)
