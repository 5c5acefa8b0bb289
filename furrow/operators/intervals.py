"""Joins of amounts with the ranges that hold them, as equi joins.

A range of whole units is cut into the fewest cells of a binary grid: cell ``c`` of level ``k`` holds the units from ``c * 2**k``
up to ``(c + 1) * 2**k - 1``. There are at most two cells per level, however wide the range is, and they do not overlap. An
amount lies in one cell of each level, so it meets every range that holds it exactly once, and no other.

Ranges are first cut to the span of the amounts, so that they have only cells that can be met, and spread over tasks by their
number: a row becomes tens of rows, so a small file would otherwise be a large task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators import ordered, ranking
from furrow.operators.columns import named

#: Levels of the grid; a range without a bound ends at plus or minus 2 ** (LEVELS - 1) units.
LEVELS = 62
#: Ranges that one task cuts into cells.
RANGES_PER_TASK = 20_000
#: Kinds of figures over ranges: how a cell's is calculated and how those of several cells are put together.
FIGURES = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def units(amount: Column, scale: int) -> Column:
    """An amount as a whole number of units, ``scale`` of which make 1; NaN is NULL."""
    return F.round(F.nanvl(amount.cast("double"), F.lit(None)) * scale).cast("long")


def cells(low: Column, high: Column) -> Column:
    """The cells of the units from ``low`` to ``high``, both included; a NULL bound is none. Nothing where low is above high.

    At each level the cells from the first whole one to the last are open; of these an odd first and an even last one
    are taken, and the others make whole cells of the next level.
    """
    edge = 1 << (LEVELS - 1)
    low, end = F.coalesce(low, F.lit(-edge)), F.coalesce(high, F.lit(edge - 1)) + 1

    def taken(level: Column) -> Column:
        first, behind = -F.call_function("shiftright", -low, level), F.call_function("shiftright", end, level)
        return F.array(*[
            F.when((first < behind) & (c.bitwiseAND(F.lit(1)) == 1), F.struct(level.alias("level"), cell.alias("cell")))
            for c, cell in ((first, first), (behind, behind - 1))
        ])

    found = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), _levels(low, end)), taken)))
    return F.when(low < end, found).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))


def _levels(low: Column, end: Column) -> Column:
    """The highest level that a cell of the units from ``low`` up to ``end`` can have: each level halves what is left."""
    return F.coalesce(F.length(F.bin(F.try_subtract(end, low))), F.lit(LEVELS + 1)) - 1


def _keyed(points: DataFrame, point: str, scale: int, same: Sequence[str]) -> DataFrame:
    """The points with (__s0.., __unit)."""
    return points.select("*", *[F.col(c).alias(f"__s{i}") for i, c in enumerate(same)], units(F.col(point), scale).alias("__unit"))


def _ranged(ranges: DataFrame, low: str, high: str, scale: int, same: Sequence[str], keyed: DataFrame) -> tuple[DataFrame, int]:
    """The ranges with (__s0.., __level, __cell), each once per cell within the span of the points, and the highest level."""
    least, most = keyed.agg(F.min("__unit"), F.max("__unit")).first()
    # A range that lacks one of the equal columns meets nothing; nor does one that is empty or beside the span.
    bounds = [F.greatest(units(F.col(low), scale), F.lit(least).cast("long")), F.least(units(F.col(high), scale), F.lit(most).cast("long"))]
    known = ranges.dropna(subset=list(same)) if same else ranges
    known = known.withColumns({"__low": bounds[0], "__high": bounds[1]}).where(F.coalesce(F.col("__low") <= F.col("__high"), F.lit(True)))
    span = (F.coalesce(c, F.lit(e)) for c, e in ((F.col("__low"), -(1 << (LEVELS - 1))), (F.col("__high") + 1, 1 << (LEVELS - 1))))
    n, top = known.agg(F.count(F.lit(1)), F.max(_levels(*span))).first()
    # By a hash of the row: no sorting, and the deal is the same when a task is repeated.
    dealt = known.repartition(max(1, -(-n // RANGES_PER_TASK)), *[c for c, kind in known.dtypes if "map<" not in kind and "variant" not in kind])
    found = dealt.select(
        *[F.col(c) for c in ranges.columns],
        *[F.col(c).alias(f"__s{i}") for i, c in enumerate(same)],
        F.inline(cells(F.col("__low"), F.col("__high"))).alias("__level", "__cell"),
    )
    return found, top or 0


def _placed(points: DataFrame, top: int) -> DataFrame:
    """Each point once per level up to the highest; there are at most LEVELS + 1 of them."""
    used = points.select("*", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("__level"))
    return used.withColumn("__cell", F.call_function("shiftright", F.col("__unit"), F.col("__level")))


def _check_names(points: DataFrame, ranges: DataFrame, same: Sequence[str]) -> None:
    both = {c.lower() for c in points.columns} & {c.lower() for c in ranges.columns} - {c.lower() for c in same}
    if both:
        raise ValueError(f"columns of both sides: {sorted(both)}")


def containing(
    points: DataFrame,
    ranges: DataFrame,
    point: str,
    low: str,
    high: str,
    scale: int = 100,
    same: Sequence[str] = (),
    figures: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Every pair of a point and a range that holds it, with the columns of both.

    Amounts are compared in whole units, by default hundredths; both bounds belong to the range, a NULL bound is no bound, a
    NULL point lies in no range. ``same`` names columns that must also be equal and not NULL; they come from the points.

    Pairs are as many as points times ranges in the worst case. With ``figures``, by name a kind of FIGURES and a column of
    the ranges, each point that lies in a range comes once instead, with these figures over all the ranges that hold it.
    They are calculated per pair of bounds, put together per cell and then per amount, so that no step makes the pairs.
    """
    on = [f"__s{i}" for i in range(len(same))]
    keyed = _keyed(points, point, scale, same)
    if figures is None:
        _check_names(points, ranges, same)
        cut, top = _ranged(ranges, low, high, scale, same, keyed)
        rows = keyed.where("__unit IS NOT NULL").select(F.struct(*map(named, points.columns)).alias("__point"), *on, "__unit")
        met = _placed(rows, top).join(cut.select(F.struct(*map(named, ranges.columns)).alias("__row"), *on, "__level", "__cell"), [*on, "__level", "__cell"])
        return met.select("__point.*", *[F.col("__row")[c].alias(c) for c in ranges.columns if c not in same])
    if both := {c.lower() for c in points.columns} & {c.lower() for c in figures}:
        raise ValueError(f"columns of the points and figures: {sorted(both)}")
    names = [f"__f{i}" for i in range(len(figures))]
    first = [FIGURES[kind][0](column).alias(n) for n, (kind, column) in zip(names, figures.values())]
    together = [FIGURES[kind][1](n).alias(n) for n, (kind, _) in zip(names, figures.values())]
    cut, top = _ranged(ranges.groupBy(*dict.fromkeys([low, high, *same])).agg(*first), low, high, scale, same, keyed)
    per_cell = cut.groupBy(*on, "__level", "__cell").agg(*together)
    key = [*on, "__unit"]
    met = _placed(keyed.select(*key).dropna().distinct(), top).join(per_cell, [*on, "__level", "__cell"])
    answers = met.groupBy(*key).agg(*together)
    return keyed.join(answers, key).select(*map(named, points.columns), *[F.col(n).alias(f) for n, f in zip(names, figures)])


def best_containing(
    points: DataFrame,
    ranges: DataFrame,
    point: str,
    low: str,
    high: str,
    order_by: Sequence[Column],
    n: int,
    scale: int = 100,
    same: Sequence[str] = (),
    place: str = "place",
) -> DataFrame:
    """The ``n`` first ranges, in an order over their own columns, that hold each point; a point in no range comes once, with NULL.

    Whatever a cell's point is, only the cell's own ``n`` first ranges can be in its answer, so the rest goes before the
    join, and equal points are looked up once: no step makes all pairs.
    """
    _check_names(points, ranges, same)
    on = [f"__s{i}" for i in range(len(same))]
    keyed = _keyed(points, point, scale, same)
    cut, top = _ranged(ranges, low, high, scale, same, keyed)
    kept = ranking.best_per_group(cut, [*on, "__level", "__cell"], order_by, n, "__place").drop("__place")
    key = [*on, "__unit"]
    met = _placed(keyed.select(*key).dropna().distinct(), top).join(kept, [*on, "__level", "__cell"])
    found = ranking.best_per_group(met, key, order_by, n, place)
    others = [c for c in ranges.columns if c not in same]
    answers = found.select(*[F.col(k).alias(f"__a{k}") for k in key], *others, place)
    joined = keyed.join(answers, ordered.same(key, [f"__a{k}" for k in key]), "left")
    return joined.select(*points.columns, *others, place)
