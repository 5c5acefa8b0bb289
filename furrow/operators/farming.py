"""Scores, rankings and checks of the farming tables. All definitions here are our own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from furrow.operators import keys, ranking
from furrow.operators.columns import named
from furrow.sources.datasets import NUTRIENTS


def soil_score(df: DataFrame, nutrients: Sequence[str] = NUTRIENTS, threshold: float = 50.0) -> DataFrame:
    """Mean of the known nutrient percentages, and the list of those below the threshold.

    A higher percentage is taken as better. Without any known nutrient the score is NULL.
    """
    values = [F.col(c).cast("double") for c in nutrients]
    known = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))
    low = F.array_compact(F.array(*[F.when(v < threshold, F.lit(c)) for c, v in zip(nutrients, values)]))
    return df.select(
        "*",
        known.alias("n_known"),
        F.try_divide(total, known).alias("soil_score"),
        low.alias("deficient"),
    )


def soil_rank(df: DataFrame, score: str = "soil_score", name: str = "percentile", **options) -> DataFrame:
    """Share of the other scored rows that lie below."""
    return ranking.ranks(df, [], score, descending=False, percent_rank=name, **options)


def regional_ranking(df: DataFrame, crop: str, measure: str, name: str = "region_rank", **options) -> DataFrame:
    """Dense rank of each region within a crop, the highest measure first."""
    return ranking.ranks(df, [crop], measure, dense_rank=name, **options)


def best_and_worst(df: DataFrame, crop: str, region: str, measure: str, n: int) -> DataFrame:
    """The n highest and n lowest regions per crop, with their side and place."""
    known = df.where(F.col(measure).isNotNull())
    high = ranking.best_per_group(known, [crop], [F.desc(measure), F.asc(region)], n)
    low = ranking.best_per_group(known, [crop], [F.asc(measure), F.asc(region)], n)
    return high.withColumn("side", F.lit("high")).unionByName(low.withColumn("side", F.lit("low")))


def yield_efficiency(
    df: DataFrame, crop: str = "crop", yielded: str = "yield_quintal", costs: Mapping[str, str] | None = None, **options
) -> DataFrame:
    """Yield per 1000 of cost on each cost basis, ranked within the crop on the first basis."""
    bases = costs or {"a2fl": "cost_a2fl", "c2": "cost_c2"}
    ratios = {
        f"efficiency_{name}": F.try_divide(F.col(yielded), F.col(cost)) * 1000 for name, cost in bases.items()
    }
    return ranking.ranks(
        df.withColumns(ratios), [crop], next(iter(ratios)), dense_rank="efficiency_rank", **options
    )


def variety_by_state(varieties: DataFrame) -> DataFrame:
    """Number of varieties and their days, per state and crop."""
    return (
        varieties.select("crop", "min_days", "max_days", F.explode("states").alias("state"))
        .groupBy("state", "crop")
        .agg(
            F.count(F.lit(1)).alias("n_varieties"),
            F.min("min_days").alias("min_days"),
            F.max("max_days").alias("max_days"),
        )
    )


@dataclass(frozen=True)
class Check:
    """A row breaks the check if the actual value exceeds, or differs from, the expected one
    by more than the tolerance."""

    name: str
    actual: Column
    expected: Column
    tolerance: float
    upper_bound: bool = False

    def broken(self) -> Column:
        gap = self.actual - self.expected
        return (gap if self.upper_bound else F.abs(gap)) > self.tolerance


def measure_checks() -> list[Check]:
    """Yield index against production over area."""
    return [Check("yield_is_production_over_area", F.col("yield"),
                  F.try_divide(F.col("production"), F.col("area")) * 100, 0.2)]


def cost_checks() -> list[Check]:
    """Cost per quintal is at most the cost per hectare over the yield."""
    return [Check("cost_per_quintal_at_most_cost_over_yield", F.col("cost_per_quintal"),
                  F.try_divide(F.col("cost_c2"), F.col("yield_quintal")), 0.005, upper_bound=True)]


def violations(df: DataFrame, checks: Sequence[Check], keep: Sequence[str]) -> DataFrame:
    """One row per broken check; a missing value breaks none."""
    found = [
        F.when(
            check.broken(),
            F.struct(
                F.lit(check.name).alias("check"),
                check.actual.cast("double").alias("actual"),
                check.expected.cast("double").alias("expected"),
            ),
        )
        for check in checks
    ]
    return df.select(*keep, F.inline(F.array_compact(F.array(*found))))


def crop_year(moment: Column) -> Column:
    """The year in which a crop year from July to June began: that of a label such as ``2004-05``."""
    return F.year(F.add_months(moment, -6))


@dataclass(frozen=True)
class CrossCheck:
    """A rule between two tables: ``actual`` is read from a row of the left one, ``expected`` is an aggregate of the rows of
    the right one with the same keys and period, times ``factor``, which brings it to the unit of the left."""

    name: str
    actual: Column
    expected: Column
    tolerance: float
    factor: float = 1.0
    upper_bound: bool = False


def cross_violations(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str],
    period: tuple[Column, Column],
    checks: Sequence[CrossCheck],
    keep: Sequence[str],
) -> DataFrame:
    """One row per row of the left table and check that it breaks against the right table.

    ``on`` maps key columns of the left to those of the right, ``period`` gives the period of a row of either, such as
    :func:`crop_year` of a date and the first year of a label. The right table comes to one row per key and period before
    the join, so it multiplies nothing. A row without a counterpart, without a key or with a missing value breaks none.
    """
    names = [f"__key{i}" for i in range(len(on))]
    sums = right.groupBy(*[named(c).alias(k) for k, c in zip(names, on.values())], period[1].alias("__period")).agg(
        *[(check.expected.cast("double") * check.factor).alias(f"__expected{i}") for i, check in enumerate(checks)]
    )
    rows = left.select(
        *keep, *[named(c).alias(k) for k, c in zip(names, on)], period[0].alias("__period"),
        *[check.actual.cast("double").alias(f"__actual{i}") for i, check in enumerate(checks)],
    )
    rules = [
        Check(check.name, F.col(f"__actual{i}"), F.col(f"__expected{i}"), check.tolerance, check.upper_bound) for i, check in enumerate(checks)
    ]
    return violations(keys.join_on_key(rows, sums, [*names, "__period"], "inner"), rules, keep)


def crop_performance(
    left: DataFrame,
    right: DataFrame,
    left_crop: str = "crop",
    right_crop: str = "crop",
    aliases=keys.CROP_ALIASES,
    figures: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Every row of the left table once, with figures of the right rows of the same normal crop name.

    ``figures`` names aggregates of the right table, by default the mean of each of its numeric columns; they bring it
    to one row per crop, so that repeated names on either side do not multiply rows. A figure whose name the left table
    has already gets ``other_`` in front.
    """
    other = keys.with_key(right, right_crop, aliases=aliases)
    if figures is None:
        numeric = [f.name for f in right.schema if isinstance(f.dataType, NumericType)]
        figures = {c: F.avg(named(c)) for c in numeric}
    taken = {c.lower() for c in [*left.columns, "crop_key"]}
    renamed = {(f"other_{name}" if name.lower() in taken else name): figure for name, figure in figures.items()}
    per_crop = other.groupBy("crop_key").agg(F.count(F.lit(1)).alias("__rows"), *[f.alias(n) for n, f in renamed.items()])
    return keys.join_on_key(keys.with_key(left, left_crop, aliases=aliases), per_crop.drop("__rows"), "crop_key")


def yield_by_geography(costs: DataFrame, varieties: DataFrame, aliases=keys.CROP_ALIASES) -> DataFrame:
    """Yield per crop and state with what the varieties say about the same crop and state."""
    by_state = keys.with_key(varieties, "crop", aliases=aliases).drop("crop")
    by_state = variety_by_state(by_state.withColumnRenamed("crop_key", "crop")).withColumnRenamed("crop", "crop_key")
    left = keys.with_key(costs, "crop", aliases=aliases)
    return keys.join_on_key(left, by_state, ["crop_key", "state"])


def soil_by_crop(soil: DataFrame, districts: DataFrame, costs: DataFrame, aliases=keys.CROP_ALIASES) -> DataFrame:
    """Mean soil score per state next to the crops grown there.

    ``districts`` maps ``district`` to ``state`` and comes from the user. A name that it gives
    more than one state is left out: the soil table does not say which is meant.
    """
    states = (
        districts.select(keys.normal_key(F.col("district")).alias("district_key"), "state")
        .groupBy("district_key")
        .agg(F.min("state").alias("state"), F.max("state").alias("__other"))
        .where("state = __other")
        .drop("__other")
    )
    scored = soil_score(soil).withColumn("district_key", keys.normal_key(F.col("district")))
    by_state = (
        keys.join_on_key(scored, states, "district_key", "inner")
        .groupBy("state")
        .agg(F.avg("soil_score").alias("soil_score"), F.count("soil_score").alias("n_districts"))
    )
    return keys.join_on_key(keys.with_key(costs, "crop", aliases=aliases), by_state, "state")
