"""Crop recommendation by rules. The rules and the score are our own definition.

Answers depend only on the season, water and investment of a request, and on its region and soil where the crops have
columns for them, so the best crops are ranked once per combination and requests look their combination up.
Requests and crops are never paired one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import text as X
from furrow.functions.values import (
    INVESTMENT_BOUNDS,
    INVESTMENT_LEVELS,
    REGIONS,
    RISK_WEIGHTS,
    SEASONS,
    SOIL_TYPES,
    WATER_LEVELS,
)
from furrow.operators import intervals
from furrow.operators.ranking import best_per_group

CASE = ["season", "water", "investment"]
#: Optional columns of crops, the column of requests that each belongs to, and its options.
PLACES = {"region": ("region", REGIONS), "soil": ("soilType", SOIL_TYPES)}
#: Stands for a request that does not say.
ANY = ""


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _seasons(season: Column) -> Column:
    """Seasons a crop suits; ``Both`` suits all."""
    name = F.lower(X.strip(season))
    return F.when(name == "both", _texts(SEASONS)).otherwise(F.array(name))


def _levels_from(level: Column, levels) -> Column:
    """Levels that are enough for a need: the level itself and those above."""
    name = F.lower(X.strip(level))
    choice = None
    for i, need in enumerate(levels):
        hit = name == need
        choice = F.when(hit, _texts(levels[i:])) if choice is None else choice.when(hit, _texts(levels[i:]))
    return choice


def _places(text: Column, options) -> Column:
    """Options named by a crop, comma-separated; all where it names none. A request that does not say finds every crop."""
    named = F.filter(F.transform(F.split(F.lower(text), ","), X.strip), lambda x: x != "")
    return F.concat(F.when(F.size(F.coalesce(named, F.array())) > 0, named).otherwise(_texts(options)), _texts([ANY]))


def investment_level(cost: Column) -> Column:
    """The lowest investment level whose upper bound covers a cost."""
    level = F.when(cost.isNull(), F.lit(None).cast("string"))
    for name, bound in zip(INVESTMENT_LEVELS, INVESTMENT_BOUNDS):
        level = level.when(F.lit(True) if bound is None else cost <= bound, name)
    return level


def scored_crops(crops: DataFrame, cost: str | None = None) -> DataFrame:
    """Crops with their profit range, the cases they suit and a score.

    The score is the middle of the profit range times a weight for the risk. Without a cost
    column every investment is enough.
    """
    profit = X.money_range(F.col("profit"))
    risk = F.lower(X.strip(F.col("risk")))
    weight = F.lit(None).cast("double")
    for name, value in RISK_WEIGHTS.items():
        weight = F.when(risk == name, value).otherwise(weight)
    needed = F.lit(INVESTMENT_LEVELS[0]) if cost is None else investment_level(F.col(cost))
    return crops.select(
        "name",
        profit["low"].alias("profit_low"),
        profit["high"].alias("profit_high"),
        ((profit["low"] + profit["high"]) / 2 * weight).alias("score"),
        _seasons(F.col("season")).alias("seasons"),
        _levels_from(F.col("water"), WATER_LEVELS).alias("waters"),
        _levels_from(needed, INVESTMENT_LEVELS).alias("investments"),
        *[_places(F.col(c), options).alias(f"{c}s") for c, (_, options) in PLACES.items() if c in crops.columns],
    )


def best_crops(crops: DataFrame, n: int, cost: str | None = None) -> DataFrame:
    """The n best crops of each combination of season, water and investment.

    Only the n best of the crops with the same needs can be among them, so the rest goes before
    a crop is repeated for each combination it suits.
    """
    scored = scored_crops(crops, cost).where(F.col("score").isNotNull())
    order = [F.desc("score"), F.asc("name")]
    case = [*CASE, *[c for c in PLACES if c in crops.columns]]
    cases = best_per_group(scored, [f"{c}s" for c in case], order, n).drop("place")
    for c in case:
        cases = cases.withColumn(c, F.explode(f"{c}s")).drop(f"{c}s")
    return best_per_group(cases, case, order, n)


def recommend(requests: DataFrame, crops: DataFrame, n: int = 3, cost: str | None = None) -> DataFrame:
    """The n best crops for each request ``(season, waterAvailability, investmentCapacity, region, soilType)``.

    Region and soil count where the crops have columns ``region`` and ``soil``; a request without them finds all crops.
    """
    answers = best_crops(crops, n, cost)
    asked = dict(zip(CASE, ("season", "waterAvailability", "investmentCapacity")))
    asked |= {c: column for c, (column, _) in PLACES.items() if c in crops.columns}
    keys = {
        c: F.lower(X.strip(F.col(column))) if column in requests.columns else F.lit(ANY) for c, column in asked.items()
    }
    cased = requests.select("*", *[
        (F.coalesce(key, F.lit(ANY)) if c in PLACES else key).alias(f"__{c}") for c, key in keys.items()
    ])
    answers = answers.select(
        *[F.col(c).alias(f"__a_{c}") for c in asked],
        "name", "profit_low", "profit_high", "score", "place",
    )
    match = F.lit(True)
    for c in asked:
        match = match & (F.col(f"__{c}") == F.col(f"__a_{c}"))
    # n crops for each combination of levels, seasons, regions and soils that crops name.
    joined = cased.join(answers, match, "left")
    return joined.select(*requests.columns, "name", "profit_low", "profit_high", "score", "place")


def within_budget(
    requests: DataFrame,
    crops: DataFrame,
    n: int = 3,
    budget: str = "budget",
    least: str | None = None,
    low: str = "cost_low",
    high: str = "cost_high",
    same: Sequence[str] = (),
) -> DataFrame:
    """The n crops of the highest sure profit whose cost limits hold a request's budget, with their place.

    The sure profit is the lower end of the crop's ``profit`` text; ties go to the lesser name, and a crop without one is left
    out. A missing cost limit is none. ``least`` names the requests' column of the least profit asked for: as crops come by
    profit, those that reach it are the first of the n, so no crop further down could take their place. ``same`` names
    columns that must be equal on both sides. A request without an answer comes once, with NULL.
    """
    profit = X.money_range(F.col("profit"))
    known = crops.select(
        "name", profit["low"].alias("profit_low"), profit["high"].alias("profit_high"),
        F.col(low).alias("__low"), F.col(high).alias("__high"), *same,
    ).where(F.col("profit_low").isNotNull())
    order = [F.desc("profit_low"), F.asc("name")]
    found = intervals.best_containing(requests, known, budget, "__low", "__high", order, n, same=same)
    answer = [F.col(c) for c in ("name", "profit_low", "profit_high", "place")]
    if least is None:
        return found.select(*requests.columns, *answer)
    # A place above 1 that falls short goes; the first stays as a row without an answer.
    enough = F.col(least).isNull() | F.coalesce(F.col("profit_low") >= F.col(least), F.lit(False))
    return found.where(enough | F.coalesce(F.col("place") == 1, F.lit(True))).select(
        *requests.columns, *[F.when(enough, c).alias(a) for c, a in zip(answer, ("name", "profit_low", "profit_high", "place"))]
    )
