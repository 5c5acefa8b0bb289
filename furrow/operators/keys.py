"""Joins on names that differ in spelling between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.text import normal_key
from furrow.functions.values import CROP_ALIASES
from furrow.session import shared_dir


def with_key(
    df: DataFrame,
    column: str,
    name: str = "crop_key",
    aliases: Mapping[str, str] | DataFrame | None = CROP_ALIASES,
) -> DataFrame:
    """Add the normal form of a name. Aliases are a short mapping or a table ``(alias, key)``."""
    if not isinstance(aliases, DataFrame):
        return df.withColumn(name, normal_key(F.col(column), aliases))
    table = aliases.select(
        normal_key(F.col("alias")).alias("__alias"), normal_key(F.col("key")).alias("__key")
    ).groupBy("__alias").agg(F.min("__key").alias("__key"))
    return (
        df.withColumn("__plain", normal_key(F.col(column)))
        .join(table, F.col("__plain") == F.col("__alias"), "left")
        .select(*df.columns, F.coalesce("__key", "__plain").alias(name))
    )


def join_on_key(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "left") -> DataFrame:
    """Equi join. No hint: Spark broadcasts a side it has measured to be small, and otherwise
    splits a frequent key of the larger side at run time."""
    return left.join(right, on, how)


def unmatched_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of the left side that the right side lacks, with their number of rows."""
    keys = list(on)
    return left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).join(right, keys, "left_anti")


#: Characters of a gram.
GRAM = 2


def _grams(name: Column) -> Column:
    """All runs of GRAM characters of a name with marked ends; the second of equal ones differs from the first, and so on."""
    padded = F.concat(F.repeat(F.lit("\x01"), GRAM - 1), name, F.repeat(F.lit("\x02"), GRAM - 1))
    grams = F.transform(F.sequence(F.lit(1), F.length(name) + GRAM - 1), lambda i: F.substr(padded, i, F.lit(GRAM)))
    return F.transform(
        grams, lambda g, i: F.concat(g, F.lit("\x03"), F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda x: x == g)).cast("string"))
    )


def _shortened(name: Column, most: int) -> Column:
    """The name without any ``most`` or fewer of its characters."""
    out = F.array(name)
    for _ in range(most):
        cut = F.transform(out, lambda s: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.left(s, i - 1), F.substr(s, i + 1))
        ))
        out = F.array_distinct(F.concat(out, F.flatten(cut)))
    return out


def near_keys(left: DataFrame, right: DataFrame, on: str, distance: int = 2) -> DataFrame:
    """(on, match, distance): for each name of the left side those of the right side within an edit distance.

    An edit changes at most GRAM grams, so two near names that are not short share one of their GRAM * distance + 1 rarest
    grams. Shorter names, and those that can be near them, share what is left of them without some characters. Either
    makes a join on equal tokens, rare ones first; the names that meet are compared by their edit distance. No pair is lost,
    and sides are never paired whole. Equal names are in the result with distance 0; NULL is near nothing.
    """
    shared_dir(left.sparkSession)
    kept = GRAM * distance + 1
    short = GRAM * distance - GRAM + 1  # so many characters or fewer have too few grams
    sides = [df.select(F.col(on).alias("__name")).dropna().distinct() for df in (left, right)]
    names = sides[0].union(sides[1]).distinct()
    grams = names.where(F.length("__name") > short).select("__name", F.explode(_grams(F.col("__name"))).alias("__token"))
    # Written, so that its join with the grams can split a frequent one.
    times = grams.groupBy("__token").agg(F.count(F.lit(1)).alias("__n")).checkpoint()
    rarest = grams.join(times, "__token").groupBy("__name").agg(F.sort_array(F.collect_list(F.struct("__n", "__token"))).alias("__all"))
    tokens = rarest.select("__name", F.explode(F.slice("__all", 1, kept)["__token"]).alias("__token"))
    brief = names.where(F.length("__name") <= short + distance)
    tokens = tokens.union(brief.select("__name", F.explode(F.transform(_shortened(F.col("__name"), distance), lambda s: F.concat(F.lit("\x04"), s)))))
    tokens = tokens.checkpoint()
    ours, theirs = (tokens.join(side, "__name", "left_semi") for side in sides)
    met = ours.select("__token", F.col("__name").alias(on)).join(theirs.select("__token", F.col("__name").alias("match")), "__token")
    pairs = met.select(on, "match").distinct().withColumn("distance", F.levenshtein(on, "match", distance))
    return pairs.where(F.col("distance") >= 0)
