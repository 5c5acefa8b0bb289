"""Ranks and best-of lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators import ordered
from furrow.operators.columns import named
from furrow.session import shared_dir


def ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    descending: bool = True,
    rank: str | None = None,
    dense_rank: str | None = None,
    percent_rank: str | None = None,
    bounded: bool = False,
    rows_per_task: int = ordered.ROWS_PER_TASK,
) -> DataFrame:
    """Add the wanted kinds of rank of a value within its group.

    A missing value has no rank and does not count. Groups beyond ``rows_per_task`` are ranked
    by counting equal values first and adding the counts up in order, so that neither a large
    group nor a frequent value needs one task.
    """
    names = {k: v for k, v in {"rank": rank, "dense_rank": dense_rank, "percent_rank": percent_rank}.items() if v}
    small, large, _ = (df, None, 0) if bounded else ordered.by_size(df, by, rows_per_task)
    ranked = []
    if small is not None:
        score = F.col(value)
        order = score.desc() if descending else score.asc()
        window = Window.partitionBy(*by, score.isNull()).orderBy(order)
        kinds = {"rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank}
        ranked.append(small.select(
            "*", *[F.when(score.isNotNull(), kinds[k]().over(window)).alias(v) for k, v in names.items()]
        ))
    if large is not None:
        ranked.append(_by_counts(large, list(by), value, descending, names, rows_per_task))
    return ranked[0] if len(ranked) == 1 else ranked[0].unionByName(ranked[1])


def _by_counts(df, by, value, descending, names, rows_per_task) -> DataFrame:
    shared_dir(df.sparkSession)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__one", F.lit(1).cast("long"))
        .checkpoint()
    )
    placed = ordered.along(
        counts,
        by,
        [value],
        {"__upto": ordered.running_sum("__n"), "__seq": ordered.running_sum("__one")},
        rows_per_task=rows_per_task,
    )
    totals = counts.groupBy(*[F.col(k).alias(f"__total_{k}") for k in by]).agg(
        F.sum("__n").alias("__rows"), F.sum("__one").alias("__values")
    )
    if by:
        # One row per large group, of which there are few: their sums are small to send along.
        placed = placed.join(F.broadcast(totals), ordered.same(by, [f"__total_{k}" for k in by]))
    else:
        total = totals.select(F.struct("__rows", "__values")).scalar()
        placed = placed.withColumn("__total", total).select("*", "__total.*")
    place = F.col("__rows") - F.col("__upto") + 1 if descending else F.col("__upto") - F.col("__n") + 1
    dense = F.col("__values") - F.col("__seq") + 1 if descending else F.col("__seq")
    share = F.when(F.col("__rows") > 1, (place - 1) / (F.col("__rows") - 1)).otherwise(F.lit(0.0))
    kinds = {"rank": place.cast("int"), "dense_rank": dense.cast("int"), "percent_rank": share}
    placed = placed.select(
        *[F.col(k).alias(f"__placed_{k}") for k in [*by, value]],
        *[kinds[k].alias(v) for k, v in names.items()],
    )
    # One row per value on the right; a frequent value on the left is split by adaptive execution.
    match = ordered.same([*by, value], [f"__placed_{k}" for k in [*by, value]])
    return df.join(placed, match, "left").select(*df.columns, *names.values())


def best(df: DataFrame, order_by: Sequence[Column], n: int) -> DataFrame:
    """The first rows of the whole table."""
    return df.orderBy(*order_by).limit(n)


#: Spark drops the surplus of each task before the shuffle up to this limit (spark.sql.optimizer.windowGroupLimitThreshold).
SURPLUS_LIMIT = 1000


def best_per_group(df: DataFrame, by: Sequence[str], order_by: Sequence[Column], n: int, place: str = "place") -> DataFrame:
    """The first rows of each group with their place; every task drops its own surplus first.

    Beyond Spark's own limit the surplus is dropped in two steps: the first n of each of the pieces that a group is dealt
    into by a hash of the row, then the first n of those. A piece, and what the pieces leave, is what one task holds.
    """
    window = Window.partitionBy(*by).orderBy(*order_by)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", str(SURPLUS_LIMIT)))
    if n > limit:
        pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.withColumn("__piece", F.pmod(F.xxhash64(*map(named, df.columns)), F.lit(pieces)))
        first = Window.partitionBy(*by, "__piece").orderBy(*order_by)
        df = dealt.withColumn(place, F.row_number().over(first)).where(F.col(place) <= n).drop("__piece", place)
    return df.withColumn(place, F.row_number().over(window)).where(F.col(place) <= n)
