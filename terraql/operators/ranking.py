"""Ranks: sets of scores, leaderboards in time windows, and the best rows of each group.

Ranks count from 0. By default equal scores share a rank and the next score follows at once; with
``count_duplicates`` each row above counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _over(groups: Sequence[str], score: str, high_first: bool) -> WindowSpec:
    return Window.partitionBy(*groups).orderBy(F.col(score).desc_nulls_last() if high_first else F.col(score).asc_nulls_first())


def ranked(df: DataFrame, score: str, groups: Sequence[str] = (), high_first: bool = False, count_duplicates: bool = False, name: str = "rank") -> DataFrame:
    """df with the rank of each row's score in its group; rows with a null score go.

    Ranks are of distinct scores with their counts, summed up before, so that a group's window holds scores and not
    rows; without groups, scores are ranked in ranges, and no task holds all.
    """
    rows = df.where(F.col(score).isNotNull())
    scores = rows.groupBy(*groups, score).agg(F.count(F.lit(1)).alias("_n"))
    step = F.col("_n") if count_duplicates else F.lit(1)
    if groups:
        above = _over(groups, score, high_first).rowsBetween(Window.unboundedPreceding, -1)
        placed = scores.withColumn(name, F.coalesce(F.sum(step).over(above), F.lit(0)).cast("bigint"))
    else:
        placed = _ranges(scores.withColumn("_step", step.cast("bigint")), score, high_first, name)
    keys = [*groups, score]
    same = None
    right = placed.select(*[F.col(k).alias(f"_{k}") for k in keys], name)
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}")) if k != score else F.col(k) == F.col(f"_{k}")
        same = one if same is None else same & one
    return rows.join(right, same).drop(*[f"_{k}" for k in keys])


def _ranges(scores: DataFrame, score: str, high_first: bool, name: str) -> DataFrame:
    """Running sums over all scores: within ranges of scores, plus the sums of the ranges before."""
    order = F.col(score).desc() if high_first else F.col(score).asc()
    parts = scores.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    sums = parts.groupBy("_part").agg(F.sum("_step").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_own", F.coalesce(F.sum("_step").over(inner), F.lit(0)))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_own")).cast("bigint")).drop("_part", "_own", "_start", "_step")


def score_for_rank(df: DataFrame, score: str, rank: int, groups: Sequence[str] = (), high_first: bool = False, default: object = None) -> DataFrame:
    """The score at a rank of each group; groups that are shorter have the default, if there is one, else no row."""
    scores = df.where(F.col(score).isNotNull()).select(*groups, score).distinct()
    if groups:
        placed = scores.withColumn("_r", F.row_number().over(_over(groups, score, high_first)) - 1).where(F.col("_r") <= rank)
        found = placed.where(F.col("_r") == rank).drop("_r")
    else:  # each task sends its first scores only
        found = scores.orderBy(F.col(score).desc() if high_first else F.col(score).asc()).offset(rank).limit(1)
    if default is None:
        return found
    if not groups:
        every = df.sparkSession.range(1).select(F.lit(1).alias("_one"))
        return every.join(found.withColumn("_one", F.lit(1)), "_one", "left").select(F.coalesce(score, F.lit(default)).alias(score))
    every = df.select(*groups).distinct()
    return every.join(found, list(groups), "left").withColumn(score, F.coalesce(score, F.lit(default)))


def rank_for_score(df: DataFrame, score: str, value: object, high_first: bool = False, count_duplicates: bool = False) -> DataFrame:
    """One row: the rank that a score has or would have."""
    above = F.col(score) > F.lit(value) if high_first else F.col(score) < F.lit(value)
    counted = F.count(F.lit(1)) if count_duplicates else F.count_distinct(F.col(score))
    return df.where(above).agg(counted.alias("rank"))


def between_ranks(df: DataFrame, score: str, low: int, high: int, groups: Sequence[str] = (), high_first: bool = False) -> DataFrame:
    """Rows of ranks low to high, both included."""
    return ranked(df, score, groups, high_first).where(F.col("rank").between(low, high))


def qualify_top(df: DataFrame, order: Sequence[Column], k: int, groups: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """The first k rows of each group: QUALIFY row_number() <= k. Each task keeps k rows of a group before the shuffle."""
    window = Window.partitionBy(*groups).orderBy(*order)
    if not groups:
        top = df.orderBy(*order).limit(k)
        return top if name is None else top.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    kept = df.withColumn(name or "_n", F.row_number().over(window)).where(F.col(name or "_n") <= k)
    return kept if name else kept.drop("_n")


def leaderboard(df: DataFrame, time: str, score: str, seconds: int, groups: Sequence[str] = (), entity: str | None = None, high_first: bool = True) -> DataFrame:
    """Rows with the start of their time window and their rank in it; with an entity, only its best score in a window counts."""
    windows = df.withColumn("window_start", F.window(F.col(time), f"{seconds} seconds")["start"])
    if entity:
        best = F.max(score) if high_first else F.min(score)
        windows = windows.groupBy("window_start", *groups, entity).agg(best.alias(score))
    return ranked(windows, score, ["window_start", *groups], high_first)


def permuted(df: DataFrame, groups: Sequence[str], value: str, largest: bool = True) -> DataFrame:
    """Groups with their extremum, in its order."""
    best = F.max(value) if largest else F.min(value)
    out = df.groupBy(*groups).agg(best.alias("extremum"))
    return out.orderBy(F.col("extremum").desc_nulls_last() if largest else F.col("extremum").asc_nulls_first(), *groups)
