"""Aggregates over all that was ever written, and versions of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERSION = "_row_version"


def ever(log: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """MIN_EVER, MAX_EVER and COUNT_UPDATES from an append-only log of writes; deletes take nothing back."""
    return log.groupBy(*groups).agg(F.min(value).alias("min_ever"), F.max(value).alias("max_ever"), F.count(F.lit(1)).alias("count_updates"))


def current(log: DataFrame, key: Sequence[str], version: str = VERSION, deleted: str | None = None) -> DataFrame:
    """The last version of each row; rows whose last write deletes them are gone."""
    last = Window.partitionBy(*key).orderBy(F.col(version).desc())
    out = log.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else out


def changes(rows: DataFrame, after: int, version: str = VERSION) -> DataFrame:
    """Rows by rising version after one seen before."""
    return rows.where(F.col(version) > after).orderBy(version)


def scrub(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries that an index lacks or has too many of, by what is wrong."""
    missing, dangling = rows.exceptAll(index), index.exceptAll(rows)
    return missing.withColumn("problem", F.lit("missing")).unionByName(dangling.withColumn("problem", F.lit("dangling")))


def key_sizes(df: DataFrame, groups: Sequence[str], size) -> DataFrame:
    """Number, total, mean and median of sizes for each prefix of a key; the median keeps a count for each distinct size."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), F.avg(size).alias("mean"), F.percentile(size, 0.5).alias("p50"))
