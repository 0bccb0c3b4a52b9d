"""Joins, unnesting, sorting and set operations that need more than one DataFrame call."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraql.errors import DUPLICATE_COLUMN, INVALID_RANGE, WRONG_OBJECT_TYPE, EngineError
from terraql.sources.tables import kept


def number_range(spark, *bounds: int) -> DataFrame:
    """range(end), range(start, end) or range(start, end, step): a column ID from start up to end, which is left out."""
    start, end, step = {1: (0, bounds[0], 1), 2: (*bounds, 1)}.get(len(bounds), bounds)
    if start < 0 or step <= 0:
        raise EngineError(INVALID_RANGE, "a range starts at 0 or above, with a step above 0")
    return spark.range(start, end, step).withColumnRenamed("id", "ID")


def unnest(df: DataFrame, array: str, name: str, ordinality: str | None = None, outer: bool = False) -> DataFrame:
    """A row for each element, with its place from 1 where asked for; NULL and empty arrays have none, unless outer."""
    kind = dict(df.dtypes).get(array, "array")
    if not kind.startswith("array"):
        raise EngineError(WRONG_OBJECT_TYPE, f"{array} is no array")
    if ordinality is None:
        return df.withColumn(name, (F.explode_outer if outer else F.explode)(array))
    both = (F.posexplode_outer if outer else F.posexplode)(array).alias("_at", name)
    return df.select("*", both).withColumn(ordinality, (F.col("_at") + 1).cast("bigint")).drop("_at")


def unnest_together(df: DataFrame, arrays: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Several arrays side by side, as long as the longest; missing elements are NULL."""
    return df.select("*", F.explode(F.arrays_zip(*arrays)).alias("_z")).select(*df.columns, *[F.col(f"_z.{a}").alias(n) for a, n in zip(arrays, names, strict=True)])


def ordered(df: DataFrame, *keys: tuple[str, str]) -> DataFrame:
    """ORDER BY with explicit null places: ASC has nulls first and DESC last unless the direction says otherwise."""
    if len({k for k, _ in keys}) < len(keys):
        raise EngineError(DUPLICATE_COLUMN, "a column stands twice in the order")
    how = {"asc": "asc_nulls_first", "desc": "desc_nulls_last"}
    return df.orderBy(*[getattr(F.col(k), how.get(d, d))() for k, d in keys])


def drop_adjacent(df: DataFrame, order: Sequence[str], values: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Rows whose values differ from those of the row before them in order."""
    before = Window.partitionBy(*groups).orderBy(*order)
    same, first = F.lit(True), F.lag(F.lit(1)).over(before).isNull()
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(before))
    return df.withColumn("_new", first | ~same).where("_new").drop("_new")


def or_else(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first if it has rows, else the second; decided within the plan."""
    # only the first row is looked for: a scan of the first branch that stops there
    some = first.limit(1).agg(F.count(F.lit(1)).alias("_n"))
    rest = second.join(F.broadcast(some), F.col("_n") == 0).drop("_n")  # one row, so this is no growing product
    return first.unionByName(rest)


def map_while(df: DataFrame, order: Sequence[str], keep: Column, groups: Sequence[str] = ()) -> DataFrame:
    """The rows before the first, in order, for which keep isn't true."""
    until = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stopped = F.max(F.when(F.coalesce(keep, F.lit(False)), 0).otherwise(1)).over(until)
    return df.withColumn("_stop", stopped).where("_stop = 0").drop("_stop")


def first_or_default(outer: DataFrame, inner: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, default: object) -> DataFrame:
    """Each outer row with the first inner value for its keys, or the default."""
    least = inner.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("v"))).alias("_first"))
    return outer.join(least, list(keys), "left").withColumn(value, F.coalesce(F.col("_first.v"), F.lit(default))).drop("_first")


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int = 16, how: str = "inner", hot: int = 100_000) -> DataFrame:
    """An equi-join whose left side has hot keys, those of ``hot`` rows or more: these rows are salted, and the right side is repeated for each salt at these keys only."""
    # written first, so that both sides see the same keys; at most one for ``hot`` left rows
    found = kept(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot).select(*keys, F.lit(True).alias("_hot")))
    # never a broadcast: Spark's estimate is of the packed file, and leaves out the repeated rows
    if found.isEmpty():
        return left.join(right.hint("merge"), list(keys), how)
    # NULLs match nothing, and are salted so that an outer join doesn't keep them in one task
    spread = F.coalesce(F.col("_hot"), reduce(or_, [F.col(k).isNull() for k in keys]))
    salt = F.when(spread, F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(0)
    salted = left.join(F.broadcast(found), list(keys), "left").withColumn("_salt", salt).drop("_hot")
    last = F.when(F.col("_hot"), salts - 1).otherwise(0)
    repeated = right.join(F.broadcast(found), list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    return salted.join(repeated.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def synthetic_join(sides: Sequence[tuple[str, DataFrame]], on: Sequence[tuple[str, str]]) -> DataFrame:
    """A declared record type: each side whole, as a struct by its name; ``on`` has dotted pairs, one for each further side."""
    out = sides[0][1].select(F.struct("*").alias(sides[0][0]))
    for (name, df), (a, b) in zip(sides[1:], on, strict=True):
        out = out.join(df.select(F.struct("*").alias(name)), F.col(a) == F.col(b))
    return out


def intersect_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows whose key is on the right; of the right side each key is moved once. Spark adds a Bloom filter where that pays."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi")


def intersect_legs(legs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys that all legs have, with the columns of every leg; other columns than the keys have to differ by name."""
    out = legs[0]
    for leg in legs[1:]:
        out = out.join(leg, list(keys))
    return out
