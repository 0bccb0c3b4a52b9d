"""Bitmaps of 10,000 positions in 1,250 bytes, least significant bit first."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 10_000


def bit_position(value: Column) -> Column:
    return F.pmod(value, F.lit(SPAN)).cast("int")


def bucket_offset(value: Column) -> Column:
    """The first position of the bucket that a value is in."""
    return value - F.pmod(value, F.lit(SPAN))


def bucket_number(value: Column) -> Column:
    # exact also where a double isn't: the quotient of two whole numbers is asked for in SQL's words
    return F.call_function("div", value - F.pmod(value, F.lit(SPAN)), F.lit(SPAN))


def construct(df: DataFrame, value: str, *groups: str, name: str = "bitmap") -> DataFrame:
    """A bitmap for each group and bucket, of all positions that the non-null values have.

    Sixty-four positions make a word, which is OR-ed before the shuffle, so a hot group moves 157 words for
    each task at most; words are put together only after that.
    """
    words = df.where(F.col(value).isNotNull()).select(*groups, bucket_offset(F.col(value)).alias("bucket_offset"), bit_position(F.col(value)).alias("p"))
    words = words.withColumn("w", F.expr("p div 64").cast("int"))
    # shiftleft of a long takes a constant count or a column
    bits = F.expr("bit_or(shiftleft(1L, p % 64))").alias("bits")
    each = words.groupBy(*groups, "bucket_offset", "w").agg(bits)
    packed = each.groupBy(*groups, "bucket_offset").agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("words"))
    return packed.select(*groups, "bucket_offset", _bytes()(F.col("words")).alias(name))


def _bytes() -> Callable:
    @F.arrow_udf("binary")
    def pack(words: pa.Array) -> pa.Array:
        out = []
        for own in words.to_pylist():
            bits = np.zeros(SPAN // 64 + 1, "<i8")
            for x in own:
                bits[x["w"]] = x["bits"]
            out.append(bits.tobytes()[: SPAN // 8])
        return pa.array(out, pa.binary())

    return pack


def combine(kind: str) -> Callable:
    """AND, OR, XOR or ANDNOT of two bitmap columns; a null bitmap is empty."""
    todo = {"and": np.bitwise_and, "or": np.bitwise_or, "xor": np.bitwise_xor, "andnot": lambda a, b: a & ~b}[kind]

    @F.arrow_udf("binary")
    def combined(left: pa.Array, right: pa.Array) -> pa.Array:
        empty = bytes(SPAN // 8)
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([todo(np.frombuffer(a or empty, np.uint8), np.frombuffer(b or empty, np.uint8)).tobytes() for a, b in pairs], pa.binary())

    return combined


def positions(df: DataFrame, bitmap: str = "bitmap", name: str = "value") -> DataFrame:
    """A row for each position that is set, with the bucket's offset added."""

    @F.arrow_udf("array<int>")
    def unpack(column: pa.Array) -> pa.Array:
        return pa.array([np.flatnonzero(np.unpackbits(np.frombuffer(x or b"", np.uint8), bitorder="little")).tolist() for x in column.to_pylist()], pa.list_(pa.int32()))

    kept = [c for c in df.columns if c not in (bitmap, name)]
    return df.select(*kept, F.explode(unpack(F.col(bitmap))).alias("p")).withColumn(name, F.col("bucket_offset") + F.col("p")).drop("p")


def bit_count(bitmap: Column) -> Column:
    """Positions that are set, from the hexadecimal digits."""
    digits = F.split(F.hex(bitmap), "")
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a + F.when(d == "", F.lit(0)).otherwise(F.bit_count(F.conv(F.when(d == "", "0").otherwise(d), 16, 10).cast("int"))))
