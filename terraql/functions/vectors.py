"""Distances of vectors in arrays, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE, NAN = float("inf"), float("nan")


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _products(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))


def dot(left: Column, right: Column) -> Column:
    return _sum(_products(left, right))


def dot_product_distance(left: Column, right: Column) -> Column:
    """The negative inner product, so that near is small."""
    return -dot(left, right)


def euclidean_square_distance(left: Column, right: Column) -> Column:
    return _sum(F.zip_with(left, right, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))))


def euclidean_distance(left: Column, right: Column) -> Column:
    return F.sqrt(euclidean_square_distance(left, right))


def cosine_distance(left: Column, right: Column) -> Column:
    """1 less the cosine; infinite if either is zero, else not a number if either or their product isn't finite."""
    one, two, both = dot(left, left), dot(right, right), dot(left, right)
    zero = (one == 0) | (two == 0)
    bad = F.isnan(F.lit(0.0) * one * two * both)
    return F.when(zero, F.lit(INFINITE)).when(bad, F.lit(NAN)).otherwise(F.lit(1.0) - both / F.when(zero, F.lit(1.0)).otherwise(F.sqrt(one) * F.sqrt(two)))


METRICS = {"euclidean": euclidean_distance, "euclidean_square": euclidean_square_distance, "cosine": cosine_distance, "dot_product": dot_product_distance}
