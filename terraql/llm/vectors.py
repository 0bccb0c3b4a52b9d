"""What the vector searches share: usable vectors, and queries in blocks of bounded size."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraql.llm.shared import shared_dir


def finite(vector: Column) -> Column:
    """Not null and not empty, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def queries_of(index: DataFrame, modulus: int) -> DataFrame:
    """The query set: rows of index (vec_id, v) whose id the modulus divides; of rows that share an id, that of the smallest vector."""
    return index.where(F.col("vec_id") % modulus == 0).groupBy("vec_id").agg(F.min("v").alias("v"))


def blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The queries in blocks of at most ``size`` rows; the driver holds one block at a time."""
    ids: list[int] = []
    rows: list[np.ndarray] = []
    for row in queries.toLocalIterator():
        ids.append(row["vec_id"])
        rows.append(np.array(row["v"], np.float64))
        if len(ids) == size:
            yield np.array(ids, np.int64), rows
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), rows


def appended(spark: SparkSession, parts: Iterator[DataFrame], schema: str) -> DataFrame:
    """The rows of all parts. Several are written, each once, to one folder of the shared storage as they come; one alone stays a plan."""
    first = next(parts, None)
    second = next(parts, None)
    if first is None:
        return spark.createDataFrame([], schema)
    if second is None:
        return first
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    for part in itertools.chain((first, second), parts):
        part.write.mode("append").parquet(path)
    return spark.read.schema(first.schema).parquet(path)


def matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector in a batch."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[offsets[rows][:, None] + np.arange(size)]
