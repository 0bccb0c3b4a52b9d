"""Storage that every executor sees, for cutting lineage and for scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a new one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="terraql-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Bytes of an Arrow batch, at most: two workers hold a few copies each of theirs beside the heap of an executor.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit for the bytes of an Arrow batch; one that is lower already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """df with its rows kept in the shared folder and its lineage gone; Spark's cleaner removes the rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Parquet tables in the shared folder that go when the block ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        remove(self.spark, self.root)


#: Makes Spark remove the shuffle files of a query when it ends, instead of when its plan is forgotten.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Scratch tables for a block; the shuffle files of each table that it writes go when the table is there."""
    held, before = Scratch(spark), spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield held
    finally:
        spark.conf.set(TIDY, before)
        held.drop()
