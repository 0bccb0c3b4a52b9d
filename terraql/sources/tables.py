"""Tables on storage: reading, export and import, and views over rows of several types."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE = "_record_type"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a local master, where it may be unset, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="terraql-")
    return found


def kept(df: DataFrame) -> DataFrame:
    """df with its rows written to the shared folder and its lineage gone."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """Temporary views, so that SQL sees the tables by name."""
    for name in names:
        read(spark, folder, name).createOrReplaceTempView(name)


def export(df: DataFrame, path: str, *partition_by: str) -> None:
    """COPY to a path."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """COPY from a path; with a schema, missing columns are null and others are left out."""
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def extent(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of several record types in one, with the type as a column; columns that a type lacks are null."""
    out = None
    for name, df in tables.items():
        typed = df.withColumn(TYPE, F.lit(name))
        out = typed if out is None else out.unionByName(typed, allowMissingColumns=True)
    if out is None:
        raise ValueError("an extent has at least one record type")
    return out


def of_type(rows: DataFrame, *types: str) -> DataFrame:
    """Only the branches of these types are read: Catalyst folds the constant column."""
    return rows.where(F.col(TYPE).isin(*types))
