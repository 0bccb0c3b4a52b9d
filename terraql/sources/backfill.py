"""Index tables built from rows that are already there, part by part, so that a job that stopped is taken up again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _done(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def build(rows: DataFrame, path: str, key: Sequence[str], parts: int = 16, most: int | None = None) -> DataFrame:
    """The index written to a folder: rows in ``parts`` parts by the hash of their key, each sorted by it.

    A part that is complete is not written again; ``most`` bounds how many are written in this call. Rows have to be the same
    from call to call. Returns what is there, complete or not.
    """
    spark, written = rows.sparkSession, 0
    for n in range(parts):
        to = f"{path}/part={n}"
        if _done(spark, to):
            continue
        if most is not None and written == most:
            break
        own = rows.where(F.pmod(F.xxhash64(*key), F.lit(parts)) == n)
        own.repartition(*key).sortWithinPartitions(*key).write.mode("overwrite").parquet(to)
        written += 1
    return spark.read.schema(rows.schema).option("basePath", path).parquet(f"{path}/part=*").select(*rows.columns)
