"""Structured Streaming: windows over event time, running extrema, the best rows so far, and merged writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """New parquet files of a folder, or the files that a pattern names."""
    schema = spark.read.parquet(path).schema
    if not any(c in path for c in "*?["):
        path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, so that a single file will do
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(events: DataFrame, time: str, length: str, slide: str | None = None, late: str = "10 minutes", groups: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Number and sum in tumbling or sliding windows; windows close when the watermark has passed them."""
    return _summed(events.withWatermark(time, late), F.window(F.col(time), length, slide or length), groups, value)


def sessions(events: DataFrame, time: str, gap: str, late: str = "10 minutes", groups: Sequence[str] = (), value: str = "value") -> DataFrame:
    return _summed(events.withWatermark(time, late), F.session_window(F.col(time), gap), groups, value)


def _summed(events: DataFrame, window, groups: Sequence[str], value: str) -> DataFrame:
    out = events.groupBy(window.alias("w"), *groups).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *groups, "n", "total")


def extrema_ever(events: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """MIN_EVER and MAX_EVER of a stream of writes, for the update or complete mode."""
    return events.groupBy(*groups).agg(F.min(value).alias("min_ever"), F.max(value).alias("max_ever"), F.count(F.lit(1)).alias("count_updates"))


def best_so_far(events: DataFrame, group: str, key: str, score: str, k: int) -> DataFrame:
    """The k highest scores of each group after each batch, kept as state of k rows for each group."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for rows in batches:
            held += list(zip(rows[key].tolist(), rows[score].tolist(), strict=True))
            held = sorted(set(held), key=lambda x: (-x[1], x[0]))[:k]
        state.update(([x for x, _ in held], [s for _, s in held]))
        yield pd.DataFrame({"group": [name[0]] * len(held), "rank": range(len(held)), "key": [x for x, _ in held], "score": [s for _, s in held]})

    kind = dict(events.dtypes)
    schema = f"group {kind[group]}, rank bigint, key {kind[key]}, score {kind[score]}"
    return events.where(F.col(score).isNotNull()).groupBy(group).applyInPandasWithState(step, schema, f"keys array<{kind[key]}>, scores array<{kind[score]}>", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream over present files gives, as a table in memory: for tests and small backfills."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def pending_writes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Writes deferred to batches: each batch is applied as a whole, and once by its number."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
