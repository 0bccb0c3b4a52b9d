"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The mix is ``blocks`` of equal tokens. Seats go to sources by the highest quotients target / (2n + 1), and
each source's seats to its shards in the same way. A shard lays its documents behind each other in seeded
order, so block b holds the words from b times the block size on. A quota of whole rounds takes every
block; the blocks that are left over are a run from a seeded start, around the end.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraql.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a shard, about; words of a block; rows of a plan that is broadcast, at most.
SHARD_WORDS, BLOCK_WORDS, BROADCAST_ROWS = 1 << 21, 64, 20_000


def word_count(text: Column) -> Column:
    """Number of runs of other characters than the six ASCII spaces; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """Shares of sum(sizes) by weight; what exceeds cap times a size goes to the others by weight, until none exceeds."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        per = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * per > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * per
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2n + 1), ties to the first; none gets more than ``most``."""
    votes = np.asarray(votes, float)
    limit = np.full(len(votes), seats) if most is None else np.asarray(most)
    total = votes.sum()
    given = np.zeros(len(votes), np.int64)
    if total <= 0 or seats <= 0:
        return given.tolist()
    if seats > len(votes):
        # all quotients above a divisor at once: a start that the highest quotients are sure to contain
        given = np.floor(votes / (total / (seats - len(votes) / 2)) + 0.5).astype(np.int64)
        given = np.maximum(0, np.minimum(given - 1, limit))
    heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes.tolist(), given.tolist(), strict=True)) if v > 0 and g < limit[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        if not heap:
            break
        _, i = heap[0]
        given[i] += 1
        if given[i] < limit[i]:
            heapq.heapreplace(heap, (-votes[i] / (2 * given[i] + 1), i))
        else:
            heapq.heappop(heap)
    return given.tolist()


def small(table: DataFrame) -> DataFrame:
    """The table, kept in the shared folder, and broadcast where it is small enough."""
    held = cut(table)
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held


def placed(docs: DataFrame, weights: Sequence[float], cap: int, seed: int, shard_words: int, block_words: int, carried: bool) -> DataFrame:
    """Each row with its place in its shard's stream and what the mix takes of it."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    rows = docs.select(*[F.struct("*").alias("row")] * carried, "doc_id", F.col("source").alias("source"), word_count(F.col("text")).alias("size"), order.alias("order"))
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))

    def planned(every: pd.DataFrame) -> pd.DataFrame:
        named = every[every["source"].notna()]
        named = named.iloc[np.argsort(np.array([x.encode("utf-8") for x in named["source"]], object), kind="stable")]
        frame = pd.concat([named, every[every["source"].isna()]]).reset_index(drop=True)
        sizes = [int(x) for x in frame["source_size"]]
        frame["target"] = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], cap)
        frame["shards"] = [max(1, -(-x // shard_words)) for x in sizes]
        frame["quota"] = sainte_lague(frame["target"], sum(sizes) // block_words, [cap * x // block_words for x in sizes])
        return frame[["source", "source_size", "target", "shards", "quota"]]

    plan = small(by_source.withColumn("every", F.lit(True)).groupBy("every").applyInPandas(planned, "source string, source_size long, target double, shards long, quota long"))
    plan = plan.withColumnRenamed("source", "plan_source")
    sharded = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left").drop("plan_source")
    sharded = sharded.withColumn("shard", F.pmod(F.xxhash64("order", F.lit(1)), F.col("shards")))
    shards = sharded.groupBy("source", "shard").agg(F.sum("size").alias("length"), F.max("quota").alias("quota"), F.max("target").alias("target"))

    def dealt(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("shard").reset_index(drop=True)
        sizes = own["length"].astype(int).tolist()
        seats = sainte_lague(sizes, int(own["quota"].iloc[0]), [cap * x // block_words for x in sizes])
        # what whole blocks leave to the target, by the word
        short, words = int(round(own["target"].iloc[0])) - sum(seats) * block_words, []
        for x, n in zip(sizes, seats, strict=True):
            more = max(min(short, cap * x - n * block_words), -n * block_words)
            words.append(n * block_words + more)
            short -= more
        own["words"] = words
        return own[["source", "shard", "length", "words"]]

    deal = small(shards.groupBy("source").applyInPandas(dealt, "source string, shard long, length long, words long"))
    deal = deal.withColumnRenamed("source", "deal_source").withColumnRenamed("shard", "deal_shard")
    stream = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = sharded.withColumn("at", F.sum("size").over(stream) - F.col("size"))
    full = full.join(deal, F.col("source").eqNullSafe(F.col("deal_source")) & (F.col("shard") == F.col("deal_shard")), "left")
    full = full.withColumn("length", F.greatest("length", F.lit(1)))
    full = full.withColumn("rounds", F.expr("words div length")).withColumn("left", F.expr("words % length"))
    start = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.ceil(F.col("length") / F.lit(block_words)).cast("long")) * block_words
    full = full.withColumn("start", start).withColumn("stop", F.col("start") + F.col("left"))

    def shared(low: Column, high: Column) -> Column:
        """Words of the row in a stretch of the stream."""
        return F.greatest(F.lit(0), F.least(high, F.col("at") + F.col("size")) - F.greatest(low, F.col("at")))

    full = full.withColumn("ahead", shared(F.col("start"), F.least("stop", "length")))
    full = full.withColumn("around", shared(F.lit(0), F.col("stop") - F.col("length")))
    full = full.withColumn("rounds", F.when(F.col("size") > 0, F.col("rounds")).otherwise(F.lit(0)))
    return full.withColumn("taken", F.col("rounds") * F.col("size") + F.col("ahead") + F.col("around"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3, seed: int = 42, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target and taken, one row for each row of docs (doc_id, source, text).

    Sizes are in words (null and empty texts: 0). Sources in code point order, null last, weigh as ``weights``
    says, repeating, and share all words; a target stops at ``cap`` times its source's size, and the others
    share the excess by weight. ``taken`` is the words that the mix takes of the row, repeats counted, at most
    cap times its size. A source's rows together have its target, rounded. Reruns agree: order and blocks
    depend on seed, doc_id and text; rows that share these and the source get places behind each other.
    Tasks of their own hold one row for each source, and one for each shard of a source, never documents.
    """
    out = placed(docs.select("doc_id", "source", "text"), weights, cap, seed, shard_words, block_words, False)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3, seed: int = 42, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: each row as often as the mix takes it whole, and once more with the other words it takes.

    Rows of which nothing is taken go, those without a word among them. A part has its words joined by blanks;
    n_chars, where docs has it, follows the new text.
    """
    full = placed(docs, weights, cap, seed, shard_words, block_words, True)
    parts = F.col("ahead") + F.col("around")
    whole = F.when(F.col("rounds") > 0, F.sequence(F.lit(1), F.col("rounds"))).otherwise(F.array().cast("array<bigint>"))
    copy = F.concat(whole, F.when(parts > 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    each = full.withColumn("copy", F.explode(copy))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0))
    first = F.greatest(F.col("start") - F.col("at"), F.lit(0))
    cut_ = F.concat(F.slice(words, F.lit(1), F.col("around").cast("int")), F.slice(words, (first + 1).cast("int"), F.col("ahead").cast("int")))
    each = each.withColumn("new_text", F.when((F.col("copy") > 0) | (parts == F.col("size")), F.col("row.text")).otherwise(F.array_join(cut_, " ")))
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return each.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
