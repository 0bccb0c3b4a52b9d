"""Exact top-k by inner product over a bit-sliced index.

A block of rows keeps, for each attribute, one bitmap for each bit of its quantised values. For a query
the bitmaps are added with their weights by carry-save adders, which gives the bitmaps of the sums. Rows are
selected from the most significant bitmap downward. Low bits that are left out of the sums bound how far a
sum can be off, and the rows within that bound of the boundary are resolved by exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraql.llm.vectors import appended, blocks, finite, matrices, queries_of

#: Rows of an index block, queries of a block, and bitmaps kept for each attribute.
ROWS, QUERIES, SLICES = 1 << 16, 2048, 6
#: Rows with a component from these sizes on are kept in blocks of their own, the last as Python integers.
LARGE, HUGE = 1 << 25, 1 << 62
#: Doubles from this size on are integers.
WHOLE = 1 << 53


def integers(values: np.ndarray) -> np.ndarray:
    """Whole doubles as int64, or as Python integers where one is too large."""
    return values.astype(np.int64) if np.abs(values).max(initial=0) < HUGE else np.frompyfunc(int, 1, 1)(values)


def products(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of rows and a query: int64, or Python integers where some could overflow."""
    weight = sum(abs(x) for x in query.tolist())
    sure = np.zeros(len(values), bool)
    if values.dtype != object and query.dtype != object:
        sure = np.abs(values).max(axis=1, initial=0) <= ((1 << 63) - 1) // max(weight, 1)
        if sure.all():
            return values @ query
    out = np.empty(len(values), object)
    if sure.any():
        out[sure] = values[sure] @ query
    out[~sure] = values[~sure].astype(object) @ query.astype(object)
    return out


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores; of equal ones, those of the smaller ids."""
    order = np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k], np.int64)
    return ids[order], scores[order]


def added(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Bitmaps by weight (arrays of rows of bitmaps of weight 2**i) to the bitmaps of their sum, least significant first."""
    out, i, carry = [], 0, []
    while i < len(columns) or carry:
        here = carry + (columns[i] if i < len(columns) else [])
        carry = []
        if not here:
            out.append(None)
            i += 1
            continue
        stack = np.concatenate(here)
        while len(stack) > 1:
            if len(stack) == 2:
                a, b = stack
                carry.append((a & b)[None])
                stack = (a ^ b)[None]
                break
            n = len(stack) // 3
            a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
            x = a ^ b
            carry.append((a & b) | (x & c))
            stack = np.concatenate([x ^ c, stack[3 * n :]])
        out.append(stack[0])
        i += 1
    return out


class BitSlices:
    """The index of one block: a row of int64 values for each vector."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.values = ids, values
        self.low = values.min(axis=0)
        spread = values - self.low
        self.shift = max(0, int(spread.max()).bit_length() - SLICES)
        high = spread >> self.shift
        self.bits = max(1, int(high.max()).bit_length())
        n, self.words = len(ids), (len(ids) + 63) // 64
        padded = np.zeros((self.words * 64, values.shape[1]), np.int64)
        padded[:n] = high
        planes = [np.packbits((padded >> b & 1).astype(np.uint8), axis=0, bitorder="little") for b in range(self.bits)]
        self.planes = np.ascontiguousarray(np.stack([p.T for p in planes])).view("<u8")  # bit, attribute, word
        self.valid = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view("<u8")

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k highest scores, and of all rows that tie with the last."""
        weight = np.abs(query)
        columns: list[list[np.ndarray]] = [[] for _ in range(self.bits + int(weight.max(initial=0)).bit_length())]
        for b in range(self.bits):
            plane = np.where((query < 0)[:, None], ~self.planes[b], self.planes[b])  # -w*x is w*(full-x), less a constant
            for p in range(int(weight.max(initial=0)).bit_length()):
                chosen = (weight >> p & 1) == 1
                if chosen.any():
                    columns[b + p].append(plane[chosen])
        sums = [(i, s) for i, s in enumerate(added(columns)) if s is not None]
        rest = self.valid.copy()
        for row in np.flatnonzero(self.ids == own):
            rest[row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
        total = int(np.bitwise_count(rest).sum())
        if total <= k:
            return self._exact(rest, query)
        sure, tied, limit, need = np.zeros_like(rest), rest, 0, k
        for i, s in reversed(sums):
            ones = tied & s
            n = int(np.bitwise_count(ones).sum())
            if n >= need:
                tied, limit = ones, limit | 1 << i
            else:
                sure, need, tied = sure | ones, need - n, tied & ~s
        # every sum is at most this far below the score in units of the kept bits, so a lower sum can't reach the boundary
        floor = limit - int((((1 << self.shift) - 1) * sum(weight.tolist())) // (1 << self.shift)) - 1
        return self._exact(self._at_least(sums, rest, floor), query)

    def _at_least(self, sums: list[tuple[int, np.ndarray]], rest: np.ndarray, floor: int) -> np.ndarray:
        if floor <= 0:
            return rest
        if floor >> (sums[-1][0] + 1):
            return np.zeros_like(rest)
        slices = dict(sums)
        above, equal = np.zeros_like(rest), rest
        for i in range(sums[-1][0], -1, -1):
            s = slices.get(i)
            if floor >> i & 1:
                equal = equal & s if s is not None else np.zeros_like(rest)
            elif s is not None:
                above, equal = above | (equal & s), equal & ~s
        return above | equal

    def _exact(self, bitmap: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
        return rows, products(self.values[rows], query)


def search(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: list[np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in range(len(ids))}
    held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

    def settle(key: tuple[int, int]) -> None:
        of, values = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
        index = BitSlices(of, values) if values.dtype != object else None
        for i, query in enumerate(queries):
            if len(query) == key[0]:
                if index is not None and query.dtype != object:
                    rows, scores = index.best(query, ids[i], k)
                else:
                    rows = np.flatnonzero(of != ids[i])
                    scores = products(values[rows], query)
                best[i] = first(np.concatenate([best[i][0], of[rows]]), np.concatenate([best[i][1], scores]), k)

    for batch in batches:
        vec = batch.column("vec_id").to_numpy()
        for rows, values in matrices(batch, "v"):
            largest = np.abs(values).max(axis=1)
            kind = (largest >= LARGE).astype(np.int64) + (largest >= HUGE)
            for n in np.unique(kind).tolist():
                key = values.shape[1], n
                held.setdefault(key, []).append((vec[rows[kind == n]], integers(values[kind == n])))
                if sum(len(x) for x, _ in held[key]) >= ROWS:
                    settle(key)
    for key in list(held):
        settle(key)
    counts = [len(best[i][0]) for i in range(len(ids))]
    found = np.concatenate([best[i][0] for i in range(len(ids))]) if counts else np.zeros(0, np.int64)
    scores = [s for i in range(len(ids)) for s in best[i][1].tolist()]
    over = [(s >= 1 << 63) - (s < -(1 << 63)) for s in scores]
    scores = [0 if o else s for s, o in zip(scores, over, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(found), pa.array(scores, pa.int64()), pa.array(over, pa.int8())], ["query_id", "vec_id", "score", "over"])


def top_k(vectors: DataFrame, modulus: int, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id the modulus divides, the k highest integer inner products.

    Components are floor(scale * x), x as a double. Candidates are all rows of another id and the same
    number of components; ties go to the smaller id, and with fewer than k candidates all are returned. Rows
    with a null id, and vectors null, empty or with a null or non-finite component take no part. Components of any
    size are scored exactly; it is an error if one overflows a double when scaled, or if one of the k highest scores
    doesn't fit a long. Rows that repeat an id are candidates each, and one query: that of the smallest
    vector. Queries are held in blocks of 2,048, and each block passes over all rows.
    """
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    quantised = F.transform(scaled, lambda x: F.when(F.abs(x) < WHOLE, F.floor(x).cast("double")).otherwise(x))
    index = vectors.where(F.col(vec_id).isNotNull() & finite(F.col(vector))).select(F.col(vec_id).cast("long").alias("vec_id"), quantised.alias("v"))
    spark = vectors.sparkSession

    def found(ids: np.ndarray, queries: list[np.ndarray]) -> DataFrame:
        held = spark.sparkContext.broadcast((ids, [integers(q) for q in queries]))
        near = index.mapInArrow(lambda b: search(b, *held.value, k), "query_id long, vec_id long, score long, over tinyint")
        order = Window.partitionBy("query_id").orderBy(F.col("over").desc(), F.col("score").desc(), "vec_id")
        ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score of the top k doesn't fit a long"))).alias("score"))

    return appended(spark, (found(*block) for block in blocks(queries_of(index, modulus), QUERIES)), "query_id long, rank int, vec_id long, score long")
