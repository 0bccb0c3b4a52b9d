"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately, so each pair of centroids is a cell. For a query,
a heap walks the pairs by the sum of their two distances until the cells reached hold the wanted share of all
rows. Rows of those cells are reranked by their exact inner products.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraql.llm.vectors import appended, blocks, finite, matrices, queries_of

#: Centroids of each half, at least and at most; rows they are fitted on, queries of a block, rows held at a time.
CENTROIDS, SAMPLE, QUERIES, ROWS = (64, 1024), 1 << 15, 2048, 1 << 16
#: Share of all rows in the cells that a query visits with the least centroids; it falls with more. Measured recall in the README.
SHARE = 0.5
#: Bits of the visited cells of a block of queries, neighbouring centroids of a half that the heap takes together.
VISITED, SIDE = 1 << 28, 16


def sized(n: int) -> tuple[int, float]:
    """Centroids of each half for n rows, about the root of n / 3, and the share of rows to visit, which falls with their cube root."""
    k = 1 << int(np.clip(round(np.log2(max(n, 1) ** 0.5 / 1.7)), *np.log2(CENTROIDS).astype(int)))
    return k, SHARE * (CENTROIDS[0] / k) ** (1 / 3)


def k_means(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[np.sort(rng.choice(len(points), min(k, len(points)), replace=False))]
    for _ in range(rounds):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * points @ centres.T, axis=1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells (row-major) by rising first + second until they hold ``wanted`` rows; sizes has the rows of each cell.

    The heap holds squares of neighbours in the two orders by their least sum; what lies above the sum that it ends with is cut off.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    one, two = first[a], second[b]
    heap, cells, sums, rows, held, limit = [(one[0] + two[0], 0, 0)], [], [], [], 0, np.inf
    while heap and heap[0][0] <= limit:
        _, i, j = heapq.heappop(heap)
        own = (a[i : i + SIDE, None] * len(b) + b[None, j : j + SIDE]).ravel()
        full = np.flatnonzero(sizes[own])
        cells.append(own[full])
        sums.append((one[i : i + SIDE, None] + two[None, j : j + SIDE]).ravel()[full])
        rows.append(sizes[cells[-1]])
        held += int(rows[-1].sum())
        if j + SIDE < len(two):
            heapq.heappush(heap, (one[i] + two[j + SIDE], i, j + SIDE))
        if j == 0 and i + SIDE < len(one):
            heapq.heappush(heap, (one[i + SIDE] + two[0], i + SIDE, 0))
        if held >= wanted and limit == np.inf:  # no cell beyond this sum can be needed
            order = np.argsort(every := np.concatenate(sums), kind="stable")
            limit = every[order][np.searchsorted(np.cumsum(np.concatenate(rows)[order]), wanted)]
    order = np.argsort(np.concatenate(sums), kind="stable")
    before = np.cumsum(np.concatenate(rows)[order]) - np.concatenate(rows)[order]
    return np.concatenate(cells)[order][before < wanted].tolist()


class MultiIndex:
    """Centroids of both halves, fitted on a sample."""

    def __init__(self, sample: np.ndarray, k: int, seed: int) -> None:
        self.half = (sample.shape[1] + 1) // 2
        self.first, self.second = k_means(sample[:, : self.half], k, seed), k_means(sample[:, self.half :], k, seed + 1)
        self.cells = len(self.first) * len(self.second)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.first) * len(self.second) + nearest(x[:, self.half :], self.second)

    def visits(self, queries: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
        """For each query, a bit for each cell: whether it visits it. Distances are negative inner products, as the ranking is."""
        out = np.zeros((len(queries), (self.cells + 7) // 8), np.uint8)
        one, two = -queries[:, : self.half] @ self.first.T, -queries[:, self.half :] @ self.second.T
        for i in range(len(queries)):
            own = np.zeros(self.cells, bool)
            own[walk(one[i], two[i], sizes, wanted)] = True
            out[i] = np.packbits(own)
        return out


def dots(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products whose rounding doesn't depend on a row's place."""
    return (rows * query).sum(axis=1)


def rerank(batches: Iterator[pa.RecordBatch], size: int, ids: np.ndarray, queries: np.ndarray, packed: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, v, cell) to the k nearest rows of each query in the cells whose bits it has."""
    best_id = [np.zeros(0, np.int64) for _ in ids]
    best_at = [np.zeros(0) for _ in ids]
    least = np.full(len(ids), -np.inf)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        vec, x, cell = (np.concatenate(z) for z in zip(*held, strict=True))
        held.clear()
        order = np.argsort(cell, kind="stable")
        vec, x, cell = vec[order], x[order], cell[order]
        entries: list[list[np.ndarray]] = [[] for _ in ids]
        seen = np.zeros(len(ids), np.int64)
        # cell by cell; products of many rows at once pick the entries, the exact ones rank them
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
            c = cell[s]
            asking = np.flatnonzero(packed[:, c >> 3] >> (7 - (c & 7)) & 1)
            rough = queries[asking] @ x[s:e].T
            keep = rough >= (least[asking] - 1e-9 * (1 + np.abs(least[asking])))[:, None]
            who, what = np.nonzero(keep)
            cuts = np.searchsorted(who, np.arange(len(asking) + 1)).tolist()
            for i in np.unique(who).tolist():
                q = asking[i]
                entries[q].append(what[cuts[i] : cuts[i + 1]] + s)
                seen[q] += cuts[i + 1] - cuts[i]
                if seen[q] >= 8 * k:
                    trim(q, vec, x, entries, seen)
        for q in np.flatnonzero(seen).tolist():
            trim(q, vec, x, entries, seen)

    def trim(q: int, vec: np.ndarray, x: np.ndarray, entries: list[list[np.ndarray]], seen: np.ndarray) -> None:
        rows = np.concatenate(entries[q])
        rows = rows[vec[rows] != ids[q]]
        found, at = np.concatenate([best_id[q], vec[rows]]), np.concatenate([best_at[q], dots(x[rows], queries[q])])
        order = np.lexsort((found, -at))[:k]
        best_id[q], best_at[q] = found[order], at[order]
        if len(order) == k:
            least[q] = best_at[q][-1]
        entries[q], seen[q] = [], 0

    n = 0
    for batch in batches:
        vec, cell = batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
        for rows, x in matrices(batch, "v"):
            if x.shape[1] == size:
                held.append((vec[rows], x, cell[rows]))
                n += len(rows)
        if n >= ROWS:
            settle()
            n = 0
    if held:
        settle()
    counts = [len(x) for x in best_id]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.concatenate([np.zeros(0, np.int64), *best_id])), pa.array(np.concatenate([np.zeros(0), *best_at]))], ["query_id", "vec_id", "score"])


def nearest_neighbours(vectors: DataFrame, modulus: int, k: int = 20, share: float | None = None, centroids: int | None = None, sample: int = SAMPLE, seed: int = 42, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id the modulus divides, the k nearest rows found.

    Nearest is the largest inner product, in double precision on the original vectors; ties go to the smaller id.
    Centroids are fitted on the ``sample`` rows of the smallest hashes of their ids; every row is indexed, and
    a query visits cells until they hold ``share`` of all rows and at least 4 * k (all rows, if fewer). How many centroids
    a half has and what share is visited follow the number of rows (``sized``) unless they are given. Candidates
    are all rows of another id and the same number of components. Rows with a null id, and vectors null, empty,
    zero or with a null or non-finite component take no part. Rows that repeat an id are candidates each, and
    one query: that of the smallest vector. Vectors of another length than the commonest (ties: the
    shorter) have an index of their own each.
    """
    spark = vectors.sparkSession
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    nonzero = F.exists(F.col(vector), lambda x: x != 0)
    index = vectors.where(F.col(vec_id).isNotNull() & finite(F.col(vector)) & nonzero).select(F.col(vec_id).cast("long").alias("vec_id"), doubles.alias("v"))
    parts = []
    for row in index.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").toLocalIterator():
        parts.append(_of_length(index.where(F.size("v") == row["n"]), row["n"], row["count"], modulus, k, share, centroids, sample, seed))
    schema = "query_id long, rank int, vec_id long, score double"
    return spark.createDataFrame([], schema) if not parts else parts[0] if len(parts) == 1 else _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _of_length(index: DataFrame, size: int, n: int, modulus: int, k: int, share: float | None, centroids: int | None, sample: int, seed: int) -> DataFrame:
    spark = index.sparkSession
    own = sized(n)
    centroids, share = centroids or own[0], own[1] if share is None else share
    picked = index.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toPandas()
    made = spark.sparkContext.broadcast(MultiIndex(np.stack(picked["v"].to_list()), centroids, seed))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for rows, x in matrices(batch, "v"):
                cell[rows] = made.value.cell(x)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell)], ["vec_id", "v", "cell"])

    celled = index.mapInArrow(cells, "vec_id long, v array<double>, cell int")
    sizes = np.zeros(made.value.cells, np.int64)
    for row in celled.groupBy("cell").count().toLocalIterator():  # at most centroids**2 rows
        sizes[row["cell"]] = row["count"]
    wanted = min(n, max(4 * k, int(share * n)))

    def found(ids: np.ndarray, rows: list[np.ndarray]) -> DataFrame:
        queries = np.stack(rows)
        held = spark.sparkContext.broadcast((ids, queries, _visits(spark, made, ids, queries, sizes, wanted)))
        near = celled.mapInArrow(lambda b: rerank(b, size, *held.value, k), "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    most = max(1, min(QUERIES, VISITED // made.value.cells))
    return appended(spark, (found(*block) for block in blocks(queries_of(index, modulus), most)), "query_id long, rank int, vec_id long, score double")


def _visits(spark, made, ids: np.ndarray, queries: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
    """The walks of one block of queries, spread over the executors; the result has centroids**2 bits for each query."""
    chunks = np.array_split(np.arange(len(ids)), min(len(ids), 2 * spark.sparkContext.defaultParallelism))
    held = spark.sparkContext.broadcast((queries, sizes))
    table = spark.createDataFrame([(i, int(c[0]), int(c[-1]) + 1) for i, c in enumerate(chunks)], "chunk int, first int, last int")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = held.value
        for batch in batches:
            for one in batch.to_pylist():
                bits = made.value.visits(rows[one["first"] : one["last"]], n, wanted)
                yield pa.RecordBatch.from_arrays([pa.array([one["chunk"]], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["chunk", "bits"])

    got = table.repartition(len(chunks), "chunk").mapInArrow(walked, "chunk int, bits binary").collect()
    width = (made.value.cells + 7) // 8
    return np.concatenate([np.frombuffer(r["bits"], np.uint8).reshape(-1, width) for r in sorted(got, key=lambda r: r["chunk"])])
