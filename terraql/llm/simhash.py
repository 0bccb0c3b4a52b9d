"""SimHash near-duplicates: 64-bit fingerprints, linked by tiled exact comparison.

Fingerprints that differ in at most ``radius`` bits agree on at least one of every ``radius + 1``
blocks of bits, so each is dealt to a bucket for each choice of agreeing blocks. In a bucket they
are sorted by population count, cut into tiles and compared tile by tile with exclusive-or and bit
counts; tile pairs whose population counts differ beyond the radius are skipped. A bucket of more
than ``TILE`` fingerprints is cut into tiles before the shuffle, and each pair of tiles is a unit of
its own, so no task holds a whole hot bucket.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraql.llm.components import components
from terraql.llm.shared import bounded_batches, cut

SEED, TILE, CHUNK = 42, 8192, 1 << 17
#: Up to so many fingerprints, buckets agree on 1, 2 or 3 blocks; all are exact, more blocks make smaller buckets and more copies.
LEVELS = (1 << 26, 1 << 33)


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the shingles of ``width`` words; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[at : min(n, at + CHUNK)].tolist(), last[at : at + CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())  # a type, not a string, as workers import this without a session
def fingerprints(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x.as_py()) for x in text], np.uint64).view(np.int64))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes, the smallest node that the links (a, b) reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all() and (new[a] == new[b]).all():
            return label
        label = new[new]
    return label


def linked(x: np.ndarray, y: np.ndarray | None, radius: int, side: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs into x (then y), of all links within x, or between x and y; both sorted by population count."""
    both = x if y is None else np.concatenate([x, y])
    count = np.bitwise_count(both).astype(np.int64)
    at = 0 if y is None else len(x)
    label = np.arange(len(both))
    for i in range(0, len(x), side):
        one = x[i : i + side]
        low, high = count[i], count[i + len(one) - 1]
        for j in range(at if y is not None else i, len(both), side):
            two = both[j : j + side]
            if count[j] - high > radius or low - count[j + len(two) - 1] > radius:
                continue
            p, q = np.nonzero(np.bitwise_count(one[:, None] ^ two[None, :]) <= radius)
            p, q = p + i, q + j
            p, q = p[p != q], q[p != q]
            p, q = label[p], label[q]
            if (differ := p != q).any():
                label = forest(p[differ], q[differ], len(both))[label]
    others = np.flatnonzero(label != np.arange(len(both)))
    return label[others], others


def compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (unit, part, fp) sorted by unit: links of each unit as rows (u, v), a forest each."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def emit(unit: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(unit[1:] != unit[:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(unit)]))
        u, v = [], []
        n = ends - starts
        small = np.flatnonzero((n > 1) & (n <= 64))
        for group in np.array_split(small, len(small) // 4096 + 1):
            if len(group):
                # every pair of every small unit at once
                m, s = n[group], starts[group]
                rows = np.repeat(s, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                after = np.repeat(s + m, m) - rows - 1
                first = np.repeat(rows, after)
                second = first + 1 + np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)
                crossed = part[first] + part[second] != 0
                near = np.bitwise_count(fp[first] ^ fp[second]) <= radius
                near &= ~crossed | (part[first] != part[second])
                u.append(fp[first[near]])
                v.append(fp[second[near]])
        for k in np.flatnonzero(n > 64):
            f, p = fp[starts[k] : ends[k]], part[starts[k] : ends[k]]
            order = np.argsort(np.bitwise_count(f), kind="stable")
            f, p = f[order], p[order]
            x, y = (f, None) if not p.any() else (f[p == 1], f[p == 2])
            a, b = linked(x, y, radius)
            f = x if y is None else np.concatenate([x, y])
            u.append(f[a])
            v.append(f[b])
        u, v = (np.concatenate(z).view(np.int64) if z else np.zeros(0, np.int64) for z in (u, v))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(np.uint64)))
        if sum(len(h[0]) for h in held) < 1 << 16:
            continue
        unit, part, fp = (np.concatenate(z) for z in zip(*held, strict=True))
        last = np.searchsorted(unit, unit[-1])
        held = [(unit[last:], part[last:], fp[last:])]
        if last:
            yield emit(unit[:last], part[:last], fp[:last])
    if held:
        yield emit(*(np.concatenate(z) for z in zip(*held, strict=True)))


def blocks_for(n: int, radius: int) -> tuple[int, int]:
    """Blocks of bits, and how many of them agree in a bucket."""
    agree = 1 + sum(n > level for level in LEVELS)
    return radius + agree, agree


def links(distinct: DataFrame, radius: int, n: int, tile: int = TILE) -> DataFrame:
    """Links (u, v) between the values of the column ``fp``: they connect exactly what all links within the radius connect."""
    blocks, agree = blocks_for(n, radius)
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    masks = []
    for chosen in itertools.combinations(range(blocks), agree):
        mask = sum(((1 << int(edges[k + 1] - edges[k])) - 1) << int(edges[k]) for k in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    band = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("band", "value")
    dealt = distinct.select("fp", F.bit_count("fp").alias("ones"), band)
    key = ["band", "value"]
    counts = dealt.groupBy(*key, "ones").agg(F.count(F.lit(1)).alias("n"))
    # of a hot bucket, how many tiles each bit count is cut into; there are 65 of them at most
    tiles = F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / F.lit(tile // 2)).cast("int").alias("tiles"))))
    hot = cut(counts.groupBy(*key).agg(F.sum("n").alias("n"), tiles.alias("tiles")).where(F.col("n") > tile).select(*key, "tiles"))
    plain = dealt.join(hot, key, "left_anti").select(F.xxhash64("band", "value").alias("unit"), F.lit(0).alias("part"), "fp")
    if not hot.isEmpty():
        # tile (ones, slice): compared with itself and with every tile of the bucket at most radius ones away
        tiled = dealt.join(hot, key).withColumn("slice", F.pmod(F.xxhash64("fp"), F.try_element_at("tiles", "ones")).cast("int"))
        place = F.struct(F.col("ones").alias("o"), F.col("slice").alias("s"))
        near = F.filter(F.map_entries("tiles"), lambda e: F.abs(e["key"] - F.col("ones")) <= radius)
        every = F.explode(F.flatten(F.transform(near, lambda e: F.transform(F.sequence(F.lit(0), e["value"] - 1), lambda s: F.struct(e["key"].alias("o"), s.alias("s"))))))
        paired = tiled.select(*key, "fp", place.alias("own"), every.alias("other"))
        least, most = F.least("own", "other"), F.greatest("own", "other")
        part = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        plain = plain.unionByName(paired.select(F.xxhash64(*key, least, most).alias("unit"), part.alias("part"), "fp"))
    # two buckets with one hash only add comparisons within a unit, which the exact test answers
    sorted_ = plain.repartition("unit").sortWithinPartitions("unit")
    return sorted_.mapInArrow(lambda b: compare(b, radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash (XXH64 of the text), fingerprint (16 hex digits) and component_id, one row for each row of docs.

    ``component_id`` is the smallest doc_id that links of at most ``radius`` differing bits reach, its own
    included. Null and empty texts have fingerprint zero and are linked like any other. A null doc_id counts
    for no component: a component without any other has a null id. Repeated rows are linked to each other.
    Other columns are not read. Texts of any length are hashed whole. ``width`` is the words of a shingle.
    """
    if width != 4:
        raise ValueError("fingerprints are over shingles of four words")
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), fingerprints(F.col(text)).alias("fp"))
    own = cut(own)
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = cut(distinct)
    n = distinct.count()
    reached = components(links(distinct, radius, n))
    root = distinct.join(reached, distinct["fp"] == reached["node"], "inner").select("fp", "least", "root")
    least = root.groupBy("root").agg(F.min("least").alias("component"))
    mapped = root.join(least, "root").select("fp", "component")
    every = distinct.join(mapped, "fp", "left").select(F.col("fp").alias("key"), F.coalesce("component", "least").alias("component_id"))
    every = cut(every)  # as a table, so that the join can split the rows of a hot fingerprint
    joined = own.join(every, own["fp"] == every["key"], "left")
    return joined.select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options: object) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id (nulls last; ties: the smallest text hash), with all its columns.

    Of rows that share that doc_id and text, one stays. Null and empty texts are a group like any other. Texts of any length
    are hashed whole; an empty table stays empty. Other columns are kept, whatever their names.
    """
    found = near_duplicates(docs, **options)
    group = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    least = found.groupBy(group.alias("group")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("kept"))
    key = ["none", "doc_key", "text_key"]  # without nulls, so that one exchange serves both the distinct rows and the join
    named = [F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_key")]
    kept = least.select("kept.*").select(*named, F.col("text_hash").alias("text_key"))
    rows = docs.select(*named, F.xxhash64("text").alias("text_key"), F.struct("*").alias("row"))
    return rows.dropDuplicates(key).join(kept, key, "left_semi").select("row.*")
