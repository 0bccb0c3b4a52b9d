"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

The n-grams of the whole text are counted in hashed buckets. Weights are trained by follow-the-regularised-leader
with elastic-net penalties, and a temperature is fitted on texts held back from that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraql.llm.shared import bounded_batches, cut

#: Buckets of n-grams, n-grams of 1 to so many characters, characters read at a time.
BUCKETS, LONGEST, PIECE = 1 << 15, 3, 1 << 20
#: The fit reads at most so many labelled texts of each language; their ids are broadcast up to so many rows.
SAMPLE, BROADCAST_ROWS = 400, 100_000
#: Languages that are learned, those of the most documents; parts in which a language's texts are first picked.
LANGUAGES, SALTS = 256, 128
UNKNOWN = "und"
FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def counts(text: str) -> np.ndarray:
    """Occurrences of each bucket's n-grams in the lower-cased text."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), PIECE):
        low = text[max(0, at - LONGEST + 1) : at + PIECE].lower().encode("utf-32-le", "surrogatepass")
        code = np.frombuffer(low, np.uint32)
        again = min(at, LONGEST - 1)  # characters read before, whose own n-grams are counted
        mixed = code * FACTORS[0]
        for n in range(1, LONGEST + 1):
            if n > 1:
                mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * FACTORS[1] + code[n - 1 :] * FACTORS[2]
            new = mixed[max(0, again - n + 1) :]
            out += np.bincount((new ^ (new >> np.uint32(13))) * FACTORS[1] >> np.uint32(17), minlength=BUCKETS)
    return out


def features(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their TF-IDF weights, of length 1."""
    at = np.flatnonzero(count)
    value = (1 + np.log(count[at])) * idf[at]
    norm = np.sqrt((value * value).sum())
    return at, value / norm if norm else value


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket, label
    bias: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        at, value = features(counts(text), self.idf)
        p = softmax((value @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def train(examples: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3, held_back: float = 0.2, seed: int = 42) -> Model:
    """examples: label, buckets and counts, in an order that depends on nothing but the texts."""
    labels = sorted({label for label, _, _ in examples})
    k, rng = len(labels), np.random.default_rng(seed)
    rows = []
    for label, at, n in examples:
        value = (1 + np.log(n)) * idf[at]
        norm = np.sqrt((value * value).sum())
        rows.append((labels.index(label), at, value / norm if norm else value))
    order = rng.permutation(len(rows))
    n_back = int(len(rows) * held_back) if len(rows) >= 5 else 0
    back, own = order[:n_back], order[n_back:]
    z, g2 = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))  # the last row is the bias

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(g2[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(own):
            y, at, value = rows[i]
            at, value = np.append(at, BUCKETS), np.append(value, 0.1)
            w = weights(at)
            p = softmax(value @ w)
            p[y] -= 1
            g = value[:, None] * p
            sigma = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / alpha
            z[at] += g - sigma * w
            g2[at] += g * g
    every = weights(np.arange(BUCKETS + 1))
    bias = every[-1] * 0.1
    checked = back if n_back else own
    logits = np.stack([rows[i][2] @ every[rows[i][1]] + bias for i in checked])
    truth = np.array([rows[i][0] for i in checked])
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    # smoothed truths, (n + 1) / (n + 2) after Platt: without them, texts that are all told apart ask for no doubt at all
    wrong = 1 / (len(truth) + 2)
    aims = np.full(logits.shape, wrong / max(1, k - 1))
    aims[np.arange(len(truth)), truth] = 1 - wrong if k > 1 else 1
    loss = [-(aims * np.log(softmax(logits / t) + 1e-300)).sum(axis=1).mean() for t in grid]
    return Model(labels, idf.astype(np.float32), every[:-1].astype(np.float32), bias, float(grid[int(np.argmin(loss))]))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id's text, modulo 4, is 2; a null id's is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to rows (bucket, n): texts that have the bucket; bucket -1 has all texts."""
    total, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            total += counts(text.as_py()) > 0
            n += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], ["bucket", "n"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = [], []
        for text in batch.column("text"):
            row = counts(text.as_py())
            at.append(np.flatnonzero(row).astype("<u2"))
            n.append(row[at[-1]].astype("<u4"))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("key"), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([x.tobytes() for x in n], pa.binary())], ["lang", "key", "at", "n"])


def _first(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of each language. A task keeps n, a part of the tasks keeps n, and so no task meets more than n of each of these."""
    out = rows.withColumn("part", F.spark_partition_id() % SALTS)
    for groups in (("lang", "part"), ("lang",)):
        window = Window.partitionBy(*groups).orderBy(*order)
        out = out.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n).drop("place")
    return out.drop("part")


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 42) -> Model | None:
    """A model from the documents that are not held out and have a language, an id and a letter; None without any.

    Document frequencies are over all of these; weights and temperature are fitted on those ``sample`` of each
    language with the smallest hashes of their ids. The ``LANGUAGES`` of the most documents are learned, which bounds what
    the driver fits on.
    """
    bounded_batches(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    found = usable.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = {r["bucket"]: r["n"] for r in found}
    total = seen.pop(-1, 0)
    if not total:
        return None
    df = np.zeros(BUCKETS)
    df[list(seen)] = list(seen.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    common = cut(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang"))
    usable = usable.join(F.broadcast(common), "lang", "left_semi")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    # ids first, so that the texts of no others are moved; rows that repeat an id are limited once more
    ids = _first(usable.select("lang", "doc_id", key.alias("key")), sample, "key", "doc_id").select("doc_id", "lang").distinct()
    ids = cut(ids)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = usable.select("doc_id", "lang", "text", key.alias("key")).join(ids, ["doc_id", "lang"], "left_semi")
    texts = _first(texts.withColumn("order", F.xxhash64("text")), sample, "key", "doc_id", "order")
    rows = texts.select("lang", "key", "text").mapInArrow(counted, "lang string, key long, at binary, n binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["key"], r["at"], r["n"]))
    return train([(r["lang"], np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4").astype(float)) for r in rows], idf, seed=seed)


def predicted(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """struct(lang_pred, score) of each whole text; ``und`` and 0 for null, for no letter, and without a model."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        model = held.value
        out = [model.predict(x.as_py()) if x.is_valid and model else (UNKNOWN, 0.0) for x in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["lang_pred", "score"])

    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return predict(F.when(has_letter, F.col(text)))


def languages(docs: DataFrame, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the calibrated probability), one row for each row of docs.

    Learns from text and lang of documents that are not held out; predicts from the text alone. Texts that are
    null or have no letter are ``und`` with score 0, as is every text where there is nothing to learn from. A null
    doc_id is not held out and is not learned from. Repeated rows get equal results.
    """
    model = fit(docs.select("doc_id", "text", "lang"), sample, seed)
    rows = docs.select("doc_id", "text")
    made = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(rows, model).alias("p"))
    return made.select("doc_id", "held_out", "p.*")


def identified(docs: DataFrame, least: float = 0.5, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """docs without those that have no language: ``und``, or a score below ``least``.

    What is learned, and what holds for nulls, ids and repeated rows, is as in ``languages``: null and empty texts and those
    without a letter go, and all go where there is nothing to learn from. Texts of any length are read whole. An empty
    table stays empty. Other columns are kept, whatever their names.
    """
    model = fit(docs.select("doc_id", "text", "lang"), sample, seed)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    made = rows.select("row", predicted(rows, model).alias("p"))
    return made.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least)).select("row.*")
