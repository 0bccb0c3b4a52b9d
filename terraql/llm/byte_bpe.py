"""Byte-level BPE by corpus-level merge replay, and its decoding.

The distinct pre-tokens of a batch form one corpus of symbols, linked to their neighbours. An inverted
index has, for each rank, the places where a pair of that rank starts. Ranks are taken in rising order; each
is merged at all its places at once, and only the pairs with the neighbours touched enter the index anew.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraql.llm.shared import bounded_batches
from terraql.llm.split import Splitter
from terraql.llm.token_counts import NO_PAIR, PairTable

#: Distinct pre-tokens a worker remembers; new ones of a merge replay; pre-tokens held before one; ids written or read at a time.
REMEMBERED, NEW, HELD, AT_ONCE = 250_000, 50_000, 500_000, 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of an array behind each other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    """Encodes text to ids by ranks, each match of the pattern separately, and decodes ids to bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.words = Splitter(pattern)
        known = sorted((rank, token) for token, rank in self.ranks.items())
        self.sizes = np.zeros(known[-1][0] + 1, np.int64)
        self.sizes[[rank for rank, _ in known]] = [len(token) for _, token in known]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(token for _, token in known), np.uint8)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, made = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        self.table = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(made, np.int32), np.array(made, np.int32))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.new: list[str] = []
        self.ids, self.lengths, self.places = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def one(self, word: bytes) -> list[int]:
        """Lowest rank first, from the left: what the replay has to give, for one pre-token. A heap holds the pairs, so a long one takes n log n."""
        n = len(word)
        after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))  # of the part that starts at a place
        heap: list[tuple[int, int, int, int]] = []

        def enter(i: int) -> None:
            if i >= 0 and (j := after[i]) < n:
                rank = self.ranks.get(word[i : stop[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, stop[i], stop[j]))

        for i in range(n):
            enter(i)
        while heap:
            _, i, middle, end = heapq.heappop(heap)
            if stop[i] != middle or middle >= n or stop[middle] != end:
                continue  # one of the two is part of another by now
            stop[i], after[i], stop[middle] = end, after[middle], 0
            if after[i] < n:
                before[after[i]] = i
            enter(before[i])
            enter(i)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : stop[i]]])
            i = after[i]
        return out

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words behind each other, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = len(raw)
        sym = np.append(self.bytes[raw], np.int32(-1))
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        word = np.append(word, np.int32(-1))
        after = np.append(np.arange(1, size + 1), size)
        before = np.arange(-1, size)  # both have a last place that ends every word
        alive = np.ones(size + 1, bool)
        odd = np.zeros(len(words), bool)  # words where a merge makes a pair of a lower rank
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.concatenate(([0], np.flatnonzero(rank[1:] != rank[:-1]) + 1, [len(rank)])).tolist()
            firsts = rank[cuts[:-1]].tolist() if len(rank) else []
            for k, r in enumerate(firsts):
                if r not in index:
                    heapq.heappush(heap, r)
                index[r].append(at[cuts[k] : cuts[k + 1]])

        rank_at = np.full(size + 1, NO_PAIR, np.int32)  # of the pair that starts at a place

        def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The places of these where a pair starts, and its rank."""
            follow = after[at]
            slot = self.table.find(sym[at], sym[follow])
            rank_at[at] = found = np.where((slot >= 0) & (word[at] == word[follow]), self.table.rank[slot], NO_PAIR)
            ok = found != NO_PAIR
            return at[ok], found[ok]

        enter(*pairs(np.arange(size)))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.sort(np.concatenate(lists))
            at = at[rank_at[at] == rank]
            if len(lists) > 1:
                at = at[np.concatenate(([True], at[1:] != at[:-1]))[: len(at)]]
            if not len(at):
                continue
            # of places that overlap, every second one from the left
            run = np.concatenate(([True], after[at[:-1]] != at[1:]))
            if not run.all():
                first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            sym[at] = rank
            alive[gone] = False
            rank_at[gone] = NO_PAIR
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            new, ranks = pairs(np.concatenate((left[left >= 0], at)))
            odd[word[new[ranks < rank]]] = True
            enter(new, ranks)
        ids, owner = sym[:-1][alive[:-1]], word[:-1][alive[:-1]]
        count = np.bincount(owner, minlength=len(words))
        if odd.any():
            parts = np.split(ids, np.cumsum(count)[:-1])
            for k in np.flatnonzero(odd).tolist():
                parts[k] = np.array(self.one(words[k]), np.int32)
                count[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, count

    def places_of(self, words: list[str]) -> np.ndarray:
        """Numbers of pre-tokens; those of new ones are given out."""
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        except KeyError:
            for w in set(words):
                if w not in self.known:
                    self.known[w] = len(self.known)
                    self.new.append(w)
            return np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))

    def learn(self) -> None:
        """Replays the merges on the new pre-tokens."""
        if self.new:
            ids, count = self.replay([w.encode() for w in self.new])
            self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, count])
            self.places = np.cumsum(self.lengths) - self.lengths
            self.new = []

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = []
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0

        def settle() -> None:
            nonlocal held
            self.learn()
            for i, numbers in waiting:
                for at in range(0, len(numbers), AT_ONCE):
                    some = numbers[at : at + AT_ONCE]
                    out[i].append(gathered(self.ids, self.places[some], self.lengths[some]).astype("<u4").tobytes())
            waiting.clear()
            held = 0
            if len(self.known) > REMEMBERED:
                self.forget()

        for i, text in enumerate(texts):
            out.append([])
            for part in self.words.pieces(text or ""):
                if part:
                    waiting.append((i, self.places_of(part)))
                    held += len(part)
                if held > HELD or len(self.new) > NEW:
                    settle()
        settle()
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> bytes:
        every, out = np.frombuffer(ids, "<u4"), []
        for at in range(0, len(every), AT_ONCE):
            part = every[at : at + AT_ONCE]
            out.append(gathered(self.flat, self.starts[part], self.sizes[part]).tobytes())
        return b"".join(out)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", name: str = "token_ids") -> DataFrame:
    """docs with the ids of the text in the array column ``name``.

    ``ranks`` is the path of the vocabulary, the same on every machine. Special strings are ordinary text.
    A null text counts as empty and has no ids. Rows are encoded one by one; texts of any length whole.
    """

    bounded_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        packed = codec(ranks, pattern).encode(x.as_py() for x in texts)
        ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))

    return docs.withColumn(name, ids(F.col(text)))


def decode(docs: DataFrame, ranks: str, pattern: str, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids stand for in the binary column ``name``; null ids give no bytes."""

    bounded_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def back(lists: pa.Array) -> pa.Array:
        made = codec(ranks, pattern)
        return pa.array([made.decode(np.array(x or [], "<u4").tobytes()) for x in lists.to_pylist()], pa.binary())

    return docs.withColumn(name, back(F.col(ids)))


def round_trip(docs: DataFrame, ranks: str, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 (and token_ids if asked for) in place of columns of these names.

    The ids are those of ``encode``; they are decoded in the same pass. ids_sha256 is over the ids as
    little-endian unsigned 32-bit integers. A null or empty text has no tokens and the digests of nothing.
    """
    bounded_batches(docs.sparkSession)
    fields = "n_tokens:long,ids_sha256:string,decoded_sha256:string" + ",token_ids:array<int>" * with_ids

    @F.arrow_udf(f"struct<{fields}>")
    def both(texts: pa.Array) -> pa.Array:
        made = codec(ranks, pattern)
        packed = made.encode(x.as_py() for x in texts)
        columns = [
            pa.array([len(x) // 4 for x in packed], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
            pa.array([hashlib.sha256(made.decode(x)).hexdigest() for x in packed], pa.string()),
        ]
        if with_ids:
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
        return pa.StructArray.from_arrays(columns, [f.split(":")[0] for f in fields.split(",")])

    new = [f.split(":")[0] for f in fields.split(",")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    parts = docs.select(F.struct(*kept).alias("row"), both(F.col(text)).alias("made"))
    return parts.select("row.*", *[f"made.{c}" for c in new])
