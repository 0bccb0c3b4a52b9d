"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch lie behind each other in one ragged array of symbols. A round finds the
lowest rank among the pairs of each sequence, merges that pair at all its places in the sequence, and
drops the symbols that went. Sequences without a pair leave; the symbols that are left are counted.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraql.llm.shared import bounded_batches
from terraql.llm.split import Splitter

NO_PAIR = np.int32(2**31 - 1)
#: Distinct pre-tokens that a worker remembers, those merged at a time, and pre-tokens held before new ones are merged.
REMEMBERED, AT_ONCE, HELD = 500_000, 1 << 16, 4_000_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class PairTable:
    """Ranks and results of pairs of symbols, in an open-addressing table that arrays are looked up in."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        self.bits = max(4, int(len(left) * 4).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NO_PAIR, np.int32)
        self.made = np.zeros(1 << self.bits, np.int32)
        key = (left.astype(np.int64) << 32) | right
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            at = slot[todo]
            free = self.key[at] == -1
            first = np.unique(at[free], return_index=True)[1]
            placed = todo[free][first]
            self.key[slot[placed]], self.rank[slot[placed]], self.made[slot[placed]] = key[placed], rank[placed], made[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.slots = np.flatnonzero(self.key != -1)
        self.slots = self.slots[np.argsort(self.key[self.slots])]
        self.sorted = self.key[self.slots]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 where there is none."""
        key = (left.astype(np.int64) << 32) | right
        if len(key) < 2000:  # one call instead of many, which cost more here
            at = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
            return np.where(self.sorted[at] == key, self.slots[at], -1)
        slot = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            got = self.key[slot[todo]]
            hit = got == key[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (got != -1)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


def merge_counts(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> np.ndarray:
    """How many symbols are left of each sequence when all merges are done."""
    out = lengths.copy()
    live = np.flatnonzero(lengths > 1)
    sym = symbols[np.repeat(lengths > 1, lengths)]
    n = lengths[live]
    seq = np.repeat(np.arange(len(live)), n)

    def ranks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that start at these places."""
        ok = at < len(sym) - 1
        ok[ok] = seq[at[ok]] == seq[at[ok] + 1]
        r, m = np.full(len(at), NO_PAIR, np.int32), np.zeros(len(at), np.int32)
        slot = table.find(sym[at[ok]], sym[at[ok] + 1])
        r[ok], m[ok] = np.where(slot >= 0, table.rank[slot], NO_PAIR), np.where(slot >= 0, table.made[slot], 0)
        return r, m

    rank, made = ranks(np.arange(len(sym)))
    while len(live):
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        lowest = np.minimum.reduceat(rank, starts)
        done = lowest == NO_PAIR
        if done.any():
            out[live[done]] = n[done]
            keep = np.repeat(~done, n)
            sym, rank, made = sym[keep], rank[keep], made[keep]
            live, n, lowest = live[~done], n[~done], lowest[~done]
            seq = np.repeat(np.arange(len(live)), n)
            if not len(live):
                break
        at = np.flatnonzero(rank == lowest[seq])
        # of places that overlap (a run of one symbol), every second one, from the left
        run = np.concatenate(([True], at[1:] != at[:-1] + 1))
        first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        n = n - np.bincount(seq[at], minlength=len(n))
        sym, rank, made, seq = sym[keep], rank[keep], made[keep], seq[keep]
        new = moved[at]
        before = new[new > 0] - 1
        touched = np.concatenate((before, new))
        rank[touched], made[touched] = ranks(touched)
    return out


class WordCounter:
    """Counts tokens as the library does for a vocabulary file with word ends, byte symbols and a split pattern."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE vocabulary over bytes is needed")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in merges], np.int64).reshape(-1, 3)
        self.table = PairTable(ids[:, 0], ids[:, 1], np.arange(len(ids), dtype=np.int32), ids[:, 2])
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + end] for s in symbols], np.int32)
        library = Tokenizer.from_file(path)
        self.library = library.normalizer.normalize_str if library.normalizer else str
        listed = (spec["normalizer"] or {}).get("normalizers", [])
        self.plain = [n["type"] for n in listed] == ["NFC", "Replace", "Lowercase"] and listed[1]["pattern"] == {"Regex": "\\s+"}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        split = next(s for s in steps if s["type"] == "Split")
        if not (split["behavior"] == "Removed" and split["invert"]):
            raise ValueError("the split has to keep its matches only")
        self.words = Splitter(split["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.new: list[str] = []
        self.sizes = np.zeros(0, np.int64)

    def normalize(self, text: str) -> str:
        """As the library does, but for white space, which the split drops anyway."""
        if not self.plain or not self.words.settled(text):
            return self.library(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # the library knows no final sigma
        return text.lower()

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens, some at a time."""
        return self.words.pieces(self.normalize(text))

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
        """Counts the tokens of the new pre-tokens."""
        counted = [self.sizes]
        for at in range(0, len(self.new), AT_ONCE):
            part = [w.encode() for w in self.new[at : at + AT_ONCE]]
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            raw = np.frombuffer(b"".join(part), np.uint8)
            symbols = self.inner[raw]
            ends = np.cumsum(lengths) - 1
            symbols[ends] = self.last[raw[ends]]
            counted.append(merge_counts(symbols, lengths, self.table))
        self.sizes, self.new = np.concatenate(counted), []

    def count(self, texts: Iterable[str | None]) -> list[int]:
        totals: list[int] = []
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0

        def settle() -> None:
            nonlocal held
            self.learn()
            for i, numbers in waiting:
                totals[i] += int(self.sizes[numbers].sum())
            waiting.clear()
            held = 0
            if len(self.known) > REMEMBERED:
                self.forget()

        for i, text in enumerate(texts):
            totals.append(0)
            if not text:
                continue
            parts = self.special.split(text) if self.special else [text]
            totals[i] += len(parts) - 1  # a special string is one token, and cuts the text before anything else
            for part in parts:
                for words in self.pieces(part) if part else ():
                    if words:
                        waiting.append((i, self.places_of(words)))
                        held += len(words)
                    if held > HELD or len(self.new) > 4 * AT_ONCE:
                        settle()
        settle()
        return totals


_counters: dict[str, WordCounter] = {}


def counter(path: str) -> WordCounter:
    """One for each vocabulary and worker."""
    if path not in _counters:
        _counters[path] = WordCounter(path)
    return _counters[path]


def count_udf(path: str) -> Callable:
    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        return pa.array(counter(path).count(x.as_py() for x in text), pa.int64())

    return count


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) in place of columns of these names.

    ``vocabulary`` is the path of the vocabulary file, the same on every machine. A null text counts as
    empty: 0 bytes, 0 tokens. Rows are counted one by one, so repeated rows repeat. Texts of any length are
    read whole, in pieces of bounded memory.
    """
    bounded_batches(docs.sparkSession)
    new = ("n_bytes", "n_tokens", "over_limit")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    parts = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), count_udf(vocabulary)(F.col(text)).alias("n_tokens"))
    return parts.select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
