"""URL filters: a bit-parallel wildcard automaton (multiword Shift-And) over canonical URLs.

Every glob is packed into one row of bits: a start bit and one bit for each literal byte. A step
shifts all bits by one place, keeps those whose literal is the byte just read, and adds the bits
that a wildcard holds in place. All URLs of a batch take each step together.

Globs: ``*`` is any run of bytes other than ``/``, ``**`` any run, ``?`` one byte other than ``/``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLASH = ord("/")


@dataclass(frozen=True)
class Rule:
    """``host/path`` for a host with its subdomains and the paths that start so, or a glob over the canonical URL."""

    pattern: str
    verdict: str
    is_glob: bool = False

    @property
    def glob(self) -> str:
        return self.pattern if self.is_glob else f"*.{self.pattern}**"


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where the url is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class Automaton:
    def __init__(self, globs: list[str]) -> None:
        steps: list[tuple[int, bytes | None]] = []  # for each bit: what it reads (None: a start bit; b"": one of any but a slash)
        holds: list[tuple[int, bool]] = []  # bit, whether its wildcard also reads slashes
        starts, ends = [], []
        for glob in globs:
            starts.append(len(steps))
            steps.append((len(steps), None))
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    run = i
                    while raw[i : i + 1] == b"*":
                        i += 1
                    holds.append((len(steps) - 1, i - run > 1))
                    continue
                steps.append((len(steps), b"" if raw[i : i + 1] == b"?" else raw[i : i + 1]))
                i += 1
            ends.append(len(steps) - 1)
        self.words = len(steps) // 64 + 1
        self.reads, self.stays = (np.zeros((256, self.words), np.uint64) for _ in range(2))
        for bit, what in steps:
            if what is not None:
                for c in range(256) if what == b"" else [what[0]]:
                    if what or c != SLASH:
                        self._set(self.reads[c], bit)
        for bit, slashes in holds:
            for c in range(256):
                if slashes or c != SLASH:
                    self._set(self.stays[c], bit)
        self.first = np.zeros(self.words, np.uint64)
        for bit in starts:
            self._set(self.first, bit)
        self.ends = ends

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """For each text and glob, whether the glob fits the whole text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        sizes, n = lengths[order], len(texts)
        data = np.frombuffer(b"".join(texts[i] for i in order) or b"\0", np.uint8)
        offsets = np.concatenate(([0], np.cumsum(sizes)[:-1])) if n else np.zeros(0, np.int64)
        state = np.repeat(self.first[None, :], n, axis=0)
        alive = n
        for step in range(int(sizes[0]) if n else 0):
            while alive and sizes[alive - 1] <= step:
                alive -= 1
            c = data[offsets[:alive] + step]
            now = state[:alive]
            moved = now << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:alive] = (moved & self.reads[c]) | (now & self.stays[c])
        found = np.zeros((n, len(self.ends)), bool)
        for k, bit in enumerate(self.ends):
            found[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return found


def judge(pages: DataFrame, rules: list[Rule], fallback: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict, in this order after its own columns of other names.

    Of the rules that fit, the longest pattern wins (ties: the first given), and ``rule`` holds it.
    Where none fits, ``rule`` is null, and the verdict is that of the first glob of ``fallback`` that
    fits, else ``default``. Rules read the host with a leading dot, followed by the path; a null url, one
    without ``://`` and an empty one have an empty host and path, so get ``default`` unless a glob fits
    a lone dot. Rows are judged one by one: repeated rows give repeated results.
    """
    ranked = sorted(rules, key=lambda r: -len(r.pattern))
    known = [*ranked, *fallback]

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def verdicts(canon: pa.Array) -> pa.Array:
        texts = [x.encode() for x in canon.to_pylist()]
        fits = automaton().matches(texts) if known else np.zeros((len(texts), 0), bool)
        first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if known else np.full(len(texts), -1)
        rule = [known[k].pattern if 0 <= k < len(ranked) else None for k in first]
        verdict = [known[k].verdict if k >= 0 else default for k in first]
        return pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["rule", "verdict"])

    made: list[Automaton] = []

    def automaton() -> Automaton:
        if not made:
            made.append(Automaton([r.glob for r in known]))
        return made[0]

    host, path = canonical(F.col(url))
    new = ("host", "path", "rule", "verdict")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in new]
    parts = pages.select(F.struct(*kept).alias("row"), host.alias("host"), path.alias("path"))
    judged = parts.withColumn("v", verdicts(F.concat(F.lit("."), F.col("host"), F.col("path"))))
    return judged.select("row.*", "host", "path", "v.rule", "v.verdict")
