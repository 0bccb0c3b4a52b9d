"""Splits text by a tokenizer's pattern, with the Unicode 16.0 tables that the tokenizer libraries use."""

from __future__ import annotations

import re
from collections.abc import Iterator

import regex

#: Letters and numbers assigned after Unicode 16.0, first and last code point of each run.
NEWER_LETTERS = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1
ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11df1-11df1 16ea0-16eb8 16ebb-16ed3
16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6
1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff
2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
NEWER_NUMBERS = "11de0-11de9 1246f-1246f 12475-1247f 12550-12686 16ff4-16ff6"
#: Below this code point the tables of all versions agree.
SETTLED = 0x558
#: Characters of a text that are cut at a time, matches that are handed on at a time.
PIECE = 1 << 20


def ranges(text: str) -> str:
    return "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in (r.split("-") for r in text.split()))


def members(kind: str) -> str:
    """The code points below SETTLED that the class has, as ranges for a set."""
    found = [c for c in range(SETTLED) if regex.fullmatch(kind, chr(c))]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


def rewritten(pattern: str, sets: dict[str, str], outside: dict[str, str]) -> str:
    """The pattern with class escapes replaced, by ``sets`` inside a set and by ``outside`` elsewhere."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        found = re.compile(r"\\p\{[A-Z]\}|\\.").match(pattern, at)
        piece = found[0] if found else pattern[at]
        if piece in ("[", "]"):
            inside = piece == "["
        out.append((sets if inside else outside).get(piece, piece))
        at += len(piece)
    return "".join(out)


class Splitter:
    """All matches of a pattern over the classes letter, number and white space."""

    def __init__(self, pattern: str) -> None:
        low = {k: members(k) for k in (r"\p{L}", r"\p{N}", r"\s")}
        self.beyond = re.compile(f"[^\\x00-\\u{SETTLED - 1:04x}]")
        self.low = re.compile(rewritten(pattern, low, {k: f"[{v}]" for k, v in low.items()} | {r"\S": f"[^{low[r'\s']}]"}))
        self.newer = regex.compile(f"[{ranges(NEWER_LETTERS + NEWER_NUMBERS)}]")
        self.all = regex.compile(pattern)
        letters, numbers = f"[\\p{{L}}--[{ranges(NEWER_LETTERS)}]]", f"[\\p{{N}}--[{ranges(NEWER_NUMBERS)}]]"
        self.older = regex.compile(rewritten(pattern, {r"\p{L}": letters, r"\p{N}": numbers}, {r"\p{L}": letters, r"\p{N}": numbers}), regex.V1)

    def settled(self, text: str) -> bool:
        return text.isascii() or not self.beyond.search(text)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """All matches in order, some at a time."""
        pattern = self.low if self.settled(text) else self.older if self.newer.search(text) else self.all
        if len(text) <= PIECE:
            yield pattern.findall(text)
            return
        held = []
        for m in pattern.finditer(text):
            held.append(m[0])
            if len(held) == PIECE // 8:
                yield held
                held = []
        yield held
