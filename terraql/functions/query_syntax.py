"""Search strings as predicates: words, "phrases", "phrases with gaps"~2, prefixes*, patterns with ? and *, near~1 words,
[a TO b] and {a TO b} ranges, AND, OR, NOT, +must, -must not, groups, field:clauses and escapes by backslash.

A phrase with a gap holds where all its words stand, in any order, within as many more places than they take.
Clauses that stand next to each other are alternatives, as OR is; if some have a plus, only those have to hold. A boost (^2)
changes an order by relevance and no predicate, so it is read and left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraql.errors import EngineError
from terraql.functions import text

PIECE = re.compile(
    r"""\s*(?:(?P<mark>[()+-]|AND\b|OR\b|NOT\b|&&|\|\|)|(?P<field>\w+):|"(?P<phrase>[^"]*)"(?:~(?P<slop>\d+))?(?:\^[\d.]+)?"""
    r"""|(?P<range>[\[{]\s*\S+\s+TO\s+[^\s\]}]+\s*[\]}])(?:\^[\d.]+)?|(?P<word>(?:\\.|[^\s()"\\])+))"""
)
SAME = {"&&": "AND", "||": "OR"}


def _regex(word: str) -> str:
    """A word with ? and * as an expression over whole tokens."""
    out, i = [], 0
    while i < len(word):
        if word[i] == "\\" and i + 1 < len(word):
            i += 1
            out.append(re.escape(word[i].lower()))
        else:
            out.append({"?": ".", "*": ".*"}.get(word[i]) or re.escape(word[i].lower()))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def _word(value: str) -> Callable[[Column], Column]:
    """The predicate over a row's tokens that a word stands for."""
    value = re.sub(r"(?<!\\)\^[\d.]+$", "", value)
    plain = re.sub(r"\\(.)", r"\1", value)
    if fuzzy := re.fullmatch(r"(.*?)(?<!\\)~(\d?)", value):
        word, most = re.sub(r"\\(.)", r"\1", fuzzy[1]).lower(), int(fuzzy[2] or 2)
        return lambda words: F.exists(words, lambda w: F.levenshtein(w, F.lit(word), most) >= 0)
    if re.fullmatch(r"(?:\\.|[^\\?*])*\*", value):
        return lambda words: text.contains_prefix(words, plain[:-1])
    if re.search(r"(?<!\\)[?*]", value):
        return lambda words: F.exists(words, lambda w: w.rlike(_regex(value)))
    return lambda words: text.contains(words, plain)


def _range(value: str) -> Callable[[Column], Column]:
    low, high = re.fullmatch(r"[\[{]\s*(\S+)\s+TO\s+([^\s\]}]+)\s*[\]}]", value).groups()

    def inside(w: Column) -> Column:
        out = F.lit(True)
        if low != "*":
            out = out & (w >= low.lower() if value[0] == "[" else w > low.lower())
        if high != "*":
            out = out & (w <= high.lower() if value[-1] == "]" else w < high.lower())
        return out

    return lambda words: F.exists(words, inside)


class _Parser:
    def __init__(self, query: str, fields: Mapping[str, Column], default: tuple[str, ...]) -> None:
        self.fields, self.default = {k: text.tokens(c) for k, c in fields.items()}, default
        self.pieces: list[tuple[str, str, str]] = []
        at, query = 0, query.strip()
        while at < len(query):
            m = PIECE.match(query, at)
            if not m:
                raise EngineError("42601", f"can't read the search from {query[at:]!r}")
            kind = next(k for k in ("mark", "field", "phrase", "range", "word") if m[k] is not None)
            self.pieces.append((kind, SAME.get(m[kind], m[kind]), m["slop"] or ""))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.pieces[self.at][:2] if self.at < len(self.pieces) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.pieces[self.at - 1][:2]

    def alternatives(self, names: tuple[str, ...]) -> Column:
        must, may, never = [], [], []
        while self.peek()[0] != "end" and self.peek() != ("mark", ")"):
            if self.peek() == ("mark", "OR"):
                self.take()
                continue
            sign = self.take()[1] if self.peek() in (("mark", "+"), ("mark", "-"), ("mark", "NOT")) else ""
            clause = self.conjunction(names)
            (must if sign == "+" else never if sign else may).append(clause)
        if must:
            out = reduce(lambda a, b: a & b, must)
        elif may:
            out = reduce(lambda a, b: a | b, may)
        else:
            out = F.lit(bool(never))
        return reduce(lambda a, b: a & ~b, never, out)

    def conjunction(self, names: tuple[str, ...]) -> Column:
        out = self.clause(names)
        while self.peek() == ("mark", "AND"):
            self.take()
            negative = self.peek() in (("mark", "NOT"), ("mark", "-"))
            if negative or self.peek() == ("mark", "+"):
                self.take()
            right = self.clause(names)
            out = out & (~right if negative else right)
        return out

    def clause(self, names: tuple[str, ...]) -> Column:
        kind, value = self.take() if self.peek()[0] != "end" else ("end", "")
        slop = self.pieces[self.at - 1][2] if kind != "end" else ""
        if kind == "field":
            if value not in self.fields:
                raise EngineError("42703", f"no field {value}")
            return self.clause((value,))
        if (kind, value) == ("mark", "("):
            out = self.alternatives(names)
            if self.peek() != ("mark", ")"):
                raise EngineError("42601", "a bracket isn't closed")
            self.take()
            return out
        if kind == "phrase":
            test = (lambda words: text.contains_all(words, value.split(), within=len(value.split()) - 1 + int(slop))) if slop else (lambda words: text.contains_phrase(words, value.split()))
        elif kind == "range":
            test = _range(value)
        elif kind == "word":
            test = _word(value)
        else:
            raise EngineError("42601", f"a clause is missing before {value!r}")
        # a null field holds nothing
        return reduce(lambda a, b: a | b, [F.coalesce(test(self.fields[n]), F.lit(False)) if len(names) > 1 else test(self.fields[n]) for n in names])


def search(query: str, fields: Mapping[str, Column], default: str | None = None, every: bool = False) -> Column:
    """Whether rows match; clauses without a field are about the default one, else the first, or with ``every`` about any field."""
    names = tuple(fields) if every else (default or next(iter(fields)),)
    parser = _Parser(query, fields, names)
    out = parser.alternatives(names)
    if parser.peek()[0] != "end":
        raise EngineError("42601", "a bracket closes nothing")
    return F.coalesce(out, F.lit(False))
