"""Text analysis: tokenizers, and predicates over arrays of tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = r"\s+"


def folded_tokens() -> Callable:
    """White-space tokens in compatibility form, lower-cased, without diacritics: exact for all of Unicode."""

    @F.arrow_udf("array<string>")
    def tokens(text: pa.Array) -> pa.Array:
        out = []
        for x in text.to_pylist():
            flat = unicodedata.normalize("NFKD", x or "").lower()
            out.append("".join(c for c in flat if not unicodedata.category(c).startswith("M")).split() if x is not None else None)
        return pa.array(out, pa.list_(pa.string()))

    return tokens


def tokens(text: Column) -> Column:
    """White-space tokens, lower-cased, in the JVM; folded_tokens also drops diacritics."""
    return F.filter(F.split(F.lower(text), TOKENS), lambda t: t != "")


def word_tokens(text: Column, longest: int = 30) -> Column:
    """Runs of letters and digits and single CJK characters, lower-cased, no longer than a bound."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) <= longest)


def email_tokens(text: Column, synonyms: dict[str, Sequence[str]] | None = None) -> Column:
    """Addresses stay whole, other words are as in word_tokens; each word is followed by its synonyms."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}{2,}|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{N}]+"), F.lit(0))
    if not synonyms:
        return found
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in [k, *v]]))])
    return F.flatten(F.transform(found, lambda t: F.coalesce(F.try_element_at(table, t), F.array(t))))


def contains(words: Column, word: str) -> Column:
    return F.array_contains(words, word.lower())


def contains_all(words: Column, wanted: Sequence[str], within: int | None = None) -> Column:
    """All words; with ``within``, at places of which the first and last are at most so far apart."""
    every = F.array(*[F.lit(w.lower()) for w in dict.fromkeys(wanted)])
    present = F.size(F.array_except(every, words)) == 0
    if within is None:
        return present
    placed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(every, x["w"]))

    def near(found: Column) -> Column:
        """Whether a stretch that starts at one of the places has all words."""
        return F.exists(found, lambda x: F.size(F.array_except(every, F.transform(F.filter(found, lambda y: y["i"].between(x["i"], x["i"] + within)), lambda y: y["w"]))) == 0)

    return present & bound(placed, near)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where body has it in a lambda, which runs for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(words: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w.lower()) for w in wanted]))


def contains_prefix(words: Column, prefix: str) -> Column:
    return F.exists(words, lambda w: w.startswith(prefix.lower()))


def contains_all_prefixes(words: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [contains_prefix(words, p) for p in prefixes])


def contains_any_prefix(words: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [contains_prefix(words, p) for p in prefixes])


def contains_phrase(words: Column, phrase: Sequence[str]) -> Column:
    """The words one after the other; tokens hold no blanks, so the joined tokens hold the joined phrase."""
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.contains(joined, F.lit(" " + " ".join(w.lower() for w in phrase) + " "))


def highlight(text: Column, wanted: Sequence[str], before: str = "<b>", after: str = "</b>") -> Column:
    """The text with each whole word among the wanted ones marked, whatever its case."""
    words = "|".join(r"\Q" + w + r"\E" for w in wanted)
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])({words})(?![\p{{L}}\p{{N}}])", f"{before}$1{after}")
