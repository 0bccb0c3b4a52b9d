from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, row string, `Digest` string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like those of the operators."""
    long = " ".join(f"wort{i % 977} thing{i % 1009}" for i in range(30_000))
    passage = "x".join(f"{i:05d}" for i in range(90))
    texts = [None, "", "   \t\n", "one", "one two three", "Él Año İstanbul Σσς 日本語 12 ½ don't", long, long, long + " end", "a" * 2000, f"before {passage} after", f"other words {passage} and more", "12 34 !!", "the same text of some words", "the same text of some words"]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "b", "a", "é", "z"][i % 5], None if t is None else len(t), "f", "r", "d") for i, t in enumerate(texts)]
    rows += [(None, "the words of a document without an id", None, None, None, None, None, None), rows[4], rows[4], (3, "another text of the same id", "en", "a", 3, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
