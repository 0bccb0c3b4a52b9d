"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from terraql.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con(data):
    made = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        made.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return made


def told(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, con, name):
    got = QUERIES[name](spark, data)
    rows = [tuple(r) for r in got.collect()]
    if name in SQL:
        want = con.sql(SQL[name])
        assert told(rows, got.columns) == told(want.fetchall(), want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
