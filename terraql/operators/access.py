"""Direct access to a table by its primary key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys in a list that may become a filter; longer lists are joined.
LISTED = 200


@dataclass(frozen=True)
class Table:
    """Rows with a primary key, which may be nested fields by dotted name."""

    rows: DataFrame
    key: tuple[str, ...]

    def scan(self, low: Mapping[str, object] | None = None, high: Mapping[str, object] | None = None, reverse: bool = False, ordered: bool = False) -> DataFrame:
        """Rows of an inclusive range of keys, filters that reach the scan; in key order only if asked for."""
        out = self.rows
        for name, value in (low or {}).items():
            out = out.where(F.col(name) >= F.lit(value))
        for name, value in (high or {}).items():
            out = out.where(F.col(name) <= F.lit(value))
        if not ordered:
            return out
        return out.orderBy(*[F.col(k).desc_nulls_last() if reverse else F.col(k).asc_nulls_first() for k in self.key])

    def prefix(self, *values: object) -> Column:
        """The filter for keys that begin so."""
        out = F.lit(True)
        for name, value in zip(self.key, values, strict=False):
            out = out & (F.col(name) == F.lit(value))
        return out

    def get(self, *values: object) -> DataFrame:
        return self.rows.where(self.prefix(*values)).limit(1)

    def load(self, keys: Sequence[tuple]) -> DataFrame:
        """Rows whose key is in a list: a filter if the list is short, else a semi join."""
        if len(self.key) == 1 and len(keys) <= LISTED:
            return self.rows.where(F.col(self.key[0]).isin([k[0] for k in keys]))
        wanted = self.rows.sparkSession.createDataFrame(list(keys), self.rows.select(*self.key).schema)
        return self.rows.join(wanted, [c for c in self.key], "left_semi")

    def delete_range(self, *values: object) -> "Table":
        return Table(self.rows.where(~F.coalesce(self.prefix(*values), F.lit(False))), self.key)


def page(df: DataFrame, key: Sequence[str], size: int, after: Sequence[object] | None = None) -> DataFrame:
    """The next rows in key order after a token, the key of the last row seen; keys are unique and not null.

    Paging by key reads no earlier page again, unlike an offset: the comparison goes down to the scan.
    """
    out = df
    if after is not None:
        beyond = F.lit(False)
        for i in range(len(key)):
            same = F.lit(True)
            for k, v in zip(key[:i], after[:i], strict=True):
                same = same & (F.col(k) == F.lit(v))
            beyond = beyond | (same & (F.col(key[i]) > F.lit(after[i])))
        # implied by the rest, and simple enough to be pushed down
        out = out.where((F.col(key[0]) >= F.lit(after[0])) & beyond)
    return out.orderBy(*key).limit(size)
