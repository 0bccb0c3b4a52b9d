"""Changes of tables by copy-on-write: each returns the new rows and what a RETURNING clause shows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraql.errors import UNDEFINED_COLUMN, UNIQUE_VIOLATION, EngineError
from terraql.sources.tables import kept


def coerced(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Rows with the columns and types of a table; columns they lack are null, others are an error."""
    extra = [c for c in rows.columns if c not in like.columns]
    if extra:
        raise EngineError(UNDEFINED_COLUMN, f"the table has no column {extra[0]}")
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def insert(table: DataFrame, rows: DataFrame, key: Sequence[str] = (), check: bool = True) -> tuple[DataFrame, DataFrame]:
    """The table with rows added; a key that is there already, or twice among the rows, is an error."""
    new = coerced(rows, table)
    if key and check:
        new = kept(new)  # what is checked is what is added, also where the source would give other rows the next time
        twice = new.groupBy(*key).count().where("count > 1").select(*key)
        taken = new.select(*key).join(table.select(*key), list(key), "left_semi")
        found = twice.unionByName(taken).limit(1).collect()
        if found:
            raise EngineError(UNIQUE_VIOLATION, f"there is a row with the key {tuple(found[0])}")
    return table.unionByName(new), new


def update(table: DataFrame, changes: Mapping[str, Column], where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Changed rows are those where the predicate is true, not null; RETURNING has their new values, and old ones as ``old``."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    unknown = [c for c in changes if c not in table.columns]
    if unknown:
        raise EngineError(UNDEFINED_COLUMN, f"the table has no column {unknown[0]}")
    new = [(F.when(hit, changes[f.name].cast(f.dataType)).otherwise(F.col(f.name)) if f.name in changes else F.col(f.name)).alias(f.name) for f in table.schema]
    marked = table.select(*new, hit.alias("_hit"), F.struct(*table.columns).alias("old"))
    return marked.drop("_hit", "old"), marked.where("_hit").drop("_hit")


def delete(table: DataFrame, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows where the predicate is true go; RETURNING has them."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return table.where(~hit), table.where(hit)


class Transaction:
    """Changes of named tables that are seen outside only after a commit."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.tables, self.staged = tables, dict(tables)

    def __getitem__(self, name: str) -> DataFrame:
        return self.staged[name]

    def __setitem__(self, name: str, rows: DataFrame) -> None:
        self.staged[name] = rows

    def commit(self) -> None:
        self.tables.update(self.staged)

    def rollback(self) -> None:
        self.staged = dict(self.tables)


class Update:
    """An UPDATE in steps: set values, narrow down, run."""

    def __init__(self, table: DataFrame) -> None:
        self.table, self.changes, self.where_ = table, {}, None

    def set(self, name: str, value: Column | object) -> "Update":
        self.changes[name] = value if isinstance(value, Column) else F.lit(value)
        return self

    def where(self, condition: Column) -> "Update":
        self.where_ = condition if self.where_ is None else self.where_ & condition
        return self

    def run(self, dry: bool = False) -> tuple[DataFrame, DataFrame]:
        """The new table and the changed rows; a dry run leaves the table as it is."""
        new, changed = update(self.table, self.changes, self.where_)
        return (self.table if dry else new), changed
