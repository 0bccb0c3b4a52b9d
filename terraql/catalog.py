"""Schema templates, and databases and schemas bound to them, as tables that queries can read."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraql import dialect
from terraql.errors import CANNOT_CONVERT, NOT_NULL_VIOLATION, UNDEFINED_FUNCTION, UNDEFINED_SCHEMA, UNDEFINED_TABLE, UNIQUE_VIOLATION, EngineError


@dataclass
class TableDef:
    schema: T.StructType
    key: tuple[str, ...] = ()
    single_row: bool = False
    required: list[str] = field(default_factory=list)
    values: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def checked(self, rows: DataFrame) -> DataFrame:
        """Rows in the table's columns and types, missing ones null; a value that a definition forbids is an error when it is read.

        Nothing runs for that: NOT NULL, key columns and enumerations are expressions around the columns.
        """
        out = []
        for f in self.schema:
            value = (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType)
            if f.name in self.values:
                wrong = F.concat(F.lit(f"[{CANNOT_CONVERT}] {f.name} can't be "), value)
                value = F.when(value.isNull() | value.isin(*self.values[f.name]), value).otherwise(F.raise_error(wrong).cast(f.dataType))
            if f.name in self.required or f.name in self.key:
                value = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"[{NOT_NULL_VIOLATION}] {f.name} is null")).cast(f.dataType))
            out.append(value.alias(f.name))
        return rows.select(*out)

    def check_key(self, name: str, rows: DataFrame) -> None:
        """An error if two rows share a key, or a table of one row has more; one aggregation over the key."""
        twice = rows.groupBy(*self.key).count().where("count > 1").limit(1).collect() if self.key else []
        if twice or (self.single_row and len(rows.limit(2).collect()) > 1):
            raise EngineError(UNIQUE_VIOLATION, f"{name} has two rows with the key {tuple(twice[0])[:-1] if twice else ()}")


@dataclass
class Template:
    """A versioned set of tables, types, indexes, functions, views and stored queries."""

    name: str
    version: int = 1
    tables: dict[str, TableDef] = field(default_factory=dict)
    structs: dict[str, T.StructType] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    indexes: dict[str, tuple[str, str]] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    queries: dict[str, str] = field(default_factory=dict)
    functions: dict[str, str] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)

    def table(self, name: str, schema: str, key: tuple[str, ...] = (), single_row: bool = False, required: list[str] | None = None, values: dict[str, tuple[str, ...]] | None = None) -> "Template":
        self.tables[name] = TableDef(T._parse_datatype_string(schema), key, single_row, required or [], values or {})
        return self

    def struct(self, name: str, schema: str) -> "Template":
        self.structs[name] = T._parse_datatype_string(schema)
        return self

    def enum(self, name: str, *values: str) -> "Template":
        self.enums[name] = values
        return self

    def index(self, name: str, table: str, definition: str) -> "Template":
        """Registered only: what an index answers, Catalyst answers from the table."""
        if table not in self.tables and table not in self.views:
            raise EngineError(UNDEFINED_TABLE, f"no table {table}")
        self.indexes[name] = (table, definition)
        return self

    def view(self, name: str, sql: str) -> "Template":
        self.views[name] = sql
        return self

    def query(self, name: str, sql: str) -> "Template":
        self.queries[name] = sql
        return self

    def function(self, name: str, sql: str) -> "Template":
        self.functions[name] = sql
        return self

    def problems(self) -> list[str]:
        """What is wrong with the template."""
        out = []
        for name, table in self.tables.items():
            out += [f"{name}: no key column {k}" for k in table.key if k.split(".")[0] not in table.schema.names]
            out += [f"{name}: key column {f.name} is an array" for f in table.schema if f.name in table.key and isinstance(f.dataType, T.ArrayType)]
            if table.single_row and table.key:
                out.append(f"{name}: a table of one row has no key")
        return out

    def evolves_to(self, other: "Template") -> list[str]:
        """Why rows of this version can't be read by another: fields may be added, not retyped or dropped."""
        out = [] if other.version > self.version else ["the version doesn't rise"]
        for name, table in self.tables.items():
            if name not in other.tables:
                out.append(f"{name} is gone")
                continue
            new = {f.name: f.dataType for f in other.tables[name].schema}
            out += [f"{name}.{f.name} is gone or has another type" for f in table.schema if new.get(f.name) != f.dataType]
            if other.tables[name].key != table.key:
                out.append(f"{name} has another key")
        return out

    def to_json(self) -> str:
        tables = {n: {"schema": t.schema.jsonValue(), "key": list(t.key), "single_row": t.single_row, "required": t.required, "values": t.values} for n, t in self.tables.items()}
        return json.dumps({"name": self.name, "version": self.version, "tables": tables, "structs": {n: s.jsonValue() for n, s in self.structs.items()}, "enums": self.enums, "indexes": self.indexes, "views": self.views, "queries": self.queries, "functions": self.functions, "options": self.options})

    @classmethod
    def from_json(cls, text: str) -> "Template":
        x = json.loads(text)
        out = cls(x["name"], x["version"])
        out.tables = {n: TableDef(T.StructType.fromJson(t["schema"]), tuple(t["key"]), t["single_row"], t["required"], {k: tuple(v) for k, v in t["values"].items()}) for n, t in x["tables"].items()}
        out.structs = {n: T.StructType.fromJson(s) for n, s in x["structs"].items()}
        out.enums = {n: tuple(v) for n, v in x["enums"].items()}
        out.indexes = {n: tuple(v) for n, v in x["indexes"].items()}
        out.views, out.queries, out.functions, out.options = x["views"], x["queries"], x["functions"], x["options"]
        return out


class Catalog:
    """Databases of schemas, each bound to a template."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.templates, self.databases = spark, {}, {}

    def create_template(self, template: Template) -> None:
        if found := template.problems():
            raise ValueError("; ".join(found))
        self.templates[template.name] = template

    def create_database(self, path: str) -> None:
        self.databases.setdefault(path, {})

    def drop_database(self, path: str) -> None:
        self.databases.pop(path, None)

    def create_schema(self, database: str, name: str, template: str) -> None:
        if template not in self.templates or database not in self.databases:
            raise EngineError(UNDEFINED_SCHEMA, f"no database {database} or template {template}")
        self.databases[database][name] = template

    def drop_schema(self, database: str, name: str) -> None:
        self.databases.get(database, {}).pop(name, None)

    def drop_template(self, name: str) -> None:
        self.templates.pop(name, None)

    def template_of(self, database: str, schema: str) -> Template:
        if schema not in self.databases.get(database, {}):
            raise EngineError(UNDEFINED_SCHEMA, f"no schema {database}/{schema}")
        return self.templates[self.databases[database][schema]]

    def bind(self, database: str, schema: str, read: Callable[[str], DataFrame], check_keys: bool = False) -> None:
        """Temporary views and functions for all that the schema's template has; missing columns are null.

        A null or a value that the template forbids is an error when it is read; keys are checked now if asked for.
        """
        template = self.template_of(database, schema)
        for name, table in template.tables.items():
            rows = table.checked(read(name))
            if check_keys:
                table.check_key(name, rows)
            rows.createOrReplaceTempView(name)
        # views and functions may use each other in any order
        open_ = [(self._function, name, text) for name, text in template.functions.items()] + [(self._view, name, text) for name, text in template.views.items()]
        while open_:
            left = []
            for make, name, text in open_:
                try:
                    make(name, text)
                except (AnalysisException, EngineError) as e:
                    left.append((make, name, text))
                    fault = e
            if len(left) == len(open_):
                raise fault
            open_ = left

    def _function(self, name: str, text: str) -> None:
        self.spark.sql(text)

    def _view(self, name: str, text: str) -> None:
        dialect.sql(self.spark, text).createOrReplaceTempView(name)

    def run(self, database: str, schema: str, query: str) -> DataFrame:
        """A stored query by its name."""
        template = self.template_of(database, schema)
        if query not in template.queries:
            raise EngineError(UNDEFINED_FUNCTION, f"no stored query {query}")
        return dialect.sql(self.spark, template.queries[query])

    def system_tables(self) -> dict[str, DataFrame]:
        """databases, schemas, templates, tables, columns and indexes."""
        pairs = [(d, s, t) for d, own in self.databases.items() for s, t in own.items()]
        tables = [(t.name, n, ",".join(x.key)) for t in self.templates.values() for n, x in t.tables.items()]
        columns = [(t.name, n, i, f.name, f.dataType.simpleString(), f.nullable) for t in self.templates.values() for n, x in t.tables.items() for i, f in enumerate(x.schema)]
        indexes = [(t.name, n, on, text) for t in self.templates.values() for n, (on, text) in t.indexes.items()]
        make = self.spark.createDataFrame
        return {
            "databases": make([(d,) for d in self.databases], "database_id string"),
            "schemas": make(pairs, "database_id string, schema_name string, template_name string"),
            "templates": make([(t.name, t.version) for t in self.templates.values()], "template_name string, template_version int"),
            "tables": make(tables, "template_name string, table_name string, primary_key string"),
            "columns": make(columns, "template_name string, table_name string, ordinal int, column_name string, data_type string, nullable boolean"),
            "indexes": make(indexes, "template_name string, index_name string, table_name string, definition string"),
        }


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
