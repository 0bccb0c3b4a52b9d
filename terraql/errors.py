"""Errors that queries show, by SQLSTATE."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException


class EngineError(Exception):
    """An error with the SQLSTATE that callers test for."""

    def __init__(self, state: str, message: str) -> None:
        super().__init__(f"[{state}] {message}")
        self.state = state


UNSUPPORTED_QUERY = "0AF00"
BAD_ESCAPE_CHARACTER, BAD_ESCAPE_SEQUENCE = "22019", "22025"
UNIQUE_VIOLATION = "23505"
WRONG_OBJECT_TYPE = "42809"
DUPLICATE_COLUMN, UNDEFINED_COLUMN, UNDEFINED_FUNCTION = "42701", "42703", "42883"
GROUPING_ERROR = "42803"
UNDEFINED_SCHEMA, UNDEFINED_TABLE = "3F000", "42F01"
INVALID_RANGE = "22023"
AMBIGUOUS_COLUMN, WINDOW_MISUSE = "42702", "42F21"
UNION_ARITY, UNION_TYPES = "42F64", "42F65"
CANNOT_CONVERT, INVALID_CAST = "22000", "22F3H"
NOT_NULL_VIOLATION = "23502"

#: Spark's error conditions, or their beginnings, by the SQLSTATE that they have here; the first that fits.
CONDITIONS = (
    ("CAST_INVALID_INPUT", INVALID_CAST),
    ("CAST_OVERFLOW", INVALID_CAST),
    ("DATATYPE_MISMATCH.CAST_", INVALID_CAST),
    ("DATATYPE_MISMATCH", CANNOT_CONVERT),
    ("AMBIGUOUS_REFERENCE", AMBIGUOUS_COLUMN),
    ("AMBIGUOUS_COLUMN_OR_FIELD", AMBIGUOUS_COLUMN),
    ("COLUMN_ALREADY_EXISTS", DUPLICATE_COLUMN),
    ("UNRESOLVED_COLUMN", UNDEFINED_COLUMN),
    ("UNRESOLVED_USING_COLUMN", UNDEFINED_COLUMN),
    ("FIELD_NOT_FOUND", UNDEFINED_COLUMN),
    ("MISSING_AGGREGATION", GROUPING_ERROR),
    ("MISSING_GROUP_BY", GROUPING_ERROR),
    ("UNSUPPORTED_EXPR_FOR_WINDOW", WINDOW_MISUSE),
    ("WINDOW_FUNCTION_", WINDOW_MISUSE),
    ("MISSING_WINDOW_SPECIFICATION", WINDOW_MISUSE),
    ("_LEGACY_ERROR_TEMP_1034", WINDOW_MISUSE),
    ("NUM_COLUMNS_MISMATCH", UNION_ARITY),
    ("INCOMPATIBLE_COLUMN_TYPE", UNION_TYPES),
    ("UNRESOLVED_ROUTINE", UNDEFINED_FUNCTION),
    ("UNRESOLVABLE_TABLE_VALUED_FUNCTION", UNDEFINED_FUNCTION),
    ("TABLE_OR_VIEW_NOT_FOUND", UNDEFINED_TABLE),
    ("INVALID_ESC", BAD_ESCAPE_SEQUENCE),
    ("INVALID_FORMAT.ESC_", BAD_ESCAPE_SEQUENCE),
    ("PARSE_SYNTAX_ERROR", "42601"),
)


def state_of(error: Exception) -> str | None:
    """The SQLSTATE of an error of Spark's analysis or of a task, also where it is another error's cause."""
    if isinstance(error, EngineError):
        return error.state
    condition = (error.getCondition() or "") if isinstance(error, PySparkException) else ""
    for start, state in CONDITIONS:
        if condition.startswith(start):
            return state
    text = str(error)
    if raised := re.search(r"USER_RAISED_EXCEPTION\] \[(\w{5})\]", text):
        return raised[1]
    return next((state for start, state in CONDITIONS if f"[{start}" in text), None)


@contextmanager
def told() -> Iterator[None]:
    """Spark's errors of a block as EngineErrors, where they have a state here."""
    try:
        yield
    except PySparkException as e:
        state = state_of(e)
        if state is None:
            raise
        raise EngineError(state, str(e).splitlines()[0]) from e
