"""Scalar expressions whose results differ from Spark's functions of the same name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraql.errors import BAD_ESCAPE_CHARACTER, BAD_ESCAPE_SEQUENCE, INVALID_RANGE, WRONG_OBJECT_TYPE, EngineError

INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def any_null(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns])


def greatest(*columns: Column) -> Column:
    """The largest argument; NULL if any is NULL."""
    return F.when(~any_null(columns), F.greatest(*columns))


def least(*columns: Column) -> Column:
    """The smallest argument; NULL if any is NULL."""
    return F.when(~any_null(columns), F.least(*columns))


def divide(left: str, right: str, left_type: str, right_type: str) -> Column:
    """A quotient of two columns: cut toward zero where both types are integral."""
    return int_divide(left, right) if {left_type, right_type} <= INTEGRAL else F.col(left) / F.col(right)


def int_divide(left: str, right: str) -> Column:
    """``left div right`` of two SQL expressions."""
    return F.expr(f"({left}) div ({right})")


def to_integer(value: Column, kind: str = "int") -> Column:
    """CAST of a floating number: rounded half up, an error beyond the range."""
    part = F.pmod(value.cast("double"), F.lit(1.0))  # exact, unlike a sum with a half
    return (value - part + F.when(part >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))).cast(kind)


def subscript(array: Column, place: Column | int) -> Column:
    """The element at a place counted from 1; NULL outside the array, of a NULL array, and for places below 1."""
    at = F.lit(place) if isinstance(place, int) else place
    return F.when(at >= 1, F.get(array, (at - 1).cast("int")))


def cardinality(array: Column) -> Column:
    """Elements of an array: NULL for NULL, 0 for an empty one."""
    return F.when(array.isNotNull(), F.size(array))


def first_or_default(array: Column, default: Column) -> Column:
    return F.coalesce(F.get(array, 0), default)


def pick(place: Column, *choices: Column) -> Column:
    """The choice at a place counted from 0; NULL if there is none."""
    out = F.lit(None)
    for i, choice in reversed(list(enumerate(choices))):
        out = F.when(place == i, choice).otherwise(out)
    return out


def condition_selector(*conditions: Column) -> Column:
    """The place of the first condition that is true, from 0; NULL if none is."""
    out = F.lit(None).cast("int")
    for i, condition in reversed(list(enumerate(conditions))):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(i)).otherwise(out)
    return out


def xor(left: Column, right: Column) -> Column:
    """Exclusive or of booleans; NULL if either is NULL."""
    return left != right


def is_true(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def is_false(value: Column) -> Column:
    return F.coalesce(~value, F.lit(False))


def distinct_from(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)


def like(value: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE without an escape character unless one is named; the whole value has to match."""
    if escape is not None and len(escape) != 1:
        raise EngineError(BAD_ESCAPE_CHARACTER, f"an escape is one character, not {escape!r}")
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape is not None and c == escape:
            i += 1
            if i == len(pattern) or pattern[i] not in ("%", "_", escape):
                raise EngineError(BAD_ESCAPE_SEQUENCE, f"the escape in {pattern!r} stands before no wildcard")
            out.append(r"\Q" + pattern[i] + r"\E")
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        else:
            out.append("\\\\" if c == "\\" else r"\Q" + c + r"\E")
        i += 1
    return value.rlike("(?s)^" + "".join(out) + "$(?!\n)")


def in_list(value: Column, items: Sequence[object]) -> Column:
    """IN over constants; a NULL among them is an error."""
    if any(x is None for x in items):
        raise EngineError(WRONG_OBJECT_TYPE, "NULL is not allowed in an IN list")
    return value.isin(list(items))


def type_is(schema: T.StructType, column: str, kind: str) -> Column:
    """Whether a column has a type, as a constant."""
    return F.lit(schema[column].dataType.simpleString() == kind)


def enum_ordinal(value: Column, names: Sequence[str]) -> Column:
    """Place in the declaration of an enumeration, which orders its values; NULL for names outside it."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.when(place > 0, place - 1)


def half(value: Column) -> Column:
    """A number at the precision of a 16-bit float, as a float: 11 significant bits, steps of 2**-24 near zero."""
    x = value.cast("double")
    size = F.abs(x)
    exponent = F.greatest(F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0)))), F.lit(-14))
    step = F.pow(F.lit(2.0), exponent - 10)
    rounded = F.rint(x / step) * step
    return F.when(F.abs(rounded) > 65504, F.signum(x) * F.lit(float("inf"))).otherwise(rounded).cast("float")


def of_type(value: Column, kind: str) -> Column:
    """Whether a value of varying type (VARIANT) is of one now; NULL for NULL."""
    return F.schema_of_variant(value) == F.lit(kind.upper())


def map_matches(entries: Column, key: Callable[[Column], Column] | None = None, value: Callable[[Column], Column] | None = None, names: tuple[str, str] = ("key", "value")) -> Column:
    """Whether an entry's key and value meet both conditions; entries are an array of structs with two named fields, a map's by F.map_entries.

    A condition that is left out holds for all; at least one has to be there.
    """
    tests = [(test, name) for test, name in ((key, names[0]), (value, names[1])) if test is not None]
    if not tests:
        raise EngineError(INVALID_RANGE, "a key or a value has to be matched")
    return F.exists(entries, lambda e: reduce(lambda a, b: a & b, [F.coalesce(test(e[name]), F.lit(False)) for test, name in tests]))


def throws(message: str) -> Column:
    """An error as soon as it is evaluated."""
    return F.raise_error(F.lit(message))


#: Strengths of comparison: base letters, accents too, case too.
STRENGTHS = {1: "_CI_AI", 2: "_CI", 3: ""}


def collated(value: Column, locale: str | None = None, strength: int = 3) -> Column:
    """A string that is compared, grouped and sorted by a locale's rules, of the root's without a locale."""
    return F.collate(value, f"{locale or 'UNICODE'}{STRENGTHS[strength]}")


def bytes_start(value: Column, prefix: bytes) -> Column:
    """Whether bytes begin so."""
    return F.substring(value, 1, len(prefix)) == F.lit(prefix)
