"""SQL text with record-store semantics, rewritten to Spark SQL.

Rewritten are: decimal literals (doubles) and literal suffixes, QUALIFY, array elements by place from 1, unnesting
with AT, GREATEST and LEAST (NULL if any argument is), backslashes in LIKE patterns, NULL in IN lists
(an error), named arguments, the functions in FUNCTIONS, __ROW_VERSION, the order of traversal of a recursion, and, by their
types, ``/`` of integers and CAST to integers. All else is passed on. Errors have the SQLSTATEs of errors.py.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from terraql import typed
from terraql.errors import UNSUPPORTED_QUERY, WINDOW_MISUSE, WRONG_OBJECT_TYPE, EngineError, told
from terraql.operators.history import VERSION

TOKEN = re.compile(r"""(?P<string>'(?:[^']|'')*')|(?P<name>[A-Za-z_][A-Za-z_0-9]*|"[^"]*"|`[^`]*`)|(?P<number>(?:\d+\.\d+(?:[eE][+-]?\d+)?|\d+)(?:[ilfdhILFDH]\b)?)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<space>\s+)|(?P<mark>=>|<>|!=|<=|>=|\|\||.)""", re.S)

_DOT = "aggregate(zip_with({}, {}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
#: Infinite where a vector is zero, not a number where one isn't finite.
COSINE = f"""CASE WHEN {_DOT.format("a", "a")} = 0D OR {_DOT.format("b", "b")} = 0D THEN double('Infinity')
WHEN isnan(0D * {_DOT.format("a", "a")} * {_DOT.format("b", "b")} * {_DOT.format("a", "b")}) THEN double('NaN')
ELSE 1D - {_DOT.format("a", "b")} / (sqrt({_DOT.format("a", "a")}) * sqrt({_DOT.format("b", "b")})) END"""

#: SQL functions with the bodies that calls are replaced with, by inlining.
FUNCTIONS = {
    "bitmap_bit_position": ("x BIGINT", "INT", "CAST(pmod(x, 10000) AS INT)"),
    "bitmap_bucket_offset": ("x BIGINT", "BIGINT", "x - pmod(x, 10000)"),
    "bitmap_bucket_number": ("x BIGINT", "BIGINT", "(x - pmod(x, 10000)) div 10000"),
    "dot_product_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "-aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "euclidean_square_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "euclidean_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "cosine_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", COSINE),
    "half_up": ("x DOUBLE", "DOUBLE", "x - pmod(x, 1D) + IF(pmod(x, 1D) >= 0.5D, 1D, 0D)"),
}
PREFIX = "terraql_"
#: The session's setting that get_versionstamp_incarnation() returns: how often the store was moved.
INCARNATION = "terraql.incarnation"


def tokenize(text: str) -> list[tuple[str, str]]:
    return [(m.lastgroup or "mark", m[0]) for m in TOKEN.finditer(text)]


def _close(tokens: list[tuple[str, str]], at: int) -> int:
    """The place of the bracket that closes the one at a place."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += tokens[i][1] in ("(", "[")
        depth -= tokens[i][1] in (")", "]")
        if depth == 0:
            return i
    raise EngineError("42601", "a bracket isn't closed")


def _split(tokens: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    parts, depth = [[]], 0
    for t in tokens:
        depth += t[1] in ("(", "[")
        depth -= t[1] in (")", "]")
        if t[1] == "," and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def _text(tokens: list[tuple[str, str]]) -> str:
    return "".join(t[1] for t in tokens)


def _next(tokens: list[tuple[str, str]], at: int) -> int:
    at += 1
    while at < len(tokens) and tokens[at][0] in ("space", "comment"):
        at += 1
    return at


def _number(text: str) -> str:
    digits, suffix = (text[:-1], text[-1].lower()) if text[-1].isalpha() else (text, "")
    if suffix in ("f", "h"):
        return f"CAST({digits} AS FLOAT)"
    if suffix == "d" or "." in digits:
        return digits + "D"
    if suffix == "l":
        return digits + "L"
    return digits


def rewrite(text: str) -> str:
    return _text([("mark", _rewritten(tokenize(text)))])


def _rewritten(tokens: list[tuple[str, str]]) -> str:
    out: list[str] = []
    i = 0
    while i < len(tokens):
        kind, word = tokens[i]
        low = word.lower()
        after = _next(tokens, i)
        if kind == "number":
            out.append(_number(word))
        elif kind == "string":
            out.append(word.replace("\\", "\\\\"))  # a backslash is a character like any other
        elif kind == "name" and word.strip('"`').upper() == "__ROW_VERSION":
            out.append(VERSION)
        elif kind == "name" and low == "get_versionstamp_incarnation" and after < len(tokens) and tokens[after][1] == "(":
            out.append("CAST(${" + INCARNATION + "} AS INT)")
            i = _close(tokens, after)
        elif kind == "name" and word.startswith('"'):
            out.append("`" + word[1:-1] + "`")
        elif kind == "name" and low in ("greatest", "least") and after < len(tokens) and tokens[after][1] == "(":
            end = _close(tokens, after)
            own = [_rewritten(p).strip() for p in _split(tokens[after + 1 : end])]
            out.append(f"IF({' OR '.join(f'({x}) IS NULL' for x in own)}, NULL, {low}({', '.join(own)}))")
            i = end
        elif kind == "name" and low in FUNCTIONS and after < len(tokens) and tokens[after][1] == "(":
            out.append(PREFIX + low)
        elif kind == "name" and low == "in" and after < len(tokens) and tokens[after][1] == "(":
            end = _close(tokens, after)
            own = _split(tokens[after + 1 : end])
            if any(_text(p).strip().lower() == "null" for p in own):
                raise EngineError(WRONG_OBJECT_TYPE, "NULL is not allowed in an IN list")
            out.append(word)
        elif kind == "name" and low == "like" and after < len(tokens) and tokens[after][0] == "string":
            following = _next(tokens, after)
            escaped = following < len(tokens) and tokens[following][1].lower() == "escape"
            out.append("LIKE " + (tokens[after][1].replace("\\", "\\\\") if escaped else tokens[after][1].replace("\\", "\\\\\\\\")))
            i = after
        elif word == "[" and out and re.search(r"[\w`)\]]\s*$", out[-1]) and out[-1].strip().lower() not in ("select", "in", "array"):
            end = _close(tokens, i)
            base = _operand(out)
            out.append(f"get({base}, CAST(({_rewritten(tokens[i + 1 : end])}) - 1 AS INT))")
            i = end
        elif word == "(":
            end = _close(tokens, i)
            out.append("(" + _rewritten(tokens[i + 1 : end]) + ")")
            i = end
        else:
            out.append(word)
        i += 1
    return _qualified(_unnested("".join(out)))


def _operand(out: list[str]) -> str:
    """Takes what a subscript applies to from the end of the output: a dotted name, or a bracket with its function."""
    taken = [out.pop()]
    while out and (out[-1] == "." or taken[0] == "." or (taken[0].startswith("(") and re.fullmatch(r"\w+", out[-1]))):
        taken.insert(0, out.pop())
    return "".join(taken)


def _unnested(text: str) -> str:
    """``FROM t, t.arr AS x AT p`` to a lateral view of elements and places."""
    pattern = r",\s*((?:\w+\.)+\w+)\s+(?:AS\s+)?(\w+)\s+AT\s+(\w+)"
    return re.sub(pattern, lambda m: f", LATERAL (SELECT pos + 1L AS {m[3]}, col AS {m[2]} FROM posexplode({m[1]})) AS {m[2]}_at", text, flags=re.I)


def _qualified(text: str) -> str:
    """A SELECT with QUALIFY to a query around it; the condition may name the query's columns and use window functions."""
    tokens = tokenize(text)
    depth, at, order = 0, None, None
    for i, (kind, word) in enumerate(tokens):
        depth += word == "("
        depth -= word == ")"
        if depth == 0 and kind == "name" and word.lower() == "qualify":
            at = i
        elif depth == 0 and at is not None and kind == "name" and word.lower() in ("order", "limit") and order is None:
            order = i
    if at is None:
        return text
    body, condition, rest = _text(tokens[:at]), _text(tokens[at + 1 : order]), _text(tokens[order:]) if order else ""
    first = re.search(r"\bFROM\b", body, re.I)
    if not first:
        raise EngineError("0AF00", "QUALIFY needs a FROM")
    head, tail = body[: first.start()].rstrip(), body[first.start() :]
    columns = re.sub(r"^\s*SELECT\s+", "", head, flags=re.I)
    names = ", ".join(_name(p) for p in _split(tokenize(columns)))
    return f"SELECT {names} FROM ({head}, ({condition.strip()}) AS _qualified {tail.rstrip()}) WHERE _qualified {rest}"


def _name(column: list[tuple[str, str]]) -> str:
    last = [t[1] for t in column if t[0] not in ("space", "comment")]
    return "* EXCEPT (_qualified)" if last[-1] == "*" else last[-1]


def _traversed(text: str) -> str:
    """``WITH RECURSIVE r AS (...) TRAVERSAL ORDER how SELECT ...`` to rows in that order, by paths of the rows above.

    Siblings are in the order of their columns. A query that sorts, groups or aggregates itself has its own order.
    """
    tokens = tokenize(text)
    plain = [i for i, t in enumerate(tokens) if t[0] not in ("space", "comment")]
    words = [tokens[i][1].lower() for i in plain]
    at = next((k for k in range(len(words) - 2) if words[k : k + 2] == ["traversal", "order"]), None)
    if at is None:
        return text
    how = words[at + 2]
    if how not in ("pre_order", "post_order", "level_order") or words[:2] != ["with", "recursive"]:
        raise EngineError(UNSUPPORTED_QUERY, f"no traversal {how} here")
    name = tokens[plain[2]][1]
    open_ = next(i for i in plain if tokens[i][1].lower() == "as") + 1
    while tokens[open_][1] != "(":
        open_ += 1
    stop = _close(tokens, open_)
    columns = _text(tokens[plain[2] + 1 : open_])
    listed = re.match(r"\s*\(([^()]*)\)", columns)
    body = tokens[open_ + 1 : stop]
    depth, cut = 0, None
    for i, (kind, word) in enumerate(body):
        depth += word in ("(", "[")
        depth -= word in (")", "]")
        if depth == 0 and kind == "name" and word.lower() == "union" and cut is None:
            cut = i
    if cut is None:
        raise EngineError(UNSUPPORTED_QUERY, "a recursion is a UNION ALL")
    one = _text(body[:cut])
    two = re.sub(r"^\s*UNION\s+ALL\s+", "", _text(body[cut:]), flags=re.I)
    named = [c.strip() for c in listed[1].split(",")] if listed else [_name(p) for p in _split(_until_from(tokenize(re.sub(r"^\s*SELECT\s+", "", one, flags=re.I))))]
    own = ", ".join(f"'{c.strip('`')}', {c}" for c in named)
    row = f"named_struct('_end', 0, 'row', named_struct({own}))"
    first = f"SELECT {', '.join(named)}, 0 AS _depth, array({row}) AS _path FROM (SELECT * FROM ({one}) AS _one({', '.join(named)}))"
    step, _ = _carried(two, name)
    second = f"SELECT {', '.join(named)}, _depth + 1, concat(_up, array({row})) FROM (SELECT * FROM ({step}) AS _two({', '.join(named)}, _up, _depth))"
    final = _text(tokens[plain[at + 2] + 1 :]).strip()
    shown = ", ".join(named)
    final = re.sub(r"^SELECT\s+\*", f"SELECT {shown}", final, flags=re.I)
    order = {"pre_order": "_path", "level_order": "_depth, _path", "post_order": "concat(_path, array(named_struct('_end', 1, 'row', _path[0].row)))"}[how]
    if not re.search(r"\b(ORDER|GROUP)\s+BY\b|\b(count|sum|min|max|avg)\s*\(", final, re.I):
        final += f" ORDER BY {order}"
    return f"WITH RECURSIVE {name}({', '.join(named)}, _depth, _path) AS ({first} UNION ALL {second}) {final}"


def _until_from(tokens: list[tuple[str, str]]) -> list[tuple[str, str]]:
    depth = 0
    for i, (kind, word) in enumerate(tokens):
        depth += word in ("(", "[")
        depth -= word in (")", "]")
        if depth == 0 and kind == "name" and word.lower() == "from":
            return tokens[:i]
    return tokens


def _carried(query: str, name: str) -> tuple[str, str]:
    """A query over a recursion with the path and depth of the row above as its last columns, through a derived table too."""
    tokens = tokenize(query)
    columns = _until_from(tokens)
    tail = tokens[len(columns) :]
    for i, (_, word) in enumerate(tail):
        if word == "(" and re.search(rf"\bFROM\s+{name}\b", _text(tail[i : _close(tail, i) + 1]), re.I):
            end = _close(tail, i)
            inner, _ = _carried(_text(tail[i + 1 : end]), name)
            alias = re.match(r"\s*(?:AS\s+)?(\w+)", _text(tail[end + 1 :]), re.I)[1]
            tail = [*tail[:i], ("done", "(" + inner + ")"), *tail[end + 1 :]]
            return f"{_text(columns).rstrip()}, {alias}._up AS _up, {alias}._deep AS _deep {_text(tail)}", alias
    found = re.search(rf"\b{name}\b(?:\s+(?:AS\s+)?(?!WHERE\b|ON\b|JOIN\b|INNER\b|LEFT\b|CROSS\b|USING\b|GROUP\b|ORDER\b|UNION\b)(\w+))?", _text(tail), re.I)
    if not found:
        raise EngineError(UNSUPPORTED_QUERY, f"the second part doesn't read {name}")
    alias = found[1] or name
    return f"{_text(columns).rstrip()}, {alias}._path AS _up, {alias}._depth AS _deep {_text(tail)}", alias


def install(spark: SparkSession) -> None:
    """Registers the functions that rewritten text calls, once for each session."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({args}) RETURNS {kind} RETURN {body}")


#: So that a recursion goes on until no row is new.
UNBOUNDED = {"spark.sql.cteRecursionLevelLimit": "-1", "spark.sql.cteRecursionRowLimit": "-1"}


def sql(spark: SparkSession, text: str, args: dict | None = None, **views: DataFrame) -> DataFrame:
    """Runs a query over temporary views of the frames given by name; what Spark's analysis finds wrong is an EngineError."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    low = text.lower()
    if any(f in low for f in FUNCTIONS) or re.search(r"\bcast\b", low):
        install(spark)
    if re.search(r"\brecursive\b", low):
        for key, value in UNBOUNDED.items():
            spark.conf.set(key, value)
    if re.search(r"\bover\s*\(\s*\)", low) and re.search(r"\b(row_number|rank|dense_rank)\b", low):
        raise EngineError(WINDOW_MISUSE, "a rank needs an order")
    with told():
        text = re.sub(r"\s+OPTIONS\s*\(?\s*\w+\s*=\s*\w+\s*\)?\s*(?=\))", "", text, flags=re.I)  # how to search an index, which changes no exact search
        query = rewrite(_traversed(text)).replace("${" + INCARNATION + "}", str(int(spark.conf.get(INCARNATION, "0"))))
        if "/" in query or "cast" in low:
            query = typed.resolved(spark, query, tokenize, args)
        return spark.sql(query, args=args) if args else spark.sql(query)
