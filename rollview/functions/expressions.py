"""Expressions of event rules: syntax, and two ways to run them.

``to_column`` gives a Spark column for rules without order-dependent state; ``to_function`` gives a Python function for
folds. Both follow the same rules: arithmetic is in doubles and null on anything that is no number; ``x / 0`` is 0; ``=``
and ``!=`` are never null and two nulls are equal; other comparisons of what can't be compared are false, except that two
nulls are both at most and at least each other; a condition holds for true, numbers other than 0 and non-empty strings.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SchemaError


@dataclass(frozen=True)
class Literal:
    value: int | float | str


@dataclass(frozen=True)
class Ref:
    """``scope`` is row, state or empty (a local, else the row's column, else the state's field)."""

    scope: str
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class If:
    condition: Expr
    then: Expr
    other: Expr


Expr = Literal | Ref | Binary | If
ARITHMETIC, COMPARISONS = ("+", "-", "*", "/"), ("=", "!=", "<", ">", "<=", ">=")


def refs(e: Expr) -> set[Ref]:
    if isinstance(e, Ref):
        return {e}
    if isinstance(e, Binary):
        return refs(e.left) | refs(e.right)
    return refs(e.condition) | refs(e.then) | refs(e.other) if isinstance(e, If) else set()


@dataclass(frozen=True)
class Typed:
    """A column with its kind: number, string, boolean, binary or null."""

    column: Column
    kind: str


KIND_OF = {"UInt64": "number", "Int64": "number", "DateTime": "number", "Float64": "number", "String": "string", "JSON": "string", "Boolean": "boolean", "Bytes": "binary", "Base58": "binary", "UInt256": "binary"}


def _null() -> Typed:
    return Typed(F.lit(None).cast("double"), "null")


def truthy(t: Typed) -> Column:
    if t.kind == "null":
        return F.lit(False)
    holds = {"boolean": lambda c: c, "number": lambda c: c != 0, "string": lambda c: F.length(c) > 0, "binary": lambda c: c.isNotNull()}[t.kind](t.column)
    return F.coalesce(holds, F.lit(False))


def to_column(e: Expr, lookup: Callable[[Ref], Typed | None]) -> Typed:
    """``lookup`` gives the column of a reference, or None for what does not exist."""
    if isinstance(e, Literal):
        return Typed(F.lit(e.value), "string" if isinstance(e.value, str) else "number")
    if isinstance(e, Ref):
        return lookup(e) or _null()
    if isinstance(e, If):
        condition, then, other = (to_column(x, lookup) for x in (e.condition, e.then, e.other))
        kinds = {then.kind, other.kind} - {"null"}
        if len(kinds) > 1:
            raise SchemaError(f"IF has branches of kinds {' and '.join(sorted(kinds))}")
        return Typed(F.when(truthy(condition), then.column).otherwise(other.column), kinds.pop() if kinds else "null")
    left, right = to_column(e.left, lookup), to_column(e.right, lookup)
    if e.op in ("AND", "OR"):
        a, b = truthy(left), truthy(right)
        return Typed(a & b if e.op == "AND" else a | b, "boolean")
    numbers = left.kind == right.kind == "number"
    if e.op in ARITHMETIC:
        if not numbers:
            return _null()
        a, b = left.column.cast("double"), right.column.cast("double")
        if e.op == "/":
            return Typed(F.when(b == 0, F.when(a.isNotNull(), F.lit(0.0))).otherwise(a / b), "number")
        return Typed({"+": a + b, "-": a - b, "*": a * b}[e.op], "number")
    nulls = left.column.isNull() & right.column.isNull()
    if left.kind != right.kind:  # what can't be compared; only two nulls are alike
        alike = nulls
        return Typed({"=": alike, "!=": ~alike, "<=": alike, ">=": alike}.get(e.op, F.lit(False)), "boolean")
    a, b = (left.column.cast("double"), right.column.cast("double")) if numbers else (left.column, right.column)
    known = F.lit(True) if not numbers else ~(F.isnan(F.coalesce(a, F.lit(0.0))) | F.isnan(F.coalesce(b, F.lit(0.0))))
    if e.op in ("=", "!="):
        same = a.eqNullSafe(b) & known
        return Typed(same if e.op == "=" else ~same, "boolean")
    holds = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[e.op]
    return Typed(F.coalesce(holds & known, nulls if "=" in e.op else F.lit(False)), "boolean")


def _number(x: Any) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def true(x: Any) -> bool:
    if x is None:
        return False
    return x if isinstance(x, bool) else x != 0 if isinstance(x, (int, float)) else len(x) > 0 if isinstance(x, str) else True


def _equal(a: Any, b: Any) -> bool:
    x, y = _number(a), _number(b)
    if x is not None and y is not None:
        return x == y
    return a is None and b is None or type(a) is type(b) and a == b


def _order(a: Any, b: Any) -> int | None:
    x, y = _number(a), _number(b)
    if x is not None and y is not None:
        return None if math.isnan(x) or math.isnan(y) else (x > y) - (x < y)
    if a is None and b is None:
        return 0
    return (a > b) - (a < b) if type(a) is type(b) and isinstance(a, (str, bytes, bool)) else None


_TESTS = {"<": lambda o: o < 0, ">": lambda o: o > 0, "<=": lambda o: o <= 0, ">=": lambda o: o >= 0}


def to_function(e: Expr) -> Callable[[Mapping, Mapping, Mapping], Any]:
    """A function of (row, state, locals)."""
    if isinstance(e, Literal):
        value = e.value
        return lambda row, state, local: value
    if isinstance(e, Ref):
        name = e.name
        if e.scope == "row":
            return lambda row, state, local: row.get(name)
        if e.scope == "state":
            return lambda row, state, local: state.get(name)
        return lambda row, state, local: local[name] if name in local else row[name] if row.get(name) is not None else state.get(name)
    if isinstance(e, If):
        condition, then, other = map(to_function, (e.condition, e.then, e.other))
        return lambda *at: then(*at) if true(condition(*at)) else other(*at)
    op, left, right = e.op, to_function(e.left), to_function(e.right)
    if op == "AND":
        return lambda *at: true(left(*at)) & true(right(*at))
    if op == "OR":
        return lambda *at: true(left(*at)) | true(right(*at))
    if op == "=":
        return lambda *at: _equal(left(*at), right(*at))
    if op == "!=":
        return lambda *at: not _equal(left(*at), right(*at))
    if op in _TESTS:
        test = _TESTS[op]
        return lambda *at: (o := _order(left(*at), right(*at))) is not None and test(o)

    def compute(*at: Any) -> float | None:
        a, b = _number(left(*at)), _number(right(*at))
        if a is None or b is None:
            return None
        return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b if b else 0.0

    return compute
