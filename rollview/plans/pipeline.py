"""A fluent builder: tables, reducers and views in Python instead of DDL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from ..ddl.model import Column, Item, Native, Reducer, Schema, Script, Sliding, StateField, Table, View
from ..ddl.parser import UNITS, validate
from ..errors import SchemaError
from ..functions.types import logical
from .engine import Engine


class ColumnType(str):
    """The name of a logical type; calling it gives the name, so ``uint64`` and ``uint64()`` are the same."""

    def __call__(self) -> ColumnType:
        return self


uint64, int64, float64, uint256 = map(ColumnType, ("UInt64", "Int64", "Float64", "UInt256"))
string, datetime, boolean, bytes_, base58, json_ = map(ColumnType, ("String", "DateTime", "Boolean", "Bytes", "Base58", "JSON"))

_SHORT = {"s": "second", "sec": "second", "m": "minute", "min": "minute", "h": "hour", "hr": "hour", "d": "day"}


def parse_duration(text: str) -> int:
    """Milliseconds of a text such as ``5 minutes``, ``1h`` or ``30 sec``."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]+)\s*", text)
    unit = m and m[2].lower()
    unit = unit and _SHORT.get(unit, _SHORT.get(unit.removesuffix("s"), unit.removesuffix("s")))
    if unit not in UNITS:
        raise SchemaError(f"can't read duration {text!r}")
    return int(m[1]) * UNITS[unit]


@dataclass(frozen=True)
class Selected:
    """A column of a view before it has its name."""

    kind: str
    column: str | None = None
    function: str | None = None
    interval_ms: int | None = None
    alias: str | None = None

    def as_(self, alias: str) -> Selected:
        return Selected(self.kind, self.column, self.function, self.interval_ms, alias)

    def item(self, name: str | None = None) -> Item:
        default = {"column": self.column, "bucket": f"{self.column}_interval"}.get(self.kind) or (f"{self.function}_{self.column}" if self.column else self.function)
        return Item(self.kind, name or self.alias or default, self.column, self.function, self.interval_ms)


class Agg:
    """What a view may select."""

    @staticmethod
    def key(column: str) -> Selected:
        return Selected("column", column)

    @staticmethod
    def count(column: str | None = None) -> Selected:
        return Selected("aggregate", column, "count")


for _name in ("sum", "min", "max", "avg", "first", "last"):
    setattr(Agg, _name, staticmethod(lambda column, _f=_name: Selected("aggregate", column, _f)))

agg = Agg()


def interval(column: str, width: str) -> Selected:
    return Selected("bucket", column, interval_ms=parse_duration(width))


def infer_state(initial: Mapping[str, Any]) -> tuple[StateField, ...]:
    """State fields, by name, from the values they start with."""
    out = []
    for name in sorted(initial):
        v = initial[name]
        kind = "Boolean" if isinstance(v, bool) else "Int64" if isinstance(v, int) else "Float64" if isinstance(v, float) else "String" if isinstance(v, str) else "JSON" if isinstance(v, (dict, list)) else None
        if kind is None:
            raise SchemaError(f"can't infer the type of state field {name!r} from {v!r}")
        out.append(StateField(name, kind, json.dumps(v) if kind == "JSON" else str(v).lower() if kind == "Boolean" else str(v)))
    return tuple(out)


class _Source:
    def __init__(self, pipeline: Pipeline, name: str):
        self.pipeline, self.name = pipeline, name

    def create_reducer(self, name: str, *, group_by: str | list[str], initial: Mapping[str, Any], reduce: Callable[..., Any], emits: Mapping[str, str], where: str | None = None) -> _Source:
        """``reduce(state, row, ctx)`` updates ``state`` and calls ``ctx.emit``; ``emits`` names what it emits and the types."""
        keys = (group_by,) if isinstance(group_by, str) else tuple(group_by)
        body = Native(reduce, tuple(Column(n, logical(t)) for n, t in emits.items()))
        self.pipeline._add(self.pipeline.schema.reducers, Reducer(name, self.name, keys, infer_state(initial), body))
        return _Source(self.pipeline, name)

    def create_view(self, name: str, *, select: Callable[[Agg], Mapping[str, Selected] | list[Selected]] | Mapping[str, Selected] | list[Selected], group_by: list[str] | None = None, sliding: tuple[str, str] | None = None) -> ViewHandle:
        """``select`` may be a function of :data:`agg`; ``sliding`` is (width, time column)."""
        chosen = select(agg) if callable(select) else select
        items = tuple(s.item(n) for n, s in chosen.items()) if isinstance(chosen, Mapping) else tuple(s.item() for s in chosen)
        keys = tuple(group_by) if group_by is not None else tuple(i.name for i in items if i.kind != "aggregate")
        self.pipeline._add(self.pipeline.schema.views, View(name, self.name, items, keys, Sliding(parse_duration(sliding[0]), sliding[1]) if sliding else None))
        return ViewHandle(self.pipeline, name)


@dataclass(frozen=True)
class ViewHandle:
    pipeline: Pipeline
    name: str


class Pipeline:
    def __init__(self):
        self.schema = Schema()

    def _add(self, kind: dict, made) -> None:
        if any(made.name in x for x in (self.schema.tables, self.schema.reducers, self.schema.views)):
            raise SchemaError(f"{made.name!r} is defined twice")
        kind[made.name] = made

    def table(self, name: str, columns: Mapping[str, str], virtual: bool = False) -> _Source:
        self._add(self.schema.tables, Table(name, tuple(Column(n, logical(t)) for n, t in columns.items()), virtual))
        return _Source(self, name)

    def virtual_table(self, name: str, columns: Mapping[str, str]) -> _Source:
        return self.table(name, columns, virtual=True)

    def to_ddl(self) -> str:
        return to_ddl(self.schema)

    def build(self, spark: SparkSession, data_dir: str, **options: Any) -> Engine:
        return Engine.open(spark, validate(self.schema), data_dir, **options)


def _interval_text(ms: int) -> str:
    unit, width = next((u, w) for u, w in reversed(UNITS.items()) if ms % w == 0)
    return f"INTERVAL {ms // width} {unit.upper()}"


def to_ddl(schema: Schema) -> str:
    """DDL text of modules, tables, views and reducers; scripts are kept, other reducers are declared external."""
    out = [f"CREATE MODULE {m.name} LANGUAGE LUA AS $${m.source}$$;" for m in schema.modules.values()]
    for t in schema.tables.values():
        out.append(f"CREATE {'VIRTUAL ' * t.virtual}TABLE {t.name} ({', '.join(f'{c.name} {c.type}' for c in t.columns)});")
    for r in schema.reducer_order():
        quoted = lambda f: "" if f.default is None else " DEFAULT '" + f.default.replace("'", "''") + "'"
        state = ", ".join(f"{f.name} {f.type}{quoted(f)}" for f in r.state)
        body = f"{'REQUIRE ' + ', '.join(r.requires) + ' ' if r.requires else ''}LANGUAGE lua PROCESS $${r.body.source}$$" if isinstance(r.body, Script) else "LANGUAGE EXTERNAL"
        out.append(f"CREATE REDUCER {r.name} SOURCE {r.source} GROUP BY {', '.join(r.group_by)} STATE ({state}) {body};")
    for v in schema.views.values():
        items = []
        for i in v.items:
            what = i.column if i.kind == "column" else f"toStartOfInterval({i.column}, {_interval_text(i.interval_ms)})" if i.kind == "bucket" else f"{i.function}({i.column or ''})"
            items.append(f"{what} AS {i.name}")
        by = f" GROUP BY {', '.join(v.group_by)}" if v.group_by else ""
        window = f" WINDOW SLIDING {_interval_text(v.sliding.width_ms)} BY {v.sliding.time_column}" if v.sliding else ""
        out.append(f"CREATE MATERIALIZED VIEW {v.name} AS SELECT {', '.join(items)} FROM {v.source}{by}{window};")
    return "\n".join(out)
