"""Definitions that DDL text and the fluent builder both produce."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..functions.expressions import Expr


@dataclass(frozen=True)
class Column:
    name: str
    type: str


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    virtual: bool = False


@dataclass(frozen=True)
class Module:
    name: str
    source: str


@dataclass(frozen=True)
class StateField:
    name: str
    type: str
    default: str | None = None


@dataclass(frozen=True)
class Let:
    name: str
    value: Expr


@dataclass(frozen=True)
class Assign:
    name: str
    value: Expr


@dataclass(frozen=True)
class Emit:
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class When:
    condition: Expr
    actions: tuple[Let | Assign | Emit, ...]


@dataclass(frozen=True)
class EventRules:
    whens: tuple[When, ...]
    always: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True)
class Script:
    """Code in a scripting language, run through a registered interpreter."""

    language: str
    source: str


@dataclass(frozen=True)
class External:
    """A Python function attached by name; ``emits`` are the columns and types it emits."""


@dataclass(frozen=True)
class Native:
    """A Python function ``process(state, row, ctx)`` with the columns and types it emits."""

    process: Callable[..., Any]
    emits: tuple[Column, ...]


@dataclass(frozen=True)
class Reducer:
    name: str
    source: str
    group_by: tuple[str, ...]
    state: tuple[StateField, ...]
    body: EventRules | Script | External | Native
    requires: tuple[str, ...] = ()


@dataclass(frozen=True)
class Item:
    """One column of a view: ``kind`` is column, bucket or aggregate."""

    kind: str
    name: str
    column: str | None = None
    function: str | None = None
    interval_ms: int | None = None


@dataclass(frozen=True)
class Sliding:
    width_ms: int
    time_column: str


@dataclass(frozen=True)
class View:
    name: str
    source: str
    items: tuple[Item, ...]
    group_by: tuple[str, ...] = ()
    sliding: Sliding | None = None

    @property
    def keys(self) -> list[Item]:
        return [i for i in self.items if i.kind != "aggregate"]

    @property
    def aggregates(self) -> list[Item]:
        return [i for i in self.items if i.kind == "aggregate"]


@dataclass
class Schema:
    tables: dict[str, Table] = field(default_factory=dict)
    modules: dict[str, Module] = field(default_factory=dict)
    reducers: dict[str, Reducer] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)

    def reducer_order(self) -> list[Reducer]:
        """Reducers after their sources."""
        done, out, left = set(self.tables), [], dict(self.reducers)
        while left:
            ready = [r for r in left.values() if r.source in done]
            if not ready:
                from ..errors import SchemaError

                raise SchemaError(f"reducers form a cycle or lack a source: {', '.join(left)}")
            for r in ready:
                out.append(r)
                done.add(r.name)
                del left[r.name]
        return out
