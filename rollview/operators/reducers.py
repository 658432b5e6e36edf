"""Reducers: ordered folds per key that emit rows.

Three ways to run one, cheapest first:

1. Rules that neither read nor set state are a projection.
2. Rules whose state fields are running sums, or last values, of expressions over the row alone are window aggregates.
   Windows are per key and block and start from a small table of what earlier blocks leave, so a key that holds most rows
   still spreads over its blocks.
3. Everything else is a Python fold per key, streamed in order through Arrow: a task holds one key's state, never its rows.

Rows out carry the order columns of the row they come from, and ``_emit_index``. Rows in must have ``block_number``,
``_row_index`` and ``_emit_index``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ddl.model import Assign, Column as Named, Emit, EventRules, Let, Native, Reducer
from ..errors import ReducerError, SchemaError
from ..functions.aggregates import ORDER
from ..functions.expressions import KIND_OF, Binary, Expr, Ref, Typed, refs, to_column, to_function, true, truthy
from ..functions.types import default_of, spark_type

STATE_JSON = "_state"


class ReducerCtx:
    """What a Python reducer gets: the state, and a way to emit."""

    def __init__(self, state: dict[str, Any], zeros: dict[str, Any]):
        self.state, self.zeros, self.emitted = state, zeros, []

    def get(self, name: str) -> Any:
        value = self.state.get(name)
        return self.zeros.get(name) if value is None else value

    def set(self, name: str, value: Any) -> None:
        self.state[name] = value

    def update(self, state: dict[str, Any]) -> None:
        """Replace the whole state."""
        self.state.clear()
        self.state.update(state)

    def emit(self, row: dict[str, Any]) -> None:
        self.emitted.append(dict(row))


Process = Callable[[dict, dict], Iterable[dict]]


def rules_process(rules: EventRules) -> Process:
    """Event rules as a function (state, row) -> emitted rows."""
    whens = []
    for when in rules.whens:
        actions = [(a, [(n, to_function(e)) for n, e in a.items] if isinstance(a, Emit) else to_function(a.value)) for a in when.actions]
        whens.append((to_function(when.condition), actions))
    always = [(n, to_function(e)) for n, e in rules.always]

    def process(state: dict, row: dict) -> list[dict]:
        out, matched = {}, False
        for condition, actions in whens:
            if not true(condition(row, state, {})):
                continue
            matched, local = True, {}
            for action, run in actions:
                if isinstance(action, Emit):
                    for name, value in run:
                        out[name] = value(row, state, local)
                elif isinstance(action, Let):
                    local[action.name] = run(row, state, local)
                else:
                    state[action.name] = run(row, state, local)
            break
        for name, value in always:
            out[name] = value(row, state, {})
        return [out] if matched or always else []

    return process


def native_process(body: Native, zeros: dict[str, Any]) -> Process:
    def process(state: dict, row: dict) -> list[dict]:
        ctx = ReducerCtx(state, zeros)
        body.process(state, row, ctx)
        return ctx.emitted

    return process


@dataclass
class ReducerPlan:
    """Plans of one reducer. ``types``: logical types of its source's columns; ``process`` replaces the body's own code,
    for scripts and external reducers, and then ``emits`` names what it emits."""

    reducer: Reducer
    types: dict[str, str]
    emits: tuple[Named, ...] | None = None
    process: Process | None = None

    def __post_init__(self):
        body = self.reducer.body
        if isinstance(body, Native):
            self.emits, self.process = body.emits, native_process(body, self.defaults())
        elif isinstance(body, EventRules):
            self.emits, self.process = self._rule_emits(body), rules_process(body)
        elif self.process is None or self.emits is None:
            raise SchemaError(f"reducer {self.reducer.name!r} needs code and emitted columns: register it")

    def defaults(self) -> dict[str, Any]:
        return {f.name: default_of(f.type, f.default) for f in self.reducer.state}

    # schema of what is emitted
    def _lookup_kind(self, ref: Ref, local: dict[str, str]) -> str:
        state = {f.name: f.type for f in self.reducer.state}
        if ref.scope == "" and ref.name in local:
            return local[ref.name]
        if ref.scope != "state" and ref.name in self.types:
            return self.types[ref.name]
        return state.get(ref.name, "Float64") if ref.scope != "row" else "Float64"

    def _type(self, e: Expr, local: dict[str, str]) -> str:
        from ..functions.expressions import ARITHMETIC, Literal

        if isinstance(e, Literal):
            return "String" if isinstance(e.value, str) else "Float64" if isinstance(e.value, float) else "Int64"
        if isinstance(e, Ref):
            return self._lookup_kind(e, local)
        if isinstance(e, Binary):
            return "Float64" if e.op in ARITHMETIC else "Boolean"
        a, b = self._type(e.then, local), self._type(e.other, local)
        return a if a == b else "Float64" if {KIND_OF[a], KIND_OF[b]} == {"number"} else "String"

    def _rule_emits(self, rules: EventRules) -> tuple[Named, ...]:
        found: dict[str, str] = {}

        def add(name: str, type_: str) -> None:
            old = found.get(name, type_)
            if old != type_ and KIND_OF[old] != KIND_OF[type_]:
                raise SchemaError(f"reducer {self.reducer.name!r} emits {name!r} as {old} and as {type_}")
            found[name] = type_ if old == type_ else "Float64"

        for when in rules.whens:
            local: dict[str, str] = {}
            for a in when.actions:
                if isinstance(a, Let):
                    local[a.name] = self._type(a.value, local)
                elif isinstance(a, Emit):
                    for name, e in a.items:
                        add(name, self._type(e, local))
        for name, e in rules.always:
            add(name, self._type(e, {}))
        return tuple(Named(n, t) for n, t in found.items())

    def out_types(self) -> dict[str, str]:
        """Logical types of the emitted columns and the keys."""
        emitted = {c.name: c.type for c in self.emits}
        return {k: self.types.get(k, "String") for k in self.reducer.group_by if k not in emitted} | emitted

    def out_columns(self) -> list[str]:
        return [*self.out_types(), *ORDER]

    # 1 and 2: columns only
    def tier(self) -> int:
        """1: projection, 2: windows, 3: fold."""
        body = self.reducer.body
        if not isinstance(body, EventRules) or type(self.reducer.body) is not EventRules:
            return 3
        fields = {f.name for f in self.reducer.state}
        reads = {r for w in body.whens for e in [w.condition, *(x for a in w.actions for x in ([i[1] for i in a.items] if isinstance(a, Emit) else [a.value]))] for r in refs(e)} | {r for _, e in body.always for r in refs(e)}
        touches = any(isinstance(a, Assign) for w in body.whens for a in w.actions)
        if not touches and not any(self._is_state(r, fields) for r in reads):
            return 1
        return 2 if self._scans() is not None else 3

    def _is_state(self, r: Ref, fields: set[str], local: frozenset[str] = frozenset()) -> bool:
        if r.scope == "state":
            return True
        return r.scope == "" and r.name in fields and r.name not in local

    def _scans(self) -> dict[str, str] | None:
        """Field -> sum or last, if all rules only add row expressions to fields or set fields to them."""
        fields, found = {f.name: f.type for f in self.reducer.state}, {}
        pure = lambda e, local: not any(self._is_state(r, set(fields), local) or r.scope == "" and r.name in local for r in refs(e))
        for when in self.reducer.body.whens:
            if not pure(when.condition, frozenset()):
                return None
            set_, local = set(), set()
            for a in when.actions:
                if isinstance(a, Let):
                    local.add(a.name)
                    if not pure(a.value, frozenset()) and set_:
                        return None
                if not isinstance(a, Assign):
                    continue
                e, kind = a.value, "last"
                if isinstance(e, Binary) and e.op in "+-" and e.left == Ref("state", a.name):
                    e, kind = e.right, "sum"
                if a.name in set_ or a.name not in fields or not pure(e, frozenset(local)) or found.get(a.name, kind) != kind:
                    return None
                if kind == "sum" and fields[a.name] not in ("Float64",):
                    return None
                set_.add(a.name)
                found[a.name] = kind
        # LETs are read before SETs only if they come first
        for when in self.reducer.body.whens:
            seen_set = False
            for a in when.actions:
                seen_set |= isinstance(a, Assign)
                if isinstance(a, Emit) and not seen_set and any(isinstance(x, Assign) for x in when.actions):
                    return None
                if isinstance(a, Let) and any(self._is_state(r, set(fields)) for r in refs(a.value)):
                    return None
        return found

    def _column(self, e: Expr, local: dict[str, Typed]) -> Typed:
        state = {f.name: f.type for f in self.reducer.state}

        def lookup(r: Ref) -> Typed | None:
            row = Typed(F.col(r.name), KIND_OF[self.types[r.name]]) if r.name in self.types else None
            held = Typed(F.col(f"__s_{r.name}"), KIND_OF[state[r.name]]) if r.name in state else None
            if r.scope == "row":
                return row
            if r.scope == "state":
                return held
            if r.name in local:
                return local[r.name]
            return Typed(F.coalesce(row.column, held.column), row.kind) if row and held and row.kind == held.kind else row or held

        return to_column(e, lookup)

    def _matches(self) -> list[Column]:
        """For each WHEN: it holds and none before it does."""
        out, before = [], F.lit(False)
        for w in self.reducer.body.whens:
            holds = truthy(self._column(w.condition, {}))
            out.append(holds & ~before)
            before = before | holds
        return out

    def _project(self, rows: DataFrame) -> DataFrame:
        body, matches = self.reducer.body, self._matches()
        columns: dict[str, Column] = {}
        for when, match in zip(body.whens, matches, strict=True):
            local: dict[str, Typed] = {}
            for a in when.actions:
                if isinstance(a, Let):
                    local[a.name] = self._column(a.value, local)
                elif isinstance(a, Emit):
                    for name, e in a.items:
                        value = self._column(e, local).column.cast(spark_type(self.out_types()[name]))
                        columns[name] = F.when(match, value).otherwise(columns[name]) if name in columns else F.when(match, value)
        for name, e in body.always:
            columns[name] = self._column(e, {}).column.cast(spark_type(self.out_types()[name]))
        if not body.always:
            any_ = F.lit(False)
            for m in matches:
                any_ = any_ | m
            rows = rows.where(any_)
        return rows.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in self.out_types()), "block_number", "_row_index", F.lit(0).alias("_emit_index"))

    def _scan(self, rows: DataFrame, states: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        keys, kinds = list(self.reducer.group_by), self._scans()
        types, zeros = {f.name: f.type for f in self.reducer.state}, self.defaults()
        for field, kind in kinds.items():
            steps = F.lit(None).cast(spark_type(types[field]))
            for when, match in zip(self.reducer.body.whens, self._matches(), strict=True):
                for a in when.actions:
                    if isinstance(a, Assign) and a.name == field:
                        if kind == "sum":
                            step = self._column(a.value.right, {}).column.cast("double")
                            steps = F.when(match, step if a.value.op == "+" else -step).otherwise(steps)
                        else:
                            steps = F.when(match, self._column(a.value, {}).column.cast(spark_type(types[field]))).otherwise(steps)
            rows = rows.withColumn(f"__d_{field}", steps)
        inner = Window.partitionBy(*keys, "block_number").orderBy(*ORDER[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        total = lambda f, k: F.sum(f"__d_{f}") if k == "sum" else F.max_by(F.when(F.col(f"__d_{f}").isNotNull(), F.col(f"__d_{f}")), F.when(F.col(f"__d_{f}").isNotNull(), F.struct(*ORDER[1:])))
        per_block = rows.groupBy(*keys, "block_number").agg(*(total(f, k).alias(f"__b_{f}") for f, k in kinds.items()))
        upto = Window.partitionBy(*keys).orderBy("block_number").rowsBetween(Window.unboundedPreceding, -1)
        left = lambda f, k: F.sum(f"__b_{f}").over(upto) if k == "sum" else F.last(f"__b_{f}", ignorenulls=True).over(upto)
        per_block = per_block.select(*keys, "block_number", *(left(f, k).alias(f"__o_{f}") for f, k in kinds.items()), *(f"__b_{f}" for f in kinds))
        start = {f: F.lit(zeros[f]).cast(spark_type(types[f])) for f in types}
        if states is not None:
            parsed = states.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(F.get_json_object(STATE_JSON, f"$.{f}").cast(spark_type(types[f])).alias(f"__i_{f}") for f in types))
            on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
            per_block = per_block.join(parsed, on, "left").drop(*(f"__k{i}" for i in range(len(keys))))
            start = {f: F.coalesce(F.col(f"__i_{f}"), c) for f, c in start.items()}
        ahead = per_block.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("block_number").alias("__b"), *(c.alias(f"__z_{f}") for f, c in start.items()), *(f"__o_{f}" for f in kinds))
        on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("block_number") == F.col("__b")]
        running = rows.join(ahead, on)
        for f in types:
            zero = F.col(f"__z_{f}")
            if kinds.get(f) == "sum":
                now = zero + F.coalesce(f"__o_{f}", F.lit(0.0)) + F.coalesce(F.sum(f"__d_{f}").over(inner), F.lit(0.0))
            elif kinds.get(f) == "last":
                now = F.coalesce(F.last(f"__d_{f}", ignorenulls=True).over(inner), F.col(f"__o_{f}"), zero)
            else:
                now = zero
            running = running.withColumn(f"__s_{f}", now)
        after = {f: start[f] + F.coalesce(f"__o_{f}", F.lit(0.0)) + F.coalesce(f"__b_{f}", F.lit(0.0)) if kinds.get(f) == "sum" else F.coalesce(f"__b_{f}", f"__o_{f}", start[f]) if kinds.get(f) == "last" else start[f] for f in types}
        snapshots = per_block.select(*keys, "block_number", F.to_json(F.struct(*(c.alias(f) for f, c in after.items()))).alias(STATE_JSON))
        return self._project(running), snapshots

    # 3: a fold
    def _fold(self, rows: DataFrame, states: DataFrame | None, wants: str = "both") -> DataFrame:
        """What the fold emits, and after each block of a key a row with its state as JSON, or one of the two (``wants``:
        emits, states, both). Rows are dealt by key and sorted; a task streams them and holds one key's state at a time."""
        keys, process, defaults, order = list(self.reducer.group_by), self.process, self.defaults(), list(ORDER)
        types, name, reads = self.out_types(), self.reducer.name, getattr(process, "reads", None)
        wanted = [c for c in self.types if c in rows.columns and c != "block_number" and (reads is None or c in reads or c in keys)]
        emits, snapshots, by_block = wants != "states", wants != "emits", getattr(process, "by_block", False)
        initial = json.dumps(defaults, default=_bytes_out) if any(f.type == "JSON" for f in self.reducer.state) else None
        rows = rows.select(*dict.fromkeys([*keys, *wanted, *order]))
        if states is not None:  # of the keys that have rows; they come before all rows of their key
            known = rows.select(*keys).distinct()
            on = [F.col(f"s.`{k}`").eqNullSafe(F.col(f"k.`{k}`")) for k in keys]
            held = states.alias("s").join(known.alias("k"), on, "left_semi").select(*keys, STATE_JSON, F.lit(_FIRST).alias("block_number"))
            rows = rows.withColumn(STATE_JSON, F.lit(None).cast("string")).unionByName(held, allowMissingColumns=True)
        else:
            rows = rows.withColumn(STATE_JSON, F.lit(None).cast("string"))
        fields = [T.StructField(c, spark_type(t)) for c, t in types.items()] + [T.StructField(c, T.LongType()) for c in order] + [T.StructField(STATE_JSON, T.StringType())]
        schema = T.StructType(fields)

        def fresh() -> dict:
            return json.loads(initial) if initial else dict(defaults)

        def run(batches):
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow, out = to_arrow_schema(schema), _Rows(len(fields))
            key, block, state, group = None, None, None, []

            def emitted(row: dict, place: int, found: Iterable[dict], first: int = 0) -> int:
                for e in found:
                    out.add([*(e.get(c, row.get(c)) if c in keys else e.get(c) for c in types), block, place, first, None])
                    first += 1
                return first

            def settle() -> None:
                """The end of a key's block."""
                if block is None:
                    return
                if group:
                    for k, found in enumerate(_failing(lambda: list(process(state, [r for r, _ in group])), name, block)):
                        row, place = group[min(k, len(group) - 1)]
                        if emits:
                            emitted(row, place, [found], max(0, k - len(group) + 1))
                    group.clear()
                if snapshots:
                    out.add([*(own.get(c) for c in types), block, -1, -1, json.dumps(state, default=_bytes_out)])

            own: dict = {}
            for batch in batches:
                columns = {f: batch.column(f).to_pylist() for f in batch.schema.names}
                held_json, blocks, places = columns.pop(STATE_JSON), columns.pop("block_number"), columns.pop("_row_index")
                columns.pop("_emit_index")
                names, values = [*columns], zip(*columns.values(), strict=True) if columns else ((),) * len(blocks)
                key_values = zip(*(columns[k] for k in keys), strict=True) if keys else ((),) * len(blocks)
                for now, at, place, row_values, held in zip(key_values, blocks, places, values, held_json, strict=True):
                    if now != key or state is None:
                        settle()
                        key, block, state, own = now, None, fresh(), dict(zip(keys, now, strict=True))
                    if held is not None:
                        state.update(json.loads(held))
                        continue
                    if at != block:
                        settle()
                        block = at
                    row = dict(zip(names, row_values, strict=True))
                    row["block_number"] = at
                    if by_block:
                        group.append((row, place))
                        continue
                    try:
                        found = process(state, row)
                    except Exception as error:
                        raise ReducerError(f"reducer {name!r}, block {at}: {error}") from error
                    if emits:
                        emitted(row, place, found)
                    else:
                        for _ in found:  # a generator's effects on the state
                            pass
                if len(out) > 20_000:
                    yield out.batch(arrow)
            settle()
            if len(out):
                yield out.batch(arrow)

        # few bytes and much work: a stated number of partitions is not merged into fewer
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(parts, *keys) if keys else rows.coalesce(1)
        return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

    def run(self, rows: DataFrame, states: DataFrame | None = None, write: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> tuple[DataFrame, DataFrame | None]:
        """(emitted rows, snapshots: keys, block_number and ``_state`` as JSON after each block of a key; None if the
        reducer has no state). ``states`` has each key's state before the first row; keys without one start anew. ``write``
        stores a fold's rows and reads them again, those without and those with a state, so that it runs once for both; without
        it each result that is used runs the fold, and emitted rows make no snapshots."""
        tier = self.tier()
        if tier == 1:
            return self._project(rows), None
        if tier == 2:
            return self._scan(rows, states)
        emitted, held = write(self._fold(rows, states)) if write is not None else (self._fold(rows, states, "emits"), self._fold(rows, states, "states"))
        return emitted.drop(STATE_JSON), held.select(*self.reducer.group_by, "block_number", STATE_JSON)


#: The block number of a key's state among its rows.
_FIRST = -(1 << 63)


def _failing(run: Callable, name: str, block: int) -> Any:
    try:
        return run()
    except Exception as error:
        raise ReducerError(f"reducer {name!r}, block {block}: {error}") from error


class _Rows:
    """Rows on their way to Arrow."""

    def __init__(self, width: int):
        self.columns: list[list] = [[] for _ in range(width)]

    def __len__(self) -> int:
        return len(self.columns[0])

    def add(self, values: list) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        """All rows so far, which are dropped here."""
        columns, self.columns = self.columns, [[] for _ in self.columns]
        return pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _array(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError, OverflowError):
        return pa.array([_cell(v, kind) for v in values], kind)


def _cell(value: Any, kind: pa.DataType) -> Any:
    """A value that code emitted as its column's type; null if it is none of that type."""
    if hasattr(value, "item"):
        value = value.item()
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return value if value is None or isinstance(value, str) else json.dumps(value, default=_bytes_out) if isinstance(value, (dict, list)) else str(value)
    if pa.types.is_boolean(kind):
        return value if isinstance(value, bool) else None
    if pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return bytes(value) if isinstance(value, (bytes, bytearray)) else value.encode() if isinstance(value, str) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if pa.types.is_integer(kind):
        return int(value) if value == value and abs(value) < 1 << 63 else None
    return float(value)


def _bytes_out(x: Any) -> Any:
    if hasattr(x, "plain"):  # a script's table
        return x.plain()
    return x.hex() if isinstance(x, (bytes, bytearray)) else x.item() if hasattr(x, "item") else str(x)


def state_at(snapshots: DataFrame, keys: list[str], block: int | None = None) -> DataFrame:
    """Each key's state after ``block``, or its latest."""
    if block is not None:
        snapshots = snapshots.where(F.col("block_number") <= block)
    return snapshots.groupBy(*keys).agg(F.max_by(STATE_JSON, "block_number").alias(STATE_JSON))
