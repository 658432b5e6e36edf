"""A schema over tables: reducers and views as lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ddl.model import Column as Named
from ..ddl.model import Schema, Script
from ..ddl.parser import parse
from ..errors import SchemaError
from ..functions.types import ingest_column, spark_type
from ..operators.reducers import Process, ReducerPlan
from ..operators.views import ViewPlan


def typed_rows(df: DataFrame, columns: tuple[Named, ...], order_by: list[str] | None = None) -> DataFrame:
    """Incoming rows with declared columns and types, ``block_number``, ``_row_index`` and ``_emit_index``.

    A missing column is null, an undeclared one is dropped. Without ``_row_index`` rows are numbered within their block by
    ``order_by``.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if "block_number" not in kinds:
        raise SchemaError("rows need a block_number")
    out = [ingest_column(F.col(c.name), kinds[c.name], c.type).alias(c.name) if c.name in kinds else F.lit(None).cast(spark_type(c.type)).alias(c.name) for c in columns if c.name != "block_number"]
    if "_row_index" in kinds:
        index = F.col("_row_index").cast("long")
    elif order_by:
        index = (F.row_number().over(Window.partitionBy("block_number").orderBy(*order_by)) - 1).cast("long")
    else:
        raise SchemaError("rows need a _row_index, or columns that order them")
    return df.select(F.col("block_number").cast("long").alias("block_number"), index.alias("_row_index"), F.lit(0).cast("long").alias("_emit_index"), *out)


class Dataflow:
    """All of a schema over given tables. ``code``: for scripts and external reducers, name -> (process, emitted columns)."""

    def __init__(self, schema: Schema | str, tables: dict[str, DataFrame], code: dict[str, tuple[Process, tuple[Named, ...]]] | None = None):
        self.schema = parse(schema) if isinstance(schema, str) else schema
        self.tables = {n: typed_rows(tables[n], t.columns) for n, t in self.schema.tables.items() if n in tables}
        self.reducers, self.views = plans_of(self.schema, code or {})
        self._out: dict[str, DataFrame] = {}
        self._snapshots: dict[str, DataFrame | None] = {}

    def source(self, name: str) -> DataFrame:
        """Rows of a table, or what a reducer emits."""
        if name in self.tables:
            return self.tables[name]
        if name not in self._out:
            self._out[name], self._snapshots[name] = self.reducers[name].run(self.source(self.schema.reducers[name].source))
        return self._out[name]

    def snapshots(self, reducer: str) -> DataFrame | None:
        self.source(reducer)
        return self._snapshots[reducer]

    def _upto(self, view: str, upto: int | None) -> DataFrame:
        rows = self.source(self.schema.views[view].source)
        return rows if upto is None else rows.where(F.col("block_number") <= upto)

    def partials(self, view: str, upto: int | None = None) -> DataFrame:
        return self.views[view].partials(self._upto(view, upto))

    def spans(self, view: str, upto: int | None = None) -> DataFrame | None:
        plan = self.views[view]
        return plan.spans(plan.block_times(self._upto(view, upto))) if plan.view.sliding else None

    def state(self, view: str, upto: int | None = None) -> DataFrame:
        """The view after block ``upto``, or after all blocks."""
        return self.views[view].whole(self._upto(view, upto), self.spans(view, upto))

    def changelog(self, view: str, upto: int | None = None) -> DataFrame:
        spans = self.spans(view, upto)
        if spans is not None:  # a row per block, read three times; may spill to disk
            spans = spans.persist()
        return self.views[view].changelog(self.partials(view, upto), spans)


def plans_of(schema: Schema, code: dict[str, tuple[Process, tuple[Named, ...]]]) -> tuple[dict[str, ReducerPlan], dict[str, ViewPlan]]:
    """Plans of all reducers and views, in order, with the types that flow between them."""
    types = {n: {"block_number": "UInt64"} | {c.name: c.type for c in t.columns} for n, t in schema.tables.items()}
    reducers, views = {}, {}
    for r in schema.reducer_order():
        process, emits = code.get(r.name, (None, None))
        if process is None and isinstance(r.body, Script):
            from ..functions.scripts import compile_script

            process, emits = compile_script(r, types[r.source], [schema.modules[m] for m in r.requires], emits)
        reducers[r.name] = ReducerPlan(r, types[r.source], emits, process)
        types[r.name] = {"block_number": "UInt64"} | reducers[r.name].out_types()
    for v in schema.views.values():
        if missing := [i.column for i in v.items if i.column and i.column not in types[v.source]]:
            raise SchemaError(f"view {v.name!r} reads {missing[0]!r}, which {v.source!r} lacks")
        views[v.name] = ViewPlan(v, types[v.source])
    return reducers, views
