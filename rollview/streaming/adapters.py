"""Continuous mode on Structured Streaming.

``run_blocks`` drives an engine from a stream of rows: each micro-batch holds whole blocks, becomes one ``ingest`` call, and
is acknowledged once its changes are delivered. A replayed block is recognised by its rows, so nothing is taken in twice;
other rows of old blocks, such as the rest of a split block or a block after a fork, are an error. ``follow`` drives an
engine from any source that can report forks. ``stream_reducer`` runs an ordered fold as keyed streaming state without the engine's undo.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import InvalidOperation
from ..functions.aggregates import ORDER
from ..functions.types import spark_type
from ..operators.reducers import ReducerPlan, _bytes_out
from ..plans.dataflow import typed_rows
from ..plans.engine import ChangeBatch, Cursor, Engine


def known_blocks(engine: Engine, table: str, old: DataFrame) -> bool:
    """Whether ``old`` holds whole blocks, row by row as the engine has them."""
    held = engine.raw(table)
    if held is None:
        return False
    given = typed_rows(old, engine.schema.tables[table].columns)
    held = held.join(given.select("block_number").distinct(), "block_number", "left_semi").select(*given.columns)
    return given.exceptAll(held).isEmpty() and held.exceptAll(given).isEmpty()


def run_blocks(engine: Engine, stream: DataFrame, table: str, on_change: Callable[[ChangeBatch], Any], checkpoint: str, available_now: bool = True, **trigger: Any):
    """Start a query that feeds ``stream`` (rows with block_number and _row_index) into ``table``. A block must not be split
    over micro-batches: rows of old blocks that are no replay fail the query, as ``Engine.ingest`` rejects them."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        if (waiting := engine.pending_batch) is not None:  # its delivery failed: once more
            on_change(waiting)
            engine.ack(waiting.sequence)
        latest = F.lit(engine.latest_block)
        old = batch.where(F.col("block_number") <= latest)
        if not old.isEmpty() and known_blocks(engine, table, old):  # a replay brings known blocks again
            batch = batch.where(F.col("block_number") > latest)
        changes = engine.ingest({table: batch})
        if changes is not None:
            on_change(changes)
            engine.ack(changes.sequence)

    query = stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query.trigger(**trigger)).start()


class Fork(Exception):
    """Raised by a source whose chain has left ours; ``chain``: its blocks, latest first."""

    def __init__(self, chain: Iterable[Cursor]):
        super().__init__("the chain has forked")
        self.chain = list(chain)


def follow(engine: Engine, read: Callable[[Cursor | None], Iterable[tuple[dict, Iterable[Cursor], Cursor | None]]], on_change: Callable[[ChangeBatch], Any]) -> None:
    """Feed an engine from a source until it ends. ``read(cursor)`` gives (rows by table, chain, finalized head) from after
    ``cursor`` on, or raises :class:`Fork`; then the engine rolls back to the last block in common, tells ``on_change`` so, and
    reading goes on from there. Every batch is acknowledged after ``on_change`` returns; one whose delivery failed is delivered
    again first."""

    def deliver(batch: ChangeBatch | None) -> None:
        if batch is not None:
            on_change(batch)
            engine.ack(batch.sequence)

    deliver(engine.pending_batch)
    while True:
        try:
            for data, chain, finalized in read(engine.latest_cursor if engine.latest_block else None):
                if finalized is None:
                    raise InvalidOperation("a source must tell its finalized head")
                deliver(engine.ingest(data, chain, finalized))
            return
        except Fork as fork:
            deliver(engine.handle_fork(fork.chain)[1])


def stream_reducer(plan: ReducerPlan, rows: DataFrame) -> DataFrame:
    """What a reducer emits over a stream of ordered rows, as an append-only stream. Rows are put in order within each
    micro-batch; across batches they must come in order."""
    keys, types, process = list(plan.reducer.group_by), plan.out_types(), plan.process
    if getattr(process, "by_block", False):
        raise InvalidOperation(f"reducer {plan.reducer.name!r} takes whole blocks, which keyed streaming state does not know")
    defaults, wanted, order = plan.defaults(), [c for c in plan.types if c in rows.columns], list(ORDER)

    def fold(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else json.loads(json.dumps(defaults, default=_bytes_out))
        group = pd.concat(list(groups)).sort_values(order, kind="stable")
        out = []
        for row in group.to_dict("records"):
            known = {c: None if pd.isna(row[c]) else row[c] for c in wanted}
            for k, e in enumerate(process(held, known)):
                out.append((*(e.get(c, known.get(c)) if c in keys else e.get(c) for c in types), row["block_number"], row["_row_index"], k))
        state.update((json.dumps(held, default=_bytes_out),))
        yield pd.DataFrame(out, columns=[*types, *order])

    schema = T.StructType([T.StructField(c, spark_type(t)) for c, t in types.items()] + [T.StructField(c, T.LongType()) for c in order])
    return rows.select(*dict.fromkeys([*keys, *wanted, *order])).groupBy(*keys).applyInPandasWithState(fold, schema, "state string", "append", GroupStateTimeout.NoTimeout)
