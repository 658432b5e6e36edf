"""The engine: ingest blocks, get net changes, acknowledge them; follow forks of the chain.

A call writes data files, builds the next manifest in memory and returns a batch of changes. ``ack`` replaces the manifest,
which is the commit. Until then nothing that a reader sees has changed, so a crash or a failed call needs no repair: files
that no manifest names are ignored, and the caller ingests again.

Raw rows, reducer snapshots and view partials are append-only segments; a rollback limits them to the fork's block. Views
are never stored: they are merged partials. A batch is worked out for the keys that it touches.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ddl.model import Column as Named
from ..ddl.model import External, Native, Reducer, Schema
from ..ddl.parser import parse, validate
from ..errors import InvalidOperation, PendingAck, Poisoned, RollbackError, WrongAckSequence
from ..operators import changes
from ..operators.reducers import STATE_JSON, Process, state_at
from ..sources.manifest import Manifest, Segment, Store
from ..sources.rows import host_rows
from .dataflow import plans_of, typed_rows


@dataclass(frozen=True)
class Cursor:
    number: int
    hash: str | None = None


@dataclass
class ChangeBatch:
    """Net changes by table or view; each a DataFrame with ``_op``, the key columns, values and ``_prev_`` values."""

    sequence: int
    finalized_head: Cursor
    latest_head: Cursor
    tables: dict[str, DataFrame]
    perf: list[tuple[str, float]] = field(default_factory=list)


class BlockProcess:
    """Code that takes a key's rows of a block at once."""

    by_block = True

    def __init__(self, process: Callable[[list[dict]], list[dict]]):
        self.process = process

    def __call__(self, state: dict, rows: list[dict]) -> list[dict]:
        (out,) = self.process([{"state": dict(state), "rows": rows}])
        state.clear()
        state.update(out["state"])
        return out.get("emits", [])


class Engine:
    def __init__(self, spark: SparkSession, schema: Schema | str, data_dir: str, code: dict[str, tuple[Process, tuple[Named, ...]]] | None = None, compact_after: int = 16, max_buffer: int = 1000):
        self.spark = spark
        self.schema = parse(schema) if isinstance(schema, str) else validate(schema)
        self.code = dict(code or {})
        self.compact_after, self.max_buffer = compact_after, max_buffer
        self.store = Store(spark, data_dir)
        self.manifest = self.store.read_manifest()
        self._pending: tuple[int, Manifest, ChangeBatch] | None = None
        self._pending_count = 0
        self._poisoned = False
        self._plans: tuple | None = None

    @classmethod
    def open(cls, spark: SparkSession, schema: Schema | str, data_dir: str, **options: Any) -> Engine:
        return cls(spark, schema, data_dir, **options)

    # introspection
    @property
    def latest_block(self) -> int:
        return self._state.latest

    @property
    def latest_cursor(self) -> Cursor:
        return Cursor(self._state.latest, self._state.latest_hash)

    @property
    def finalized_block(self) -> int:
        return self._state.finalized

    @property
    def finalized_cursor(self) -> Cursor:
        return Cursor(self._state.finalized, self._state.finalized_hash)

    @property
    def _state(self) -> Manifest:
        return self._pending[1] if self._pending else self.manifest

    @property
    def is_awaiting_ack(self) -> bool:
        return self._pending is not None

    @property
    def is_poisoned(self) -> bool:
        return self._poisoned

    @property
    def pending_count(self) -> int:
        """Blocks in the batch that waits for its acknowledgement."""
        return self._pending_count

    @property
    def pending_batch(self) -> ChangeBatch | None:
        """The batch that waits for its acknowledgement, for another delivery."""
        return self._pending[2] if self._pending else None

    def is_backpressured(self, most: int | None = None) -> bool:
        return self._pending_count >= (self.max_buffer if most is None else most)

    def has_reducer(self, name: str) -> bool:
        return name in self.schema.reducers

    def reducer_is_external(self, name: str) -> bool:
        return name in self.schema.reducers and isinstance(self.schema.reducers[name].body, External)

    def register_callback(self, name: str, process: Process, emits: Iterable[Named]) -> None:
        """Attach code to a reducer that the schema declares as external."""
        if name not in self.schema.reducers:
            raise InvalidOperation(f"unknown reducer {name!r}")
        if not self.reducer_is_external(name):
            raise InvalidOperation(f"reducer {name!r} has code of its own")
        if name in self.code:
            raise InvalidOperation(f"reducer {name!r} has a callback already")
        self.code[name], self._plans = (process, tuple(emits)), None

    def register_batch_callback(self, name: str, process: Callable[[list[dict]], list[dict]], emits: Iterable[Named]) -> None:
        """Attach code that gets a block's rows at once: ``[{"state": ..., "rows": [...]}]`` gives ``[{"state": ..., "emits":
        [...]}]``, one entry per key. The k-th emitted row belongs to the block's k-th row, those beyond to its last."""
        self.register_callback(name, BlockProcess(process), emits)

    def register_reducer(self, reducer: Reducer) -> ChangeBatch | None:
        """Add a reducer over a raw table after the schema was read. The rows stored so far are replayed into it."""
        if reducer.name in self.schema.reducers or reducer.name in self.schema.tables or reducer.name in self.schema.views:
            raise InvalidOperation(f"{reducer.name!r} is there already")
        if reducer.source not in self.schema.tables or not isinstance(reducer.body, Native):
            raise InvalidOperation("a reducer added later reads a raw table and is a Python function")
        self.schema.reducers[reducer.name], self._plans = reducer, None
        return self.replay(reducer.name)

    def replay(self, name: str) -> ChangeBatch | None:
        """Work out a reducer, and the reducers and views that read it, from all stored rows: for one that the rows so far never
        reached, because it or its code is new. Returns what that changes in its views."""
        self._gate()
        if name not in self.schema.reducers:
            raise InvalidOperation(f"unknown reducer {name!r}")
        _, views = self._dag()
        order, wanted = self.schema.reducer_order(), {name}
        for r in order:  # after their sources
            if r.source in wanted:
                wanted.add(r.name)
        read = {v for v, plan in views.items() if plan.view.source in wanted}
        after, tag = self.manifest.copy(), uuid.uuid4().hex
        stale = {f"{kind}/{n}" for kind, names in (("emits", wanted), ("snapshots", wanted), ("partials", read), ("times", read)) for n in names}
        after.segments = {k: v for k, v in after.segments.items() if k not in stale}
        source = self.schema.reducers[name].source
        rows = self._read(self.manifest, f"raw/{source}" if source in self.schema.tables else f"emits/{source}", "block_number")
        if rows is None:
            return None
        new, logs = {source: rows}, {}
        for r in order:
            if r.name in wanted:
                new[r.name] = self._reduce(r, new[r.source], after, tag, None)
        for v in read:
            plan = views[v]
            after.segments[f"partials/{v}"] = [self.store.write(plan.partials(new[plan.view.source]), f"partials/{v}", tag)]
            if plan.view.sliding:
                after.segments[f"times/{v}"] = [self.store.write(plan.block_times(new[plan.view.source]), f"times/{v}", tag)]
            then, now = self._view(self.manifest, v), self._view(after, v)
            logs[v] = changes.diff(now.limit(0) if then is None else then, now, plan.keys, plan.values)
        return self._deliver(after, logs, tag, [])

    def _dag(self):
        if self._plans is None:
            self._plans = plans_of(self.schema, self.code)
        return self._plans

    # data
    def _read(self, manifest: Manifest, name: str, block: str) -> DataFrame | None:
        return self.store.read(manifest.segments.get(name, []), block)

    def raw(self, table: str) -> DataFrame | None:
        """Stored rows of a table."""
        return self._read(self._state, f"raw/{table}", "block_number")

    def view(self, name: str) -> DataFrame | None:
        """What a view holds now."""
        return self._view(self._state, name)

    def _view(self, manifest: Manifest, name: str, keys: DataFrame | None = None) -> DataFrame | None:
        plan = self._dag()[1][name]
        partials = self._read(manifest, f"partials/{name}", "_block")
        if partials is None:
            return None
        spans = self._spans(manifest, name)
        if keys is not None:
            on = [F.col(f"p.`{k}`").eqNullSafe(F.col(f"t.`{k}`")) for k in plan.keys]
            partials = partials.alias("p").join(keys.alias("t"), on, "left_semi") if plan.keys else partials
        return plan.state(partials, spans)

    def _spans(self, manifest: Manifest, name: str) -> DataFrame | None:
        plan = self._dag()[1][name]
        if not plan.view.sliding:
            return None
        times = self._read(manifest, f"times/{name}", "_block").groupBy("_block").agg(F.max("_time").alias("_time"))
        for block, time_ in manifest.expired.get(name, []):
            times = times.where(~F.coalesce((F.col("_block") <= block) & (F.col("_time") < time_), F.lit(False)))
        return plan.spans(times)

    def _roll_back(self, after: Manifest, fork: int) -> None:
        """Forget the blocks after ``fork``. The watermark of a rolling view falls to that of the blocks that stay, but what has
        expired by now stays out."""
        after.cut(fork)
        for name, plan in self._dag()[1].items():
            if plan.view.sliding and (times := self._read(self.manifest, f"times/{name}", "_block")) is not None:
                if (mark := times.agg(F.max("_time")).first()[0]) is not None:
                    after.expire(name, fork, mark - plan.view.sliding.width_ms)

    # gates
    def _gate(self) -> None:
        if self._poisoned:
            raise Poisoned("an earlier commit failed; open the engine again")
        if self._pending:
            raise PendingAck(f"batch {self._pending[0]} waits for its acknowledgement")

    def ack(self, sequence: int) -> None:
        """Commit the pending batch. A second acknowledgement of a committed batch does nothing; if writing fails, the batch
        stays pending."""
        if self._pending is None:
            if sequence < self.manifest.next_sequence:
                return
            raise WrongAckSequence(f"no batch {sequence} is pending")
        if sequence != self._pending[0]:
            raise WrongAckSequence(f"batch {self._pending[0]} is pending, not {sequence}")
        self.store.write_manifest(self._pending[1])
        self.manifest, self._pending, self._pending_count = self._pending[1], None, 0

    # forks
    def resolve_fork_cursor(self, chain: Iterable[Cursor]) -> Cursor | None:
        """The highest block of ``chain`` that we have under the same hash."""
        state = self._state
        for c in sorted(chain, key=lambda c: -c.number):
            if c.number <= state.latest and (state.hashes.get(str(c.number)) == c.hash or c.number == state.finalized and c.hash == state.finalized_hash):
                return c
        return None

    def handle_fork(self, chain: Iterable[Cursor]) -> tuple[Cursor, ChangeBatch | None]:
        """Roll back to the highest block in common with ``chain``; returns it and the compensating changes."""
        self._gate()
        chain = list(chain)
        if not chain:
            raise InvalidOperation("an empty chain resolves no fork")
        cursor = self.resolve_fork_cursor(chain)
        if cursor is None:
            raise RollbackError("no block in common with the chain")
        self._check_depth(cursor.number)
        after = self.manifest.copy()
        self._roll_back(after, cursor.number)
        after.hashes |= {str(c.number): c.hash for c in chain if c.number <= cursor.number}
        return cursor, self._finish(after, {}, cursor.number, uuid.uuid4().hex)

    def _check_depth(self, fork: int) -> None:
        if fork < self.manifest.finalized:
            raise RollbackError(f"block {fork} lies below the finalized block {self.manifest.finalized}")

    def _inline_fork(self, chain: list[Cursor], finalized: Cursor | None) -> int | None:
        """The block that an ingest call must roll back to first, if its chain contradicts ours."""
        m = self.manifest
        heads = chain + ([finalized] if finalized else [])
        if not heads or not m.latest or any(c.number > m.latest for c in heads):
            return None
        own = m.hashes.get(str(m.latest))
        if any(c.number == m.latest and c.hash == own for c in heads):
            return None
        found = self.resolve_fork_cursor(heads)
        fork = found.number if found else 0
        return fork if fork < m.latest else None

    # ingest
    def ingest(self, data: Mapping[str, DataFrame | Iterable[Mapping[str, Any]]], rollback_chain: Iterable[Cursor] = (), finalized_head: Cursor | None = None) -> ChangeBatch | None:
        """Take in blocks of rows by table. Returns the net changes, or None if there are none (then all is committed)."""
        self._gate()
        if finalized_head and finalized_head.number < self.manifest.finalized:
            raise InvalidOperation(f"finalized block {finalized_head.number} lies below {self.manifest.finalized}")
        if unknown := [t for t in data if t not in self.schema.tables]:
            raise InvalidOperation(f"unknown table {unknown[0]!r}")
        chain = list(rollback_chain)
        after = self.manifest.copy()
        fork = self._inline_fork(chain, finalized_head)
        if fork is not None:
            self._check_depth(fork)
            self._roll_back(after, fork)
        rows, bounds, tag = {}, {}, uuid.uuid4().hex
        for name in sorted(data):
            table = self.schema.tables[name]
            given = data[name]
            typed = typed_rows(given, table.columns) if isinstance(given, DataFrame) else host_rows(self.spark, table, given)
            segment = self.store.write(typed, f"raw/{name}", tag)  # once: all that follows reads what was written
            found = self.store.read([segment], "block_number").agg(F.min("block_number"), F.max("block_number")).first()
            if found[0] is not None:
                rows[name], bounds[name] = segment, found
        if rows:
            lowest, highest = min(bounds[n][0] for n in rows), max(bounds[n][1] for n in rows)
            if lowest < 1:
                raise InvalidOperation("blocks are numbered from 1 on")
            if lowest <= after.latest:
                raise InvalidOperation(f"block {lowest} was ingested already; the latest is {after.latest}")
            after.latest = highest
        after.hashes |= {str(c.number): c.hash for c in chain}
        if finalized_head:
            after.finalized, after.finalized_hash = finalized_head.number, finalized_head.hash
            after.hashes |= {str(finalized_head.number): finalized_head.hash}
            after.hashes = {k: v for k, v in after.hashes.items() if int(k) >= after.finalized or int(k) == after.latest}
        after.latest_hash = after.hashes.get(str(after.latest), None)
        return self._finish(after, rows, fork, tag)

    def _finish(self, after: Manifest, rows: dict[str, Segment], fork: int | None, tag: str) -> ChangeBatch | None:
        """Write what follows from new raw segments, work out net changes, and commit or wait for the acknowledgement."""
        _, views = self._dag()
        perf, logs = [], {}

        def timed(what: str, run):
            began = time.perf_counter()
            out = run()
            perf.append((what, time.perf_counter() - began))
            return out

        def keep(name: str, df: DataFrame, block: str) -> DataFrame:
            segment = self.store.write(df, name, tag)
            after.segments.setdefault(name, []).append(segment)
            return self.store.read([segment], block)

        new: dict[str, DataFrame] = {}
        for name, table in self.schema.tables.items():
            columns = [c.name for c in table.columns if c.name != "block_number"]
            records = []
            if fork is not None and not table.virtual and (old := self._read(self.manifest, f"raw/{name}", "block_number")) is not None:
                records.append(changes.raw_deletes(old, columns, fork).withColumn("_order", F.lit(0)))
            if name in rows:
                after.segments.setdefault(f"raw/{name}", []).append(rows[name])
                new[name] = self.store.read([rows[name]], "block_number")
                if not table.virtual:
                    records.append(changes.raw_inserts(new[name], columns).withColumn("_order", F.lit(1)))
            if records:
                log = records[0] if len(records) == 1 else records[0].unionByName(records[1])
                prev = log.select("_op", "block_number", "_row_index", "_order", *columns, *(F.lit(None).cast(log.schema[c].dataType).alias(f"_prev_{c}") for c in columns))
                logs[name] = changes.merge(prev, ["block_number", "_row_index"], columns)
        for r in self.schema.reducer_order():
            if r.source not in new:
                continue
            new[r.name] = timed(f"reducer {r.name}", lambda r=r: self._reduce(r, new[r.source], after, tag, self._read(after, f"snapshots/{r.name}", "block_number")))
        for name, plan in views.items():
            log = timed(f"mv {name}", lambda name=name, plan=plan: self._view_changes(name, plan, after, new.get(plan.view.source), fork, keep))
            if log is not None:
                logs[name] = log
        return self._deliver(after, logs, tag, perf)

    def _reduce(self, r: Reducer, rows: DataFrame, after: Manifest, tag: str, held: DataFrame | None) -> DataFrame:
        """Run a reducer over new rows from the states that ``held`` snapshots end in, and keep what it emits and its states."""
        states = state_at(held, list(r.group_by)) if held is not None else None

        def stored(segments: dict[str, Segment]) -> dict[str, DataFrame]:
            for kind, segment in segments.items():
                after.segments.setdefault(f"{kind}/{r.name}", []).append(segment)
            return {kind: self.store.read([segment], "block_number") for kind, segment in segments.items()}

        folds = []

        def write(both: DataFrame) -> tuple[DataFrame, DataFrame]:
            kind = F.when(F.col(STATE_JSON).isNull(), "emits").otherwise("snapshots")
            folds.append(stored(self.store.write_parts(both, kind, ("emits", "snapshots"), r.name, tag)))
            return folds[0]["emits"], folds[0]["snapshots"]

        out, snapshots = self._dag()[0][r.name].run(rows, states, write)
        if folds:
            return out
        if snapshots is not None:
            stored({"snapshots": self.store.write(snapshots, f"snapshots/{r.name}", tag)})
        return stored({"emits": self.store.write(out, f"emits/{r.name}", tag)})["emits"]

    def _deliver(self, after: Manifest, logs: dict[str, DataFrame], tag: str, perf: list[tuple[str, float]]) -> ChangeBatch | None:
        """Write the net changes, and commit, or wait for the acknowledgement if there are any."""
        written = {}
        for name, log in logs.items():
            began = time.perf_counter()
            df = self.store.read([self.store.write(log, f"changes/{name}", tag)], "_op")
            perf.append((f"changes {name}", time.perf_counter() - began))
            if not df.isEmpty():
                written[name] = df
        self._compact(after, tag)
        blocks = max(0, after.latest - self.manifest.latest)
        if not written:
            try:
                self.store.write_manifest(after)
            except Exception:
                self._poisoned = True
                raise
            self.manifest = after
            return None
        sequence = after.next_sequence
        after.next_sequence += 1
        batch = ChangeBatch(sequence, Cursor(after.finalized, after.finalized_hash), Cursor(after.latest, after.latest_hash), written, perf)
        self._pending, self._pending_count = (sequence, after, batch), blocks
        return batch

    def _view_changes(self, name, plan, after: Manifest, rows: DataFrame | None, fork: int | None, keep) -> DataFrame | None:
        """Net changes of a view: those of the rollback, then those of each new block."""
        if rows is not None:
            fresh = keep(f"partials/{name}", plan.partials(rows), "_block")
            if plan.view.sliding:
                keep(f"times/{name}", plan.block_times(rows), "_block")
        before = self._read(self.manifest, f"partials/{name}", "_block")
        logs = []
        if fork is not None and before is not None:
            lost = before.where(F.col("_block") > fork)
            touched = None if plan.view.sliding or not plan.keys else lost.select(*plan.keys).distinct()
            cut = self.manifest.copy()
            cut.cut(fork)
            cut.expired = after.expired
            then = self._view(cut, name, touched)
            logs.append(changes.diff(self._view(self.manifest, name, touched), then, plan.keys, plan.values).withColumn("_order", F.lit(fork).cast("long")))
        if rows is not None:
            everything = self._read(after, f"partials/{name}", "_block")
            base = (fork if fork is not None else self.manifest.latest)
            if plan.view.sliding:
                spans = self._spans(after, name)
                live = spans.where(F.col("_end").isNull() | (F.col("_end") > base))
                log = plan.changelog(everything.join(live.select("_block"), "_block", "left_semi"), live)
            else:
                if plan.keys:
                    touched = fresh.select(*plan.keys).distinct()
                    on = [F.col(f"p.`{k}`").eqNullSafe(F.col(f"t.`{k}`")) for k in plan.keys]
                    everything = everything.alias("p").join(touched.alias("t"), on, "left_semi")
                    everything = plan.compact(everything, base)  # what lies before the batch is one row per key
                log = plan.changelog(everything)
            logs.append(log.where(F.col("_block") > base).withColumnRenamed("_block", "_order"))
        if not logs:
            return None
        whole = logs[0] if len(logs) == 1 else logs[0].unionByName(logs[1])
        return changes.merge(whole, plan.keys, plan.values)

    def _merge(self, after: Manifest, key: str, block: str, tag: str) -> None:
        """Make one segment of ``compact_after`` of the same level: a row is written again as often as the number of segments has
        digits, and the manifest stays short."""
        level = 0
        while len(same := [s for s in after.segments[key] if s.level == level]) > self.compact_after:
            merged = self.store.write(self.store.read(same, block), key, f"{tag}-{level + 1}")
            merged.level = level + 1
            after.segments[key] = [*(s for s in after.segments[key] if s.level != level), merged]
            level += 1

    def _compact(self, after: Manifest, tag: str) -> None:
        """Merge the finalized part of views and states once they lie in many segments."""
        _, views = self._dag()
        for key in [k for k in after.segments if k.split("/")[0] in ("raw", "emits", "times")]:
            self._merge(after, key, "_block" if key.startswith("times/") else "block_number", tag)
        for name, plan in views.items():
            key = f"partials/{name}"
            if not plan.view.sliding and len(after.segments.get(key, [])) > self.compact_after:
                after.segments[key] = [self.store.write(plan.compact(self._read(after, key, "_block"), min(after.finalized, after.latest)), key, f"{tag}-compact")]
        for r in self.schema.reducers.values():
            key = f"snapshots/{r.name}"
            if len(after.segments.get(key, [])) > self.compact_after:
                held = self._read(after, key, "block_number").select(*r.group_by, "block_number", STATE_JSON)
                f = min(after.finalized, after.latest)
                old = held.where(F.col("block_number") <= f).groupBy(*r.group_by).agg(F.max("block_number").alias("block_number"), F.max_by(STATE_JSON, "block_number").alias(STATE_JSON))
                after.segments[key] = [self.store.write(old.unionByName(held.where(F.col("block_number") > f)), key, f"{tag}-compact")]

