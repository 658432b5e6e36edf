"""Chat formatting with minimum-cost role repair.

A legal conversation runs: system at most once and first, then user and assistant in turn, user first, assistant last. A
repair may relabel a turn, merge it into the turn before it, or insert empty turns; each has a cost. For a turn's role the
cheapest way from one state of the automaton to another is a small matrix of costs, so a stretch of turns is a product of
matrices in (min, +), and a conversation's cheapest repair is found by dynamic programming over its turns.

Turns are range-partitioned by conversation and turn and sorted; a task repairs the conversations that it holds whole. Of a
conversation that crosses a task's edge it sends the stretch's matrix (sixteen numbers) and its turns' number; the driver
chains these, two at most per task, and tells each task the states that its stretch begins and ends in and the turns before
it. So no conversation, however long, needs to fit in one task.

What comes out is one row per turn, and one per inserted turn, with the piece of rendered text that it adds: the pieces of
a conversation, joined by position, are its rendering.

Ties between repairs go to a turn of its own rather than a merged one, then, from the conversation's end backwards, to the
state that comes first in the order start, system, user, assistant. Defined results: texts of any length are rendered whole; a null role, or one that is none of the three, is relabelled at the price of any relabelling; roles are
compared in lower case without blanks around them; a null text is empty; turns with equal numbers are ordered by role, then
text, null turns first; repeated rows are turns of their own; rows without a conversation id form one conversation; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, id_back, id_key, shuffle_partitions, table

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)  # states: the role of the last turn
#: What may follow each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = ASSISTANT


@dataclass(frozen=True)
class Costs:
    relabel: int = 3
    merge: int = 1
    insert: int = 4


def _between(state: int, role: int) -> list[int] | None:
    """The fewest roles to insert so that ``role`` may follow ``state``."""
    paths: list[list[int]] = [[]]
    for _ in range(4):
        for path in paths:
            if role in NEXT[path[-1] if path else state]:
                return path
        paths = [[*p, n] for p in paths for n in NEXT[p[-1] if p else state]]
    return None


#: For each pair (state, next state): the inserted roles before a new turn; None if there is no way.
INSERTS = {(a, b): _between(a, b) for a in range(4) for b in (SYSTEM, USER, ASSISTANT)}
ENDINGS = {a: [] if a == FINAL else [*_between(a, FINAL), FINAL] for a in range(4)}


def step(role: int, costs: Costs) -> tuple[np.ndarray, dict[tuple[int, int], bool]]:
    """Costs from state to state over one turn (``role``: its state, or START if it is none), and where it is merged."""
    out, merged = np.full((4, 4), np.inf), {}
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            change = 0 if b == role else costs.relabel
            ways = []
            if INSERTS[a, b] is not None:
                ways.append((change + costs.insert * len(INSERTS[a, b]), False))
            if a == b:
                ways.append((change + costs.merge, True))
            if ways:
                out[a, b], merged[a, b] = min(ways)
    return out, merged


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).min(axis=1)


class Repair:
    def __init__(self, costs: Costs):
        self.costs = costs
        self.steps = [step(role, costs) for role in range(4)]
        self.end = np.array([costs.insert * len(ENDINGS[a]) for a in range(4)], dtype=float)

    def matrix(self, roles: list[int]) -> np.ndarray:
        out = np.where(np.eye(4, dtype=bool), 0, np.inf)
        for r in roles:
            out = _product(out, self.steps[r][0])
        return out

    def states(self, roles: list[int], begin: int, end: int | None) -> list[int]:
        """The cheapest states after each turn, from ``begin`` to ``end``, or to the cheapest end of a conversation."""
        best, back = np.full(4, np.inf), []
        best[begin] = 0
        for r in roles:
            ways = best[:, None] + self.steps[r][0]
            back.append(ways.argmin(axis=0))
            best = ways.min(axis=0)
        state = int((best + self.end).argmin()) if end is None else end
        out = []
        for pointers in reversed(back):
            out.append(state)
            state = int(pointers[state])
        return out[::-1]


def role_state(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) + 1 if role in ROLES else START


OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"


def piece(role: int, text: str, merged: bool, first: bool) -> str:
    """What a turn adds to the rendering: unless it is merged it closes the turn before it, if there is one, and opens its
    own. The last turn of a conversation is closed where that is known."""
    return ("\n" if merged else ("" if first else CLOSE) + OPEN.format(ROLES[role - 1])) + text


def _edges(turns: DataFrame, repair: Repair) -> dict[int, dict[int, tuple[int, int | None, int]]]:
    """For the conversations that cross tasks: by conversation and task, the states a stretch begins and ends in (None: the
    end of the conversation), and the turns before it."""

    def matrices(batches):
        from pyspark import TaskContext

        kept: list[tuple[int, list[int]]] = []  # conversation and roles: the task's first, and the current one
        for batch in batches:
            for conv, group in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), key=lambda x: x[0]):
                roles = [role_state(r) for _, r in group]
                if kept and kept[-1][0] == conv:
                    kept[-1][1].extend(roles)
                else:
                    kept = [*kept[:1], (conv, roles)]
        task = TaskContext.get().partitionId()
        rows = [{"task": task, "conv": c, "m": repair.matrix(roles).ravel().tolist(), "n": len(roles)} for c, roles in kept]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("task", pa.int32()), ("conv", pa.int64()), ("m", pa.list_(pa.float64())), ("n", pa.int64())]))

    by: dict[int, list] = {}
    for r in sorted(turns.select("conv", "role").mapInArrow(matrices, "task int, conv long, m array<double>, n long").collect(), key=lambda r: r.task):
        by.setdefault(r.conv, []).append(r)
    out: dict[int, dict[int, tuple[int, int | None, int]]] = {}
    for conv, parts in by.items():
        if len(parts) < 2:
            continue
        ahead = [np.where(np.arange(4) == START, 0, np.inf)]
        for p in parts:
            ahead.append((ahead[-1][:, None] + np.array(p.m).reshape(4, 4)).min(axis=0))
        state = int((ahead[-1] + repair.end).argmin())
        ends = [state]
        for k in range(len(parts) - 1, 0, -1):
            state = int((ahead[k] + np.array(parts[k].m).reshape(4, 4)[:, state]).argmin())
            ends.append(state)
        ends = ends[::-1]
        turns_before = [0, *np.cumsum([p.n for p in parts]).tolist()]
        out[conv] = {p.task: (START if k == 0 else ends[k - 1], None if k + 1 == len(parts) else ends[k], turns_before[k]) for k, p in enumerate(parts)}
    return out


def repair_chats(chats: DataFrame, costs: Costs = Costs(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, place, part, action, role, cost, piece): ``place`` (turns before it in its conversation) orders the
    turns; ``part`` orders a turn (0) after the turns inserted before it (below 0) and before those
    at the conversation's end (above 0)."""
    repair = Repair(costs)
    order = ["conv", "turn_at", "role", "text"]
    rows = chats.select(id_key(chats, conv_col).alias("conv"), id_key(chats, turn_col).alias("turn_at"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sort = ["conv", "turn_at", F.asc_nulls_first("role"), "text"]
    turns = cut(rows.select(*order).repartitionByRange(shuffle_partitions(chats.sparkSession), *sort).sortWithinPartitions(*sort))
    crossing = _edges(turns, repair)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[tuple] = []

        def settle(group: list[tuple]) -> list[tuple]:
            conv = group[0][0]
            begin, end, ahead = crossing.get(conv, {}).get(task, (START, None, 0))
            roles = [role_state(r) for _, _, r, _ in group]
            states, out, before = repair.states(roles, begin, end), [], begin
            merged = []
            for r, s in zip(roles, states, strict=True):
                merged.append(repair.steps[r][1][before, s])
                before = s
            before = begin
            for k, ((_, turn, _, text), r, s) in enumerate(zip(group, roles, states, strict=True)):
                at = ahead + k
                added = [] if merged[k] else INSERTS[before, s]
                first = begin == START and not k
                for j, x in enumerate(added):
                    out.append((conv, turn, at, j - len(added), "insert", ROLES[x - 1], costs.insert, piece(x, "", False, first and not j)))
                price = (0 if r == s else costs.relabel) + costs.merge * merged[k]
                action = "+".join([*["merge"] * merged[k], *["relabel"] * (r != s)]) or "keep"
                out.append((conv, turn, at, 0, action, ROLES[s - 1], price, piece(s, text, merged[k], first and not added)))
                before = s
            if end is None:
                out += [(conv, group[-1][1], ahead + len(group) - 1, 1 + j, "insert", ROLES[x - 1], costs.insert, piece(x, "", False, False)) for j, x in enumerate(ENDINGS[before])]
                out[-1] = (*out[-1][:-1], out[-1][-1] + CLOSE)
            return out

        names = ["conv", "turn", "place", "part", "action", "role", "cost", "piece"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            done: list[tuple] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and held[0][0] != row[0]:
                    done += settle(held)
                    held = []
                held.append(row)
            if done:
                yield batch_of(done)
        if held:
            yield batch_of(settle(held))

    found = turns.mapInArrow(run, "conv long, turn long, place long, part int, action string, role string, cost int, piece string")
    return found.select(id_back("conv").alias("conv_id"), id_back("turn").alias("turn"), "place", "part", "action", "role", "cost", "piece")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, repaired and rendered."""
    return repair_chats(table(spark, sf_dir, "conversations"))
