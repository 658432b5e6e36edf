"""Best-fit packing of documents into training sequences of limited length.

Vector best fit: a sequence has three capacities, tokens, documents and attention cost (the sum of the squared lengths
of its pieces). A piece goes to an open sequence that can take it under every capacity: the one that it leaves with the
smallest weighted residual norm (rule ``norm``), or the one whose residual has the largest weighted dot product with the
piece's demand (rule ``dot``). Longer pieces go first.

The choice depends on lengths only, and a length is at most the token capacity. So the driver gets a histogram of lengths
(as many rows as a sequence has tokens, whatever the input's size), packs whole length classes into classes of equally
filled sequences, and returns a plan of segments: "items number a to b of length n go, q each, to sequences number x to
y, from offset o". Each task then looks up its own pieces in the plan. A piece's number within its length is its number
within its task plus the counts of the tasks before; a frequent length is no hot group.

Defined results: a null or empty text is one piece that holds the separator only; a text that does not fit is cut into
full pieces, and only its first piece may be shorter; repeated rows are packed as often as they come; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_texts, table
from .tokens import Encoder


@dataclass(frozen=True)
class Capacities:
    """Limits of one sequence; documents and attention cost default to what the tokens allow at most."""

    tokens: int
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.int64)


def demand(length: int) -> np.ndarray:
    return np.array([length, 1, length * length], dtype=np.int64)


def plan_bins(histogram: dict[int, int], capacities: Capacities, weights=(1.0, 1.0, 1.0), rule: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first item, items per sequence, sequences, first sequence, offset) for ``histogram``.

    Classes of sequences with equal residuals are handled at once, so the work depends on the number of lengths and not
    on the number of items.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    limit, weight = capacities.vector(), np.asarray(weights, dtype=float)
    residuals = np.empty((64, 3), dtype=np.int64)
    open_: list[list[tuple[int, int]]] = []  # by class: intervals (first sequence, sequences)
    number: dict[tuple[int, ...], int] = {}
    made, plan = 0, []

    def put(residual: np.ndarray, first: int, many: int) -> None:
        nonlocal residuals
        key = tuple(residual.tolist())
        if key not in number:
            number[key] = len(open_)
            open_.append([])
            if len(open_) > len(residuals):
                residuals = np.concatenate([residuals, np.empty_like(residuals)])
            residuals[number[key]] = residual
        open_[number[key]].append((first, many))

    def deal(residual: np.ndarray, first: int, many: int, length: int, done: int, left: int) -> int:
        """Put up to ``left`` items into ``many`` equal sequences; returns how many went in."""
        need = demand(length)
        most = int((residual // need).min()) if rule == "norm" else 1
        offset, at = int(limit[0] - residual[0]), first
        went = 0
        for each, count in ((most, min(many, left // most)), (left % most, 1)):
            if each and count and at + count <= first + many and went + each * count <= left:
                plan.append((length, done + went, each, count, at, offset))
                put(residual - each * need, at, count)
                went, at = went + each * count, at + count
        if at < first + many:
            put(residual, at, first + many - at)
        return went

    for length in sorted(histogram, reverse=True):
        need, left, done = demand(length), histogram[length], 0
        if (need > limit).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            have = residuals[: len(open_)]
            fits = np.flatnonzero((have >= need).all(axis=1) & np.fromiter((bool(x) for x in open_), bool, len(open_)))
            if len(fits):
                share = (have[fits] - need * (rule == "norm")) / limit
                score = (weight * share**2).sum(axis=1) if rule == "norm" else -(weight * share * (need / limit)).sum(axis=1)
                best = int(fits[np.argmin(score)])
                first, many = open_[best].pop()
                went = deal(have[best].copy(), first, many, length, done, left)
            else:
                most = int((limit // need).min())
                many = -(-left // most)
                if rule == "dot":  # one item each would open too many: fill new sequences in turn
                    many = 1 if most > 1 else left
                went = deal(limit.copy(), made, many, length, done, left)
                made += many
            left, done = left - went, done + went
    return plan


def _pieces(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: all full but the first."""
    head = n % most or most
    return [(0, head), *((s, most) for s in range(head, n, most))]


def tokenize(docs: DataFrame, path: str, pattern: str, tokens: int, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece, with its task and its number among the pieces of its length in that task."""

    def make():
        from pyspark import TaskContext

        encode, seen, task = Encoder(path, pattern), np.zeros(tokens + 1, dtype=np.int64), TaskContext.get().partitionId()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[list] = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text), separator], dtype="<u4")
                for k, (start, length) in enumerate(_pieces(len(ids), tokens)):
                    part = ids[start : start + length]
                    for column, value in zip(rows, (doc, k, start, length, zlib.crc32(part.tobytes()), task, int(seen[length]), part.tobytes() if with_ids else None), strict=True):
                        column.append(value)
                    seen[length] += 1
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [F.col(id_col).alias("doc_id"), F.col(text_col)], make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, number long, ids binary")


def pack(pieces: DataFrame, capacities: Capacities, weights=(1.0, 1.0, 1.0), rule: str = "norm") -> DataFrame:
    """Give each row of :func:`tokenize` its ``sequence_id`` and ``offset``."""
    pieces = cut(pieces)
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_number"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row per length
    by_length: dict[int, np.ndarray] = {}
    plan = np.array(plan_bins(histogram, capacities, weights, rule), dtype=np.int64).reshape(-1, 6)
    for length in histogram:
        mine = plan[plan[:, 0] == length]
        by_length[length] = mine[np.argsort(mine[:, 1], kind="stable"), 1:]
    at = pieces.sparkSession.sparkContext.broadcast(by_length)  # rows: a few per length

    def assign(batches):
        for batch in batches:
            lengths, numbers = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                segments = at.value[int(length)]
                row = segments[np.searchsorted(segments[:, 0], numbers[own], side="right") - 1]
                place = numbers[own] - row[:, 0]
                sequence[own] = row[:, 3] + place // row[:, 1]
                offset[own] = row[:, 4] + place % row[:, 1] * length
            arrays = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence), pa.array(offset), batch.column("ids")], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])

    numbered = pieces.join(starts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("first_number")).alias("number"), "ids")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(assign, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ids (little-endian unsigned 32-bit) and where each piece starts."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"),
        F.expr("transform(parts, p -> struct(p.offset, p.doc_id, p.piece))").alias("pieces"),
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), Capacities(2048)).drop("ids")


def pack_documents(docs: DataFrame, capacities: Capacities, with_ids: bool = False) -> DataFrame:
    import public_tokenizers

    pieces = tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, capacities.tokens, with_ids=with_ids)
    return pack(pieces, capacities)
