"""Removing lines that many documents repeat.

Every eligible line becomes a row (hash of its key, document, position). The rows are range-partitioned by hash, document
(largest first) and position and sorted in that order, so a frequent line is spread over as many tasks as it needs. Each
task streams its rows: the first document of a run of equal hashes keeps its lines, the others lose theirs if the run has
enough documents. A run that crosses a task's edge is settled by a table of the first and last run of every task, at most
two rows each. What returns is a compressed keep bitmap per document, no text.

Defined results: null and empty texts are one empty line; a document is an id, so repeated rows of an id count once and
fare alike; null ids count as one document below all others; an empty table gives an empty result; other columns are not
read by the decisions and kept by :func:`drop_lines`.
"""

from __future__ import annotations

import hashlib
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, id_key, map_texts, shuffle_partitions, slices, table, unused

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: str) -> bytes:
    """The line without blanks at its ends, A to Z in lower case, as UTF-8."""
    return line.strip(BLANKS).encode().lower()  # bytes.lower() knows A to Z only


def _rows(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    def make():
        from xxhash import xxh3_128_digest

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, own, places, counts = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                lines = text.split("\n")
                for k, line in enumerate(lines):
                    if len(line) >= min_chars and len(line.strip(BLANKS)) >= min_chars:
                        keys.append(xxh3_128_digest(line_key(line)))
                        own.append(i)
                        places.append(k)
                        counts.append(len(lines))
            hashes = np.frombuffer(b"".join(keys), dtype=">i8").astype(np.int64).reshape(-1, 2)
            rows = pa.array(own, pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(places, pa.int32()), pa.array(counts, pa.int32())],
                names=["h1", "h2", "doc", "version", "pos", "n_lines"],
            )

        return work

    text = F.coalesce(F.col(text_col), F.lit(""))
    return map_texts(docs, [id_key(docs, id_col).alias("doc"), F.xxhash64(text).alias("version"), text], make, "h1 long, h2 long, doc long, version long, pos int, n_lines int")


def _runs(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray):
    """Starts of the runs of equal hashes, and the rows that begin another document within their run."""
    begins = np.ones(len(h1), dtype=bool)
    begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    fresh = begins.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    return np.flatnonzero(begins), fresh


def _edges(rows: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """(documents, keeper) of every hash that is the first or last of a task."""

    def edges(batches):
        from pyspark import TaskContext

        kept: list[list[int]] = []  # [h1, h2, documents, first document, last document] of the first and of the current run
        for batch in batches:
            h1, h2, doc = (batch.column(k).to_numpy() for k in range(3))
            if not len(h1):
                continue
            starts, fresh = _runs(h1, h2, doc)
            documents, ends = np.add.reduceat(fresh, starts), [*starts[1:], len(h1)]
            for k in sorted({0, len(starts) - 1}):
                s, run = starts[k], [int(h1[starts[k]]), int(h2[starts[k]]), int(documents[k]), int(doc[starts[k]]), int(doc[ends[k] - 1])]
                if s == 0 and kept and kept[-1][:2] == run[:2]:
                    kept[-1][2] += run[2] - (kept[-1][4] == run[3])
                    kept[-1][4] = run[4]
                else:
                    kept = [*kept[:1], run]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("task", "k", "h1", "h2", "n", "first", "last"), (task, k, *run), strict=True)) for k, run in enumerate(kept)],
            schema=pa.schema([("task", pa.int32()), ("k", pa.int32()), *((c, pa.int64()) for c in ("h1", "h2", "n", "first", "last"))]),
        )

    found: dict[tuple[int, int], list[int]] = {}
    for r in sorted(rows.select("h1", "h2", "doc").mapInArrow(edges, "task int, k int, h1 long, h2 long, n long, first long, last long").collect()):
        if have := found.get((r.h1, r.h2)):
            have[0] += r.n - (have[2] == r.first)
            have[2] = r.last
        else:
            found[r.h1, r.h2] = [r.n, r.first, r.last]
    return {k: (n, keeper) for k, (n, keeper, _) in found.items()}


def _dropped(rows: DataFrame, min_docs: int) -> DataFrame:
    """The rows whose lines go."""
    known = _edges(rows)

    def settle(batches):
        held: pa.RecordBatch | None = None  # the unfinished last run

        def decide(batch: pa.RecordBatch) -> pa.RecordBatch:
            h1, h2, doc = (batch.column(k).to_numpy() for k in range(3))
            starts, fresh = _runs(h1, h2, doc)
            documents, keepers = np.add.reduceat(fresh, starts), doc[starts].copy()
            for k in (0, len(starts) - 1):
                if fact := known.get((int(h1[starts[k]]), int(h2[starts[k]]))):
                    documents[k], keepers[k] = fact
            lengths = np.diff([*starts, len(h1)])
            gone = np.repeat(documents >= min_docs, lengths) & (np.repeat(keepers, lengths) != doc)
            return batch.filter(pa.array(gone)).select(["doc", "version", "pos", "n_lines"])

        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = None
            if not batch.num_rows:
                continue
            h1, h2, doc = (batch.column(k).to_numpy() for k in range(3))
            last = int(_runs(h1, h2, doc)[0][-1])
            if (int(h1[last]), int(h2[last])) in known:  # settled already, so no rows need wait
                last = batch.num_rows
            if last:
                yield decide(batch.slice(0, last))
            if last < batch.num_rows:
                held = batch.slice(last)
        if held is not None:
            yield decide(held)

    return rows.mapInArrow(settle, "doc long, version long, pos int, n_lines int")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, n_lines, n_dropped, bitmap) of the documents that lose lines: the bits of the lines that stay, first
    line first, packed and deflated. ``version`` is the hash of the text that the bitmap belongs to."""
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("pos")]
    parts = shuffle_partitions(docs.sparkSession)
    rows = cut(_rows(docs, min_chars, id_col, text_col).repartitionByRange(parts, *order).sortWithinPartitions(*order))
    gone = _dropped(rows, min_docs).groupBy("doc", "version").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))

    def bitmaps(batches):
        for batch in batches:
            lines, gone = batch.column(2).to_pylist(), batch.column(3)
            packed = []
            for n, at in zip(lines, gone, strict=True):
                keep = np.ones(n, dtype=bool)
                keep[at.values.to_numpy()] = False
                packed.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.compute.list_value_length(gone), pa.array(packed, pa.binary())], names=["doc", "version", "n_lines", "n_dropped", "bitmap"])

    return gone.select("doc", "version", "n_lines", "gone").mapInArrow(bitmaps, "doc long, version long, n_lines int, n_dropped int, bitmap binary")


def kept_text(text: str, bitmap: bytes | None) -> str:
    if bitmap is None:
        return text
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=len(lines))
    return "\n".join([x for x, k in zip(lines, keep, strict=True) if k])


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` and, in a last column, a struct of what is known of their lines (null: all stay)."""
    own, lines = unused(docs, "key"), unused(docs, "lines")
    inner = bitmaps.select(F.struct("doc", "version").alias(own), F.struct("n_dropped", "bitmap").alias(lines))
    key = F.struct(id_key(docs, id_col).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("version"))
    return docs.withColumn(own, key).join(inner, own, "left").select(*(F.col(f"`{c}`") for c in (*docs.columns, lines)))


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts; texts that lose none, null ones too, stay as they are."""
    joined = _with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs, id_col, text_col), id_col, text_col)
    place = joined.columns.index(text_col)

    def cut_lines(batches):
        for whole in batches:
            for batch in slices(whole, place):
                texts, maps = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).field("bitmap").to_pylist()
                new = pa.array([t if b is None else kept_text(t, b) for t, b in zip(texts, maps, strict=True)], pa.string())
                columns = [new if k == place else batch.column(k) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(cut_lines, docs.schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that 5 ``documents`` share, dropped from all but the largest id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = _with_bitmaps(docs, keep_bitmaps(docs), "doc_id", "text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, lines = batch.column(2).to_pylist(), batch.column(1)
            kept = [kept_text(t, b) for t, b in zip(texts, lines.field("bitmap").to_pylist(), strict=True)]
            columns = [
                batch.column(0),
                pa.array([t.count("\n") + 1 for t in texts], pa.int64()),
                pa.array([n or 0 for n in lines.field("n_dropped").to_pylist()], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in kept], pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

        return work

    return map_texts(joined, [F.col("doc_id"), F.col(joined.columns[-1]), F.col("text")], make, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
b AS (SELECT key AS gone_key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.doc_id, line, pos, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN b ON key = gone_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
