"""Exact top-k inner products by a pivot-distance index.

Components are scaled and floored to integers, so scores are exact. With one more component sqrt(M^2 - |x|^2) for the rows
and 0 for the queries, M the largest norm, the rows nearest to a query are those with the largest inner products. Each row
is keyed by its nearest pivot and its distance to it; a pivot's rows, sorted by distance, are cut into rings. The triangle
inequality bounds the score of a whole ring from its distances, so rings are expanded from the most promising on:

1. every query searches the ring with the best bound, and the next ones until k rows are seen, which gives its k-th score;
2. it then searches the rings whose bound reaches that score, and stops there: no other ring can hold a better row.

Pivots grow with the square root of the rows up to a limit, so that rings get finer and the table of rings stays bounded. A ring's rows
and the queries that meet it are both cut into blocks, and a task multiplies one block of rows with one block of queries.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors are padded with
zeros; ties go to the smaller id; repeated ids are rows of their own, so that a row never answers a query of its own id;
all rows of a query's id are searched, and its k results are the best of all their scores, as in the SQL; fewer than k others give fewer rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table


@dataclass(frozen=True)
class Settings:
    """``pivots``: 0 for a number that grows with the square root of the rows, from 16 to 256. ``sample`` bounds the rows that
    they are drawn from."""

    k: int = 5
    scale: int = 256
    pivots: int = 0
    rings: int = 8
    block: int = 4096
    queries: int = 1024
    sample: int = 4096


def _clean(vectors: DataFrame, s: Settings, id_col: str, vector_col: str) -> DataFrame:
    """(id, x: integer components) of the rows that take part."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * s.scale).cast("double"))
    return vectors.where(v.isNotNull() & F.col(id_col).isNotNull() & whole & (F.size(v) > 0)).select(F.col(id_col).cast("long").alias("id"), ints.alias("x"))


def matrix(rows: pd.Series, size: int) -> np.ndarray:
    """Vectors as rows of doubles, padded with zeros."""
    out = np.zeros((len(rows), size))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products. Doubles hold them while their size allows, Python's integers beyond."""
    bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if bound < 2**52:
        return (queries @ rows.T).astype(np.int64)
    return np.array([[sum(int(a) * int(b) for a, b in zip(q, r, strict=True)) for r in rows] for q in queries], dtype=np.int64).reshape(len(queries), len(rows))


@dataclass(frozen=True)
class Index:
    """Pivots (with the added component), the largest squared norm, and the distances of every ring."""

    pivots: np.ndarray
    top: float
    size: int
    near: np.ndarray  # pivots x rings: the least distance in a ring, inf where it is empty
    far: np.ndarray
    counts: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))])

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Upper bounds (queries x rings) of the scores in each ring."""
        square = (x * x).sum(axis=1)
        q = np.column_stack([x, np.zeros(len(x))])
        d = np.sqrt(np.maximum(square[:, None] + (self.pivots**2).sum(axis=1) - 2 * q @ self.pivots.T, 0))[:, :, None]
        low = np.maximum(np.maximum(d - self.far, self.near - d), 0)
        with np.errstate(invalid="ignore"):
            best = (square[:, None, None] + self.top - low**2) / 2
        slack = 1e-6 * (square[:, None, None] + self.top) + 1e-3  # rounding of distances must not lose a row
        return np.where(self.counts > 0, best + slack, -np.inf).reshape(len(x), -1)


def _distances(x: np.ndarray, top: float, pivots: np.ndarray) -> np.ndarray:
    lifted = np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))])
    return np.sqrt(np.maximum((lifted**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * lifted @ pivots.T, 0))


def build_index(rows: DataFrame, s: Settings) -> tuple[DataFrame, Index] | None:
    """(id, x, ring: number among all rings, part: block of the ring) of every row, and the index; None for no rows."""
    facts = rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)).alias("top"), F.max(F.size("x")).alias("size"), F.count(F.lit(1)).alias("n")).first()
    if facts.size is None:
        return None
    top, size = float(facts.top), int(facts.size)
    drawn = rows.select("x").distinct().orderBy(F.xxhash64("x"), F.to_json("x")).limit(s.sample).toPandas()
    sample = matrix(drawn["x"], size)
    lifted = np.column_stack([sample, np.sqrt(np.maximum(top - (sample**2).sum(axis=1), 0))])
    chosen, gap = [0], ((lifted - lifted[0]) ** 2).sum(axis=1)
    wanted = s.pivots or min(256, max(16, math.isqrt(facts.n) // 14))
    while len(chosen) < min(wanted, len(lifted)):  # farthest first
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((lifted - lifted[chosen[-1]]) ** 2).sum(axis=1))
    pivots = lifted[chosen]
    distances = _distances(sample, top, pivots)
    edges = np.full((len(pivots), s.rings - 1), np.inf)
    for p in range(len(pivots)):
        own = distances[distances.argmin(axis=1) == p, p]
        if len(own):
            edges[p] = np.quantile(own, np.arange(1, s.rings) / s.rings)

    def key(batches):
        for batch in batches:
            d = _distances(matrix(batch["x"], size), top, pivots)
            pivot = d.argmin(axis=1)
            at = d[np.arange(len(d)), pivot]
            ring = (edges[pivot] < at[:, None]).sum(axis=1)
            yield pd.DataFrame({"id": batch["id"], "x": batch["x"], "ring": pivot * s.rings + ring, "distance": at})

    keyed = cut(rows.mapInPandas(key, "id long, x array<double>, ring int, distance double"))
    near, far, counts = (np.full(len(pivots) * s.rings, v) for v in (np.inf, -np.inf, 0.0))
    for r in keyed.groupBy("ring").agg(F.min("distance").alias("a"), F.max("distance").alias("b"), F.count(F.lit(1)).alias("n")).collect():  # at most pivots x rings
        near[r.ring], far[r.ring], counts[r.ring] = r.a, r.b, r.n
    shape = (len(pivots), s.rings)
    index = Index(pivots, top, size, near.reshape(shape), far.reshape(shape), counts.reshape(shape))
    parts = F.element_at(F.array(*(F.lit(int(max(1, -(-n // s.block)))) for n in counts)), F.col("ring") + 1)
    return keyed.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("distance"), index


def _search(asked: DataFrame, rows: DataFrame, index: Index, s: Settings) -> DataFrame:
    """(id, rank, match, score): the best k of each query among the rings it asks for. ``asked``: id, x, ring, qpart."""
    parts = F.element_at(F.array(*(F.lit(int(max(1, -(-n // s.block)))) for n in index.counts.ravel())), F.col("ring") + 1)
    spread = asked.select("id", "x", "ring", "qpart", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    met = asked.select(F.col("ring").alias("to"), F.col("qpart").alias("q")).distinct()
    there = rows.select("id", "x", F.col("ring").alias("r"), F.col("part").alias("p")).join(met, F.col("r") == F.col("to")).select("id", "x", "r", "q", "p")
    size, k = index.size, s.k

    def best(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"id": [], "match": [], "score": []}).astype("int64")
        q, ids = matrix(queries["x"], size), block["id"].to_numpy()
        own = queries["id"].to_numpy()
        out = []
        for a in range(0, len(q), s.queries):
            got = scores(q[a : a + s.queries], matrix(block["x"], size))
            for i, row in enumerate(got):
                usable = np.flatnonzero(ids != own[a + i])
                if len(usable) > k:
                    floor = np.partition(row[usable], len(usable) - k)[len(usable) - k]
                    usable = usable[row[usable] >= floor]
                order = usable[np.lexsort((ids[usable], -row[usable]))][:k]
                out.append((np.full(len(order), own[a + i]), ids[order], row[order]))
        return pd.DataFrame(dict(zip(("id", "match", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return spread.groupBy("ring", "qpart", "part").cogroup(there.groupBy("r", "q", "p")).applyInPandas(best, "id long, match long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("id").orderBy(F.desc("score"), "match")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of the rows that ``is_query`` picks by their id, against all rows."""
    s, spark = settings, vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    clean = _clean(vectors, s, id_col, vector_col)
    built = build_index(clean, s)
    if built is None:
        return empty
    rows, index = built
    queries = clean.where(is_query(F.col("id")))
    many = queries.count()
    qparts = max(1, -(-many // s.queries))
    queries = queries.withColumn("qpart", F.pmod(F.xxhash64("id", "x", F.lit("q")), F.lit(qparts)).cast("int"))
    held = index.counts.ravel()

    def first(batches):
        for batch in batches:
            order = np.argsort(-index.bounds(matrix(batch["x"], index.size)), axis=1, kind="stable")
            need = (np.cumsum(held[order], axis=1) < s.k + 1).sum(axis=1) + 1  # rings until k rows beside its own are seen
            rings = [o[: min(n, len(o))].astype(np.int32) for o, n in zip(order, need, strict=True)]
            yield pd.DataFrame({"id": batch["id"], "x": batch["x"], "qpart": batch["qpart"], "rings": rings})

    schema = "id long, x array<double>, qpart int, rings array<int>"
    opened = cut(queries.select("id", "x", "qpart").mapInPandas(first, schema))
    one = _search(opened.select("id", "x", "qpart", F.explode("rings").alias("ring")), rows, index, s)
    one = cut(_ranked(one, s.k).select("id", "match", "score"))
    floor = one.groupBy("id").agg(F.when(F.count(F.lit(1)) >= s.k, F.min("score")).alias("floor"))

    def rest(batches):
        for batch in batches:
            bounds = index.bounds(matrix(batch["x"], index.size))
            floors = batch["floor"].astype("float64").fillna(-np.inf).to_numpy()
            rings = []
            for bound, least, seen in zip(bounds, floors, batch["rings"], strict=True):
                more = np.flatnonzero((held > 0) & (bound >= least))
                rings.append(np.setdiff1d(more, seen).astype(np.int32))
            yield pd.DataFrame({"id": batch["id"], "x": batch["x"], "qpart": batch["qpart"], "rings": rings})

    more = opened.join(floor, "id", "left").select("id", "x", "qpart", "rings", "floor").mapInPandas(rest, schema)
    two = _search(more.select("id", "x", "qpart", F.explode("rings").alias("ring")), rows, index, s)
    final = _ranked(one.unionByName(two), s.k)
    return final.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("match").alias("vec_id"), "score")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fiftieth of ``embeddings``, the five others with the largest inner products."""
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
