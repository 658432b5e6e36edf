"""Toxicity by non-negative positive-unlabelled learning.

A linear model over word features is trained in numpy from confirmed toxic texts and unlabelled ones, both drawn from the rows
that have labels, so that the class prior holds for the latter. With class prior
``p`` the risk of scorer g is p * E+[loss(g)] + max(0, Eu[loss(-g)] - p * E+[loss(-g)]): the unlabelled texts stand for the
negatives after their share of positives is taken out, and the estimate is kept from going below zero, where training would
start to fit single unlabelled texts. With the logistic loss g is a log-odds, so its sigmoid is the score.

Features: a word, and the first letters of a word, each at four levels: seen at all, seen twice, and seen at least once
in 300 or in 100 words of the text, as what is chance in a long text is none in a short one. The words that tell positives
from unlabelled texts are found by counts over the training sample. Only texts enter a score.

Defined results: texts of any length are scored whole; a null or empty text has no features and gets the score of the bias alone; repeated rows get equal scores;
an empty training side gives score 0 for all texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, slices, table
from .tokens import Memo

_WORDS = re.compile(r"[^\W\d_]+").findall


def features_of(word: str) -> list[str]:
    """The word, marked at both ends, and its beginnings of three to eight letters, marked at the front."""
    return [f"<{word}>", *(f"<{word[:k]}" for k in range(3, min(9, len(word))))]


LEVELS = 4


def levels(n: int, words: int) -> tuple[int, ...]:
    """The levels that ``n`` times in so many words reach."""
    return tuple(k for k, reached in enumerate((n > 0, n > 1, 300 * n >= words, 100 * n >= words)) if reached)


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def _held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Settings:
    """``positives`` and ``unlabelled`` bound the training sample (labelled rows, drawn by a hash of their id); ``most`` bounds the
    features; ``least`` and ``z`` are the positives that hold a feature and the z-score that it needs at least."""

    positives: int = 4000
    unlabelled: int = 12000
    most: int = 1500
    least: int = 4
    z: float = 6.0
    steps: int = 600
    rate: float = 0.05
    penalty: float = 2e-4


@dataclass
class Model:
    index: dict[str, int] = field(default_factory=dict)  # feature -> number; weights by number and level
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, LEVELS)))
    bias: float = -np.inf

    def scorer(self):
        """Function text -> score, with a memo from words to feature numbers."""
        index = self.index
        memo = Memo(lambda word: tuple(index[f] for f in features_of(word) if f in index))

        def score(text: str) -> float:
            words = _WORDS(text.lower())
            counts = Counter(k for word in words for k in memo[word])
            g = self.bias + sum(self.weights[k, j] for k, n in counts.items() for j in levels(n, len(words)))
            return float(1 / (1 + np.exp(-g))) if g > -700 else 0.0

        return score


def train_nnpu(positive: list[list[int]], unlabelled: list[list[int]], n: int, prior: float, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by full-batch Adam over binary features."""
    sizes = [np.array([len(x) for x in side]) for side in (positive, unlabelled)]
    rows = [np.repeat(np.arange(len(s)), s) for s in sizes]
    columns = [np.fromiter((k for x in side for k in x), np.int64, int(s.sum())) for side, s in zip((positive, unlabelled), sizes, strict=True)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    theta = np.zeros(n + 1)
    theta[n] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def gradient(side: int, pull: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns[side], weights=pull[rows[side]], minlength=n), pull.sum()) / len(pull)

    for step in range(1, settings.steps + 1):
        g = [np.bincount(rows[k], weights=theta[columns[k]], minlength=len(sizes[k])) + theta[n] for k in (0, 1)]
        negative = np.logaddexp(0, g[1]).mean() - prior * np.logaddexp(0, g[0]).mean()
        of_negative = gradient(1, sigmoid(g[1])) - prior * gradient(0, sigmoid(g[0]))
        pull = -of_negative if negative < 0 else prior * gradient(0, sigmoid(g[0]) - 1) + of_negative
        pull[:n] += settings.penalty * theta[:n]
        first, second = 0.9 * first + 0.1 * pull, 0.999 * second + 0.001 * pull**2
        theta -= settings.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:n], float(theta[n])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the rows of ``labels`` that are not held out: the positive ones, and all of them with their labels unseen as
    the unlabelled texts. The class prior is the share of positives among them."""
    rows = labels.where(~_held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    totals = known.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") == 1).cast("long")).alias("p")).first()
    if not totals.p:
        return Model()
    prior = min(totals.p / totals.n, 1 - 0.5 / totals.n)  # where all are positive, not quite 1
    draw = lambda rows, most, y: rows.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(most).select("id", F.lit(y).alias("y"))
    chosen = draw(known.where("y = 1"), settings.positives, 1).unionByName(draw(known, settings.unlabelled, 0))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most positives + unlabelled rows
    sample = texts.groupBy("id", "y").agg(F.min("text").alias("text"))  # of an id with several texts, one

    def words():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            bags = [" ".join(_WORDS(t.lower())) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.string())], names=["y", "bag"])

        return work

    bags = cut(map_texts(sample, [F.col("y"), F.col("text")], words, "y int, bag string"))

    def count(batches):
        sides = (Counter(), Counter())
        for batch in batches:
            for y, bag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sides[y].update({f for w in set(bag.split()) for f in features_of(w)})
        for y, side in enumerate(sides):
            yield pa.RecordBatch.from_arrays([pa.array(list(side), pa.string()), pa.array([y] * len(side), pa.int32()), pa.array(list(side.values()), pa.int64())], names=["feature", "y", "n"])

    sizes = {r.y: r.n for r in bags.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model()
    on = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("u")
    share = (F.col("p") + F.col("u")) / F.lit(n1 + n0)
    z = (F.col("p") / n1 - F.col("u") / n0) / F.sqrt(share * (1 - share + 1e-9) * (1 / n1 + 1 / n0))
    counted = bags.mapInArrow(count, "feature string, y int, n long").groupBy("feature").agg(*on)
    best = counted.where(F.col("p") >= settings.least).withColumn("z", z).where(F.col("z") >= settings.z).orderBy(F.desc("z"), "feature").limit(settings.most)
    index = {r.feature: k for k, r in enumerate(best.select("feature").collect())}

    def numbers(batches):
        for batch in batches:
            out = []
            for bag in batch.column(1).to_pylist():
                words = bag.split()
                counts = Counter(index[f] for w in words for f in features_of(w) if f in index)
                out.append([LEVELS * k + j for k, n in counts.items() for j in levels(n, len(words))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["y", "on"])

    rows = bags.mapInArrow(numbers, "y int, on array<int>").collect()  # at most positives + unlabelled rows
    theta, bias = train_nnpu([r.on for r in rows if r.y], [r.on for r in rows if not r.y], LEVELS * len(index), prior, settings)
    return Model(index, theta.reshape(-1, LEVELS), bias)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""

    def make():
        score = model.scorer()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = np.array([score(t) for t in batch.column(2).to_pylist()], dtype=float)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [F.col(id_col).alias("doc_id"), _held_out(id_col).alias("held_out"), F.col(text_col)], make, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged."""
    place = docs.columns.index(text_col)

    def keep(batches):
        score = model.scorer()
        for whole in batches:
            for batch in slices(whole, place):
                yield batch.filter(pa.array([score(t or "") < threshold for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learnt from ``labels`` of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
