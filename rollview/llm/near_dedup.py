"""Near-duplicate documents by ProbMinHash.

A document is a weighted set: its shingles of five words, each with the number of times it occurs. Every shingle is a
Poisson process of arrivals whose rate is its weight; an arrival falls into a random register, and a register keeps the
shingle that arrives first. A document's processes end when their next arrival is later than all its registers. Two
documents agree in a register with the probability Jaccard similarity of their weighted sets. Registers are banded,
documents that share a band are candidates, and candidates are verified by the exact probability Jaccard similarity.

Copies (equal words) fall together before banding, by hash. In each band bucket documents are compared with the bucket's
head, four different choices of heads over the bands, so a large group makes a few pairs per document and not all pairs.
Where a bucket then still holds documents of several components, the documents that such buckets connect are a family. Its
largest component and its other documents are cut into blocks of bounded size; each block of others is compared with every
block of the family by matrix products, and only the links that join components come out. So each pair that shares a bucket
ends in one component or has been compared: no link is lost, and no pair becomes a row but those with heads.

Words are what white space parts, in lower case; a text of one to four words is one shingle. Defined results: texts of any
length are compared whole; a null or empty text has no shingles and is a class of its own; an id is a document, so rows of one id stay or go together (several
texts under one id are tied to one class); null ids count as one document, below all others; an empty table gives an empty
result; other columns are not read and kept by :func:`drop_near_copies`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, id_back, id_key, map_texts, shuffle_partitions, table, unused
from .components import components

_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def shingles(words: list[bytes], size: int = 5) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` words; fewer words are one run."""
    from xxhash import xxh3_64_intdigest

    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    if len(h) < size:
        h = np.concatenate([h, np.zeros(size - len(h), dtype=np.uint64)])
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(_STEP) + h[k : k + len(out)]
    return _mix(out)


def prob_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int, registers: int) -> np.ndarray:
    """Signatures (owners x registers): the element that arrives first in each register of its owner.

    All processes advance together, one arrival each per round; those that are later than every register of their owner
    drop out, so most elements end after a round or two.
    """
    first = np.full(owners * registers, np.inf)
    winner = np.zeros(owners * registers, dtype=np.uint64)
    at = np.zeros(len(elements))
    live = np.arange(len(elements))
    round_ = 0
    while len(live):
        round_ += 1
        random = _mix(elements[live] + np.uint64(round_ * _STEP & 0xFFFFFFFFFFFFFFFF))
        at[live] -= np.log((random >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / weights[live]
        random = _mix(random)
        place = owner[live] * registers + ((random >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        now = at[live]
        ahead = now < first[place]
        np.minimum.at(first, place[ahead], now[ahead])
        won = ahead & (now == first[place])
        winner[place[won]] = elements[live[won]]
        latest = first.reshape(owners, registers).max(axis=1)
        live = live[now < latest[owner[live]]]
    return winner.reshape(owners, registers)


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two sorted multisets of hashes."""
    (x, p), (y, q) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    if not len(x) or not len(y):
        return 0.0
    if p.max() == 1 and q.max() == 1:  # equal weights: the plain Jaccard similarity
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / (len(x) + len(y) - both)
    keys = np.union1d(x, y)
    left, right = np.zeros(len(keys)), np.zeros(len(keys))
    left[np.searchsorted(keys, x)], right[np.searchsorted(keys, y)] = p / p.sum(), q / q.sum()
    with np.errstate(divide="ignore"):
        ratio = right / left
    order = np.argsort(ratio, kind="stable")
    left, right, ratio = left[order], right[order], ratio[order]
    common = np.flatnonzero((left > 0) & (right > 0))
    upto = np.searchsorted(ratio, ratio[common], side="right")  # the sum of max(p_j / p_i, q_j / q_i) splits at i's ratio
    low, high = np.concatenate([[0], np.cumsum(left)]), np.concatenate([[0], np.cumsum(right)])
    return float((1 / (low[upto] / left[common] + (high[-1] - high[upto]) / right[common])).sum())


@dataclass(frozen=True)
class Settings:
    """Twenty bands of four registers meet at similarity 0.8 with probability 1 - (1 - 0.8 ** 4) ** 20 > 0.9999."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 4


def _features(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(doc, c1, c2: hash of the words, n: shingles, bands)."""

    def make():
        from xxhash import xxh3_128_digest

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            elements, weights, sizes, contents, totals = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                unique, counts = np.unique(shingles(words, s.words), return_counts=True)
                elements.append(unique)
                weights.append(counts)
                sizes.append(len(unique))
                totals.append(int(counts.sum()))
                contents.append(xxh3_128_digest(b" ".join(words)))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            winners = prob_minhash(np.concatenate(elements), np.concatenate(weights).astype(float), owner, len(sizes), s.bands * s.rows)
            keys = np.zeros((len(sizes), s.bands), dtype=np.uint64)
            for k in range(s.rows):
                keys = _mix(keys * np.uint64(_STEP) + winners.reshape(len(sizes), s.bands, s.rows)[:, :, k])
            keys = _mix(keys + np.arange(s.bands, dtype=np.uint64) * np.uint64(_STEP)).astype(np.int64)
            full = np.array(sizes) > 0
            offsets = np.concatenate([[0], np.cumsum(full * s.bands)]).astype(np.int32)
            hashes = np.frombuffer(b"".join(contents), dtype=">i8").astype(np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel()))],
                names=["doc", "c1", "c2", "n", "bands"],
            )

        return work

    return map_texts(docs, [id_key(docs, id_col).alias("doc"), F.col(text_col)], make, "doc long, c1 long, c2 long, n long, bands array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose exact similarity is high enough."""

    wanted = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    sets = _sets(docs, wanted, s, id_col, text_col)
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("right"))

    def check(batches):
        for batch in batches:
            near = [probability_jaccard(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= s.similarity for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


BLOCK = 1024  # documents of a block
COLUMNS = 4096  # shingles of one matrix product
PAIRS = 2_000_000  # pairs of documents with a rare shingle, at a time


def _sets(docs: DataFrame, wanted: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(doc, shingles: sorted 32-bit hashes, repeated as often as they occur) of the documents of ``wanted``."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [(np.sort(shingles(words_of(t), s.words)) >> np.uint64(32)).astype("<u4").tobytes() for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc", "shingles"])

        return work

    texts = docs.select(id_key(docs, id_col).alias("doc"), F.col(text_col).alias("text")).join(wanted, "doc", "left_semi")
    return map_texts(texts, [F.col("doc"), F.col("text")], make, "doc long, shingles binary")


class _Side:
    """Documents of one block: shares of weight as (row, shingle, share), and which have no shingle twice."""

    def __init__(self, frame: pd.DataFrame):
        self.doc, self.component = frame["doc"].to_numpy(), frame["component"].to_numpy()
        self.raw = [np.frombuffer(x, "<u4") for x in frame["shingles"]]
        parts = [np.unique(x, return_counts=True) for x in self.raw]
        self.total = np.array([max(1, len(x)) for x in self.raw], dtype=np.float64)
        self.plain = np.array([not len(c) or c.max() == 1 for _, c in parts], dtype=bool)
        self.row = np.repeat(np.arange(len(parts)), [len(u) for u, _ in parts])
        self.key = np.concatenate([u for u, _ in parts]) if parts else np.zeros(0, "<u4")
        self.share = (np.concatenate([c for _, c in parts]) if parts else np.zeros(0)) / self.total[self.row]

    def among(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number of the key, share) of the shingles in ``keys`` (sorted), by key."""
        at = np.searchsorted(keys, self.key)
        hit = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == self.key)) if len(keys) else np.zeros(0, np.int64)
        hit = hit[np.argsort(at[hit], kind="stable")]
        return self.row[hit], at[hit], self.share[hit]

    def matrix(self, keys: np.ndarray, shares: bool) -> np.ndarray:
        """Documents by ``keys`` (sorted): the shares, or ones."""
        at = np.searchsorted(keys, self.key)
        hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == self.key)
        out = np.zeros((len(self.doc), len(keys)), dtype=np.float32)
        out[self.row[hit], at[hit]] = self.share[hit] if shares else 1
        return out


def joining_links(left: _Side, right: _Side, similarity: float) -> list[tuple[int, int]]:
    """Links between the two sides that join components, none that closes a circle."""
    keys = np.intersect1d(left.key, right.key)
    near = np.zeros((2, len(left.doc), len(right.doc)))  # the share of either that the other has too
    (lrow, lkey, lshare), (rrow, rkey, rshare) = left.among(keys), right.among(keys)
    lcount, rcount = np.bincount(lkey, minlength=len(keys)), np.bincount(rkey, minlength=len(keys))
    frequent = lcount * rcount > 2048  # these by matrix product, the others pair by pair
    often = keys[frequent]
    for a in range(0, len(often), COLUMNS):
        part = often[a : a + COLUMNS]
        near[0] += left.matrix(part, True) @ right.matrix(part, False).T
        near[1] += left.matrix(part, False) @ right.matrix(part, True).T
    rare = ~frequent[lkey]
    lrow, lkey, lshare = lrow[rare], lkey[rare], lshare[rare]
    starts, repeats = np.cumsum(rcount) - rcount, rcount[lkey]
    upto = np.cumsum(repeats)
    part = 0
    while part < len(lkey):  # parts of bounded size, whatever the number of shingles
        end = max(part + 1, int(np.searchsorted(upto, (upto[part - 1] if part else 0) + PAIRS, side="right")))
        own, many = slice(part, end), repeats[part:end]
        at = np.repeat(starts[lkey[own]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        cell = np.repeat(lrow[own], many) * len(right.doc) + rrow[at]
        for side, weight in enumerate((np.repeat(lshare[own], many), rshare[at])):
            near[side] += np.bincount(cell, weights=weight, minlength=near[side].size).reshape(near[side].shape)
        part = end
    both = np.rint(near[0] * left.total[:, None])
    plain = both / (left.total[:, None] + right.total[None] - both)  # where no shingle repeats; else a bound must do
    most = np.where(left.plain[:, None] & right.plain[None], plain + 1e-9, near.min(axis=0) + 1e-4)
    able = (most >= similarity) & (left.component[:, None] != right.component[None])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for i, j in np.argwhere(able):
        a, b = find(int(left.component[i])), find(int(right.component[j]))
        if a == b:
            continue
        exact = left.plain[i] and right.plain[j]
        if exact or probability_jaccard(left.raw[i], right.raw[j]) >= similarity:
            root[a] = b
            out.append((int(left.doc[i]), int(right.doc[j])))
    return out


def _family_links(split: DataFrame, docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """Links between the components that ``split`` (doc, head, component) still holds apart in one bucket."""
    family = components(split.where("doc <> head").select(F.col("doc").alias("a"), F.col("head").alias("b")).distinct())
    members = cut(split.select("doc", "component").distinct().join(family.select(F.col("node").alias("doc"), F.col("component").alias("family")), "doc"))
    sizes = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("family").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n")).select("family", F.col("m.component").alias("main"), F.col("m.n").alias("in_main"), "n").where("n > in_main")
    placed = members.join(main, "family").withColumn("other", F.col("component") != F.col("main"))
    count = F.when(F.col("other"), F.col("n") - F.col("in_main")).otherwise(F.col("in_main"))
    placed = cut(placed.select("doc", "component", "family", "other", F.pmod(F.xxhash64("doc"), F.ceil(count / F.lit(BLOCK))).alias("block")))
    blocks = placed.select("family", "other", "block").distinct()
    others = blocks.where("other").select("family", F.col("block").alias("x"))
    pairs = cut(others.join(blocks, "family").where("not other or block >= x").select("family", "x", "other", "block"))
    sets = _sets(docs, placed.select("doc"), s, id_col, text_col).join(placed, "doc")
    own = sets.alias("s").join(pairs.alias("p"), F.expr("s.other and s.family = p.family and s.block = p.x")).select("p.family", "p.x", "p.other", "p.block", "s.doc", "s.component", "s.shingles", F.lit(0).alias("side"))
    met = sets.alias("s").join(pairs.alias("p"), F.expr("s.family = p.family and s.other = p.other and s.block = p.block")).where("not (p.other and p.x = p.block)").select("p.family", "p.x", "p.other", "p.block", "s.doc", "s.component", "s.shingles", F.lit(1).alias("side"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        left = _Side(frame[frame["side"] == 0])
        right = _Side(frame[frame["side"] == 1]) if (frame["side"] == 1).any() else left
        return pd.DataFrame(joining_links(left, right, s.similarity), columns=["a", "b"], dtype="int64")

    # few bytes and much work: a stated number of partitions is not merged into fewer
    dealt = own.unionByName(met).repartition(shuffle_partitions(docs.sparkSession), "family", "x", "other", "block")
    return dealt.groupBy("family", "x", "other", "block").applyInPandas(compare, "a long, b long")


def _pairs(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_classes(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, class): every row's document and the smallest document of its class."""
    s = settings
    features = cut(_features(docs, s, id_col, text_col))
    # what a hot key's rows are joined with is written first: both sides of the join then come straight from a shuffle, and
    # adaptive execution can split a partition that holds one key
    copies = cut(features.where("n > 0").groupBy("c1", "c2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many"))
    members = features.join(copies, ["c1", "c2"], "left").select("doc", F.coalesce("first", "doc").alias("first"), "bands")
    members = cut(members.select("doc", "first", F.when((F.col("doc") == F.col("first")) & (F.size("bands") > 0), F.col("bands")).alias("bands")))
    rows = members.where("bands is not null").select("doc", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct(F.xxhash64("doc", F.col("band") % 4).alias("h"), "doc")).alias("head")).where("many > 1")
    rows = cut(rows.join(cut(shared.select("key", F.col("head.doc").alias("head"))), "key").select("key", "doc", "head"))
    compared = rows.where("doc <> head").select(*_pairs("doc", "head")).distinct()
    links = cut(_verified(cut(compared), docs, s, id_col, text_col))
    named = components(links)
    placed = rows.join(named.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "head", F.coalesce("component", "doc").alias("component"))
    apart = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("many"))
    # a bucket of two was compared in full
    split = cut(placed.join(cut(apart.where("low < high and many > 2").select("key")), "key", "left_semi").select("doc", "head", "component").distinct())
    more = cut(_family_links(split, docs, s, id_col, text_col))
    # an id with several texts ties the classes of these
    several = members.groupBy("doc").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").select("doc", "a", "b")
    ties = several.join(members.select("doc", "first"), "doc").select("a", F.col("first").alias("b")).where("a < b")
    named = components(links.unionByName(more).unionByName(ties))
    return _classes(members, named)


def _classes(members: DataFrame, named: DataFrame) -> DataFrame:
    """The class of every row by that of the first of its copies, which is the smallest of them."""
    return members.select("doc", "first").join(named.withColumnRenamed("node", "first"), "first", "left").select("doc", F.coalesce("component", "first").alias("class"))


def drop_near_copies(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest document of each class only."""
    key = unused(docs, "key")
    gone = near_classes(docs, settings, id_col, text_col).where("doc <> class").select(F.col("doc").alias(key)).distinct()
    return docs.withColumn(key, id_key(docs, id_col)).join(gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each of ``documents``: its smallest doc_id."""
    found = near_classes(table(spark, sf_dir, "documents"))
    return found.select(id_back("doc").alias("doc_id"), id_back("class").alias("class_id"), (F.col("doc") == F.col("class")).alias("kept"))
