"""Quality rules: counts of a text, and how far its histograms lie from those of its language.

A language reference holds two histograms over all documents of the language: character classes, and the most frequent
words with one bin for all other words. A document is rejected if the Jensen-Shannon distance (base 2, from 0 to 1)
of either histogram to its reference is above a limit; texts shorter than a minimum length are too short to compare and
pass this rule. The limit of words follows from the reference and the text's length: chance alone moves the histogram of a
short text far, and a text without any common word lies no farther than the share of common words in the reference allows.

Defined results: texts of any length are counted whole; a null or empty text has no words and fails the base rule; a document whose language is null or has no
reference is compared with the reference of all documents, and its words may fit that or the reference of any language;
repeated rows count as often as they come; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_texts, table

#: The signs that count as symbols, and the blanks that part words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
CLASSES = ("lower", "upper", "digit", "blank", "stop", "symbol", "sign", "beyond")
ALL = ""  # the language of the reference of all documents


def _class_table() -> np.ndarray:
    """Character class of each ASCII code."""
    out = np.full(128, CLASSES.index("sign"), dtype=np.int64)
    for k in range(128):
        c = chr(k)
        kind = "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "blank" if c in BLANKS else "stop" if c in ".,;:!?'\"-()" else "symbol" if c in SYMBOLS else "sign"
        out[k] = CLASSES.index(kind)
    return out


_CLASS_OF = _class_table()


def class_counts(text: str) -> np.ndarray:
    """Characters of ``text`` by class; all beyond ASCII are one class."""
    counts = np.bincount(np.frombuffer(text.encode("ascii", "replace") if not text.isascii() else text.encode(), dtype=np.uint8), minlength=128)
    beyond = 0 if text.isascii() else len(text) - sum(map(text.count, map(chr, np.flatnonzero(counts)))) if counts[63] else 0
    counts[63] -= beyond
    out = np.bincount(_CLASS_OF, weights=counts[:128], minlength=len(CLASSES)).astype(np.int64)
    out[CLASSES.index("beyond")] += beyond
    return out


def words_of(text: str) -> list[bytes]:
    """Words between ASCII blanks, as UTF-8."""
    return text.encode().split()  # bytes.split() parts at exactly the blanks above


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that the text holds twice or more, the first included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:  # three factors would not fit 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(number) + ids[2:]
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def common_form(word: bytes) -> bytes:
    return word.strip(b".,;:!?'\"-()").lower()


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms."""
    p, q = p / max(p.sum(), 1), q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        sides = [np.where(x > 0, x * np.log2(x / m), 0.0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(sides) / 2)))


@dataclass(frozen=True)
class Reference:
    classes: np.ndarray
    words: dict[bytes, int]  # bin by word; the last bin is for all others
    counts: np.ndarray
    lengths: np.ndarray  # numbers of words, and the largest divergence (squared distance) of a text so long
    limits: np.ndarray

    def word_limit(self, n: int) -> float:
        """The largest distance of a text of ``n`` words."""
        return float(np.sqrt(np.interp(np.log(n), np.log(self.lengths), self.limits)))


@dataclass(frozen=True)
class Rules:
    """``common``: common words by language.
    ``least_chars`` and ``least_words``: below these a histogram says too little and is not compared. ``word_share``: how far
    words may lie beyond chance, as a share of the distance of a text without common words."""

    common: int = 48
    least_chars: int = 200
    least_words: int = 50
    class_limit: float = 0.30
    word_share: float = 0.5


def word_limits(counts: np.ndarray, rules: Rules, draws: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the limits of the divergence there: the mean of random draws from the reference, and a share of the
    divergence of a text without common words."""
    lengths = rules.least_words * 2 ** np.arange(10)
    if not counts.sum():
        return lengths, np.ones(len(lengths))
    random, without = np.random.default_rng(0), np.zeros(len(counts))
    without[-1] = 1
    margin = (rules.word_share * distance(without, counts)) ** 2
    chance = [np.mean([distance(x, counts) ** 2 for x in random.multinomial(n, counts / counts.sum(), draws)]) for n in lengths]
    return lengths, np.array(chance) + margin


def learn_references(docs: DataFrame, rules: Rules, text_col: str = "text", lang_col: str = "lang") -> dict[str, Reference]:
    """Histograms of every language over all documents. Tasks send one row per language, class or word."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            classes: dict[str, np.ndarray] = {}
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in classes:
                    classes[lang], words[lang] = np.zeros(len(CLASSES), dtype=np.int64), Counter()
                classes[lang] += class_counts(text)
                all_words = words_of(text)
                words[lang].update(map(common_form, all_words))
                words[lang][None] += len(all_words)
            rows = [(lang, k, b"", int(n)) for lang, c in classes.items() for k, n in enumerate(c)]
            rows += [(lang, -1 if w is None else -2, w or b"", n) for lang, c in words.items() for w, n in c.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["lang", "kind", "word", "n"])

        return work

    parts = map_texts(docs, [F.coalesce(F.col(lang_col), F.lit(ALL)).alias("lang"), F.col(text_col)], make, "lang string, kind int, word binary, n long")
    summed = cut(parts.groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")))  # counted once for both uses
    both = summed.unionByName(summed.where(F.col("lang") != ALL).withColumn("lang", F.lit(ALL))).groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "word")
    ranked = both.where((F.col("kind") == -2) & (F.col("word") != F.lit(b""))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= rules.common)
    top = both.where("kind > -2").withColumn("rank", F.lit(1)).unionByName(ranked)
    found: dict[str, dict[int, list]] = {}
    for r in top.select("lang", "kind", "word", "n", "rank").orderBy("rank").collect():  # by language: a row per class and common word
        found.setdefault(r.lang, {}).setdefault(r.kind, []).append((bytes(r.word), r.n))
    out = {}
    for lang, kinds in found.items():
        common = kinds.get(-2, [])
        total = kinds.get(-1, [(b"", 0)])[0][1]
        counts = np.array([n for _, n in common] + [max(0, total - sum(n for _, n in common))], dtype=float)
        out[lang] = Reference(np.array([kinds[k][0][1] if k in kinds else 0 for k in range(len(CLASSES))], dtype=float), {w: k for k, (w, _) in enumerate(common)}, counts, *word_limits(counts, rules))
    return out


def distances(text: str, words: list[bytes], reference: Reference, rules: Rules) -> tuple[float, float]:
    """(character classes, common words); 0 where the text is too short to compare."""
    by_class = distance(class_counts(text).astype(float), reference.classes) if len(text) >= rules.least_chars else 0.0
    if len(words) < rules.least_words:
        return by_class, 0.0
    counts = np.zeros(len(reference.counts))
    hits = [reference.words[w] for w in map(common_form, words) if w in reference.words]
    counts[:-1] = np.bincount(hits, minlength=len(counts) - 1)[: len(counts) - 1] if len(counts) > 1 else 0
    counts[-1] = len(words) - len(hits)
    return by_class, distance(counts, reference.counts)


def words_fit(words: list[bytes], found: float, own: Reference | None, references: dict[str, Reference], rules: Rules) -> bool:
    """Whether the distance ``found`` to its own reference is within the limit; without one, that to any reference is."""
    if len(words) < rules.least_words:
        return True
    if own is not None:
        return found <= own.word_limit(len(words))
    return any(distances("", words, r, rules)[1] <= r.word_limit(len(words)) for r in references.values())


def score_quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The counts of every text, its two distances, and the verdict."""
    references = learn_references(docs, rules, text_col, lang_col)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                n, repeated = len(words), repeated_words(words)
                failed = n < 50 or 100 * repeated > 50 * n
                own = references.get(lang) if lang != ALL else None
                near = distances(text, words, own or references[ALL], rules)
                fits = not failed and near[0] <= rules.class_limit and words_fit(words, near[1], own, references, rules)
                blanks = sum(map(text.count, BLANKS))
                rows.append((n, len(text) - blanks, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, failed, fits, *near))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return map_texts(docs, [F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit(ALL)).alias("lang"), F.col(text_col)], make, schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all ``documents``."""
    return score_quality(table(spark, sf_dir, "documents"))
