"""Secret scan: exact patterns, and a linear-chain conditional random field for what they miss.

Base spans come from three patterns. The field tags tokens as begin, inside or outside of a secret. Its features are a
token's shape, the words and shapes beside it, and features of the file; it is trained in numpy by maximum likelihood on a
bounded sample of chains of whole texts, whose base spans serve as tags, and decoded by Viterbi over all tokens of a
text. Most tokens can be shown to be outside on every best path from bounds of their scores, so only the stretches between
them take steps. Chains for training are stretches of tokens around base spans, around those that could be a secret by their
shape, and around every 128th token. A span of the field is added where it meets no base span.

Defined results: null and empty texts have no spans; texts of any length are scanned whole; repeated rows give repeated
results; a sample without base spans gives a field that adds none; an empty table gives an empty result; other columns are
not read by the scan and kept by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, slices, table

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "field")

_NAMES = ("passw", "secret", "token", "api")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # what HEX finds leftmost, greedily, at 24 characters or more
#: What could be a secret by its shape: a digit or joining sign, or a long run.
_SEED = re.compile(r"[0-9_+/=]+|[\w.-]{20,}")
_TOKEN = re.compile(r"[\w+/.=-]+|[^\w\s]")
O, B, I = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind."""
    found = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def stretches(text: str, spans: list[tuple[int, int]], beside: int = 3, every: int = 128) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, end) of all tokens, and chains for training as (first, end) among them: tokens within ``beside`` of one that
    could be a secret, that meets one of the sorted ``spans``, or that is one of ``every`` so many."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    near, k = np.zeros(len(tokens) + 2, dtype=bool), 0
    for i, (a, b) in enumerate(tokens):
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if i % every == 0 or (k < len(spans) and spans[k][0] < b) or _SEED.search(text, a, b):
            near[max(0, i - beside) + 1 : min(len(tokens), i + beside + 1) + 1] = True
    edges = np.flatnonzero(near[1:] != near[:-1])
    return tokens, list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


#: Classes of ASCII characters: digits, capitals and small letters; the others stand for themselves.
_ASCII = str.maketrans({**dict.fromkeys(string.digits, "9"), **dict.fromkeys(string.ascii_uppercase, "A"), **dict.fromkeys(string.ascii_lowercase, "a")})
_RUN = re.compile(r"([\s\S])\1+")
_HEX_WORD = re.compile(r"[0-9a-fA-F]{16,}").fullmatch


def classes(token: str) -> str:
    if token.isascii():
        return token.translate(_ASCII)
    return "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token)


def shape(token: str) -> str:
    """Classes of characters in order, runs cut to one: ``Ab9`` is ``Aa9``."""
    return _RUN.sub(r"\1", classes(token))[:8]


def file_features(text: str) -> list[str]:
    head = len(text) or 1
    signs = sum(map(text.count, "=:{};\"'_/"))
    return [f"signs{min(5, int(40 * signs / head))}", f"lines{min(5, text.count(chr(10)).bit_length())}"]


#: Places of the words beside a token.
BESIDE = (-2, -1, 1, 2)


def traits(w: str) -> tuple:
    """All that a word's own features say of it; few words differ in it."""
    n, digits = len(w), 0
    if w.isalpha() and w.islower():  # most words
        form, upper, lower = "a", False, True
    elif w.isalpha() and w[0].isupper() and w[1:].islower():
        form, upper, lower = "Aa", True, True
    else:
        kinds = classes(w)
        form, digits, upper, lower = _RUN.sub(r"\1", kinds)[:8], kinds.count("9"), "A" in kinds, "a" in kinds
    return form, min(n // 4, 12), digits > 0, upper, lower, min(len(set(w)) // 3, 8), n >= 16, 4 * digits // n, n >= 12, n >= 16 and _HEX_WORD(w) is not None


def own_features(w: str) -> list[str]:
    shape_, size, digit, upper, lower, distinct, long, share, wide, hex_ = traits(w)
    return ["bias", f"shape:{shape_}", f"size:{size}", f"mix:{digit}{upper}{lower}", f"distinct:{distinct}:{long}", f"digits:{share}:{wide}", f"hex:{hex_}"]


def beside_form(w: str) -> str:
    """What a token sees of a word beside it; "" beyond the text."""
    return w.lower() if w.isalpha() and len(w) < 12 else shape(w)


def token_features(words: list[str], i: int, of_file: list[str]) -> list[str]:
    beside = [f"{step}:{beside_form(words[i + step] if 0 <= i + step < len(words) else '')}" for step in BESIDE]
    return own_features(words[i]) + beside + of_file


@dataclass
class ChainField:
    """Weights by feature and tag, and by pair of tags; inside never follows outside."""

    index: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))

    def score(self, features: Iterable[str]) -> np.ndarray:
        return self.emit[[self.index[f] for f in features if f in self.index]].sum(axis=0)

    def decode(self, chain: list[list[str]]) -> list[int]:
        """The best sequence of tags, by Viterbi."""
        return self.best_path(np.array([self.score(token) for token in chain]))

    def best_path(self, scores: np.ndarray, after: bool = False, before: bool = False) -> list[int]:
        """The best tags by Viterbi; ``after`` and ``before``: the tokens lie after, before one that is outside."""
        best, back = scores[0].copy(), []
        if after:
            best += self.move[O]
        best[I] = -np.inf
        for row in scores[1:]:
            step = best[:, None] + self.move
            step[O, I] = -np.inf
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        if before:
            best = best + self.move[:, O]
        tags = [int(best.argmax())]
        for pointers in reversed(back):
            tags.append(int(pointers[tags[-1]]))
        return tags[::-1]

    @property
    def leaving(self) -> float:
        """The most that a run's end can gain."""
        return float(self.move[[B, I], O].max() - self.move[O, O])

    def bounds(self, gains: np.ndarray) -> np.ndarray:
        """The most that each token can gain by being begin or inside; ``gains``: how far these lie above outside. A text's first
        token, which has no move before it, can gain what it does by being begin as well."""
        stay = self.move[O, O]
        return np.maximum(gains[:, 0] + self.move[:, B].max() - stay, gains[:, 1] + self.move[[B, I], I].max() - stay)

    def tags(self, scores: np.ndarray) -> np.ndarray:
        """The best tags of a whole text. A run of tokens that are not outside gains at most the sum of its tokens' bounds and
        one for its end; a token that no run with a gain can hold is outside, and the rest is decoded between such."""
        out, n = np.zeros(len(scores), dtype=np.int8), len(scores)
        if not n:
            return out
        gains = scores[:, 1:] - scores[:, :1]
        bound = self.bounds(gains)
        bound[0] = max(bound[0], gains[0, 0])
        whole = np.cumsum(bound)
        ahead = np.concatenate([[0.0], whole[:-1]])
        most = np.maximum.accumulate(whole[::-1])[::-1] - np.minimum.accumulate(ahead)  # of all runs that hold the token
        maybe = most + max(0.0, self.leaving) > -1e-6
        edges = np.flatnonzero(np.diff(np.concatenate([[False], maybe, [False]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            out[a:b] = self.best_path(scores[a:b], a > 0, b < n)
        return out


def train_field(chains: list[tuple[list[list[str]], list[int]]], least: int = 3, steps: int = 80, rate: float = 0.1, penalty: float = 1e-3) -> ChainField:
    """Maximum likelihood with an L2 penalty, by Adam; chains of equal length go through forward-backward together."""
    counts: dict[str, int] = {}
    for tokens, _ in chains:
        for token in tokens:
            for f in token:
                counts[f] = counts.get(f, 0) + 1
    index = {f: k for k, f in enumerate(sorted(f for f, n in counts.items() if n >= least))}
    if not any(tag for _, tags in chains for tag in tags):
        return ChainField()
    by_length: dict[int, list] = {}
    for tokens, tags in chains:
        by_length.setdefault(len(tokens), []).append(([[index[f] for f in token if f in index] for token in tokens], tags))
    groups = []
    for length, rows in by_length.items():
        flat = [(n * length + i, f) for n, (tokens, _) in enumerate(rows) for i, token in enumerate(tokens) for f in token]
        at, which = np.array(flat, dtype=np.int64).reshape(-1, 2).T
        groups.append((length, len(rows), at, which, np.array([t for _, t in rows])))
    theta = np.zeros((len(index) + 3, 3))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    wall = np.zeros((3, 3))
    wall[O, I] = -1e4
    total = sum(g[0] * g[1] for g in groups)

    def together(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        emit, move, pull = theta[:-3], theta[-3:] + wall, np.zeros_like(theta)
        for length, n, at, which, tags in groups:
            scores = np.stack([np.bincount(at, weights=emit[which, t], minlength=n * length) for t in range(3)], axis=1).reshape(n, length, 3)
            scores[:, 0, I] -= 1e4
            ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
            ahead[:, 0] = scores[:, 0]
            for i in range(1, length):
                ahead[:, i] = together(ahead[:, i - 1, :, None] + move, 1) + scores[:, i]
            for i in range(length - 2, -1, -1):
                behind[:, i] = together(move + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
            whole = together(ahead[:, -1], 1)
            chance = np.exp(ahead + behind - whole[:, None, None])
            wrong = chance - np.eye(3)[tags]
            flat = wrong.reshape(-1, 3)
            pull[:-3] += np.stack([np.bincount(which, weights=flat[at, t], minlength=len(index)) for t in range(3)], axis=1)
            for i in range(1, length):
                pair = np.exp(ahead[:, i - 1, :, None] + move + (scores[:, i] + behind[:, i])[:, None, :] - whole[:, None, None])
                pull[-3:] += pair.sum(axis=0)
                np.subtract.at(pull, (len(index) + tags[:, i - 1], tags[:, i]), 1)
        pull = pull / total + penalty * theta / len(theta)
        first, second = 0.9 * first + 0.1 * pull, 0.999 * second + 0.001 * pull**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return ChainField(index, theta[:-3], theta[-3:])


def tagged_chains(text: str) -> list[tuple[list[list[str]], list[int]]]:
    """Chains of a text with tags from its base spans, of whose tokens the value counts and not the name before it."""
    spans = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + [(a, b) for a, b, k in base_spans(text) if k]
    out, of_file = [], file_features(text)
    tokens, chains = stretches(text, sorted(spans))
    words = [text[a:b] for a, b in tokens]
    for first, end in chains:
        tags, before = [], None
        for a, b in tokens[first:end]:
            own = next((k for k, (x, y) in enumerate(spans) if x < b and a < y), None)
            tags.append(O if own is None else I if own == before else B)
            before = own
        out.append(([token_features(words, i, of_file) for i in range(first, end)], tags))
    return out


def pieces(tokens: list, tags: list[int], longest: int = 64):
    """A chain cut into parts of about ``longest`` tokens, never inside a span."""
    start = 0
    for i in range(1, len(tokens)):
        if i - start >= longest and tags[i] != I:
            yield tokens[start:i], tags[start:i]
            start = i
    yield tokens[start:], tags[start:]


def fit_field(docs: DataFrame, with_spans: int = 1500, without: int = 1500, id_col: str = "doc_id", text_col: str = "text", chains: int = 10_000) -> ChainField:
    """Train on at most ``with_spans`` texts that the base patterns match and ``without`` that they don't, drawn by a hash
    of their id. Chains and tags come from the whole texts, on the executors; at most ``chains`` with a span and as many
    without, drawn by a hash of their content, go to the driver."""
    text = F.col(text_col)
    named = reduce(lambda a, b: a | b, (F.lower(text).contains(n) for n in _NAMES))  # cheap, and false for most texts
    hit = named & text.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']? *[:=]") | text.contains("AKIA") & text.rlike("AKIA[A-Z0-9]{16}") | text.rlike("[0-9a-f]{24}")
    drawn = cut(docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), hit.alias("hit"), F.xxhash64(F.col(id_col), F.lit("field")).alias("o")))
    chosen = drawn.where("hit").orderBy("o", "id").limit(with_spans).unionByName(drawn.where("not hit").orderBy("o", "id").limit(without))
    bounded = F.broadcast(chosen.select("id").distinct())  # at most with_spans + without ids
    texts = docs.select(F.col(id_col).alias("id"), text).join(bounded, "id", "left_semi")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [piece for t in batch.column(0).to_pylist() for chain in tagged_chains(t) for piece in pieces(*chain)]
            columns = [pa.array([[" ".join(f) for f in tokens] for tokens, _ in found], pa.list_(pa.string())), pa.array([tags for _, tags in found], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names=["tokens", "tags"])

        return work

    rows = cut(map_texts(texts, [text], make, "tokens array<string>, tags array<int>").withColumn("o", F.xxhash64("tokens", "tags")))
    tagged = F.exists("tags", lambda t: t != O)
    sample = rows.where(tagged).orderBy("o").limit(chains).unionByName(rows.where(~tagged).orderBy("o").limit(chains))
    return train_field([([t.split(" ") for t in r.tokens], list(r.tags)) for r in sample.orderBy("o").collect()])


class _Numbers(dict):
    """Words by the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Scanner:
    """All spans of texts: the base ones, and those of the field that meet none.

    Texts are scored together, about a million characters at a time. What counts of a score is how far begin and inside lie
    above outside; a word adds a fixed amount to that at its own place and at those beside it, so a text's scores are sums of
    five rows of one table. Texts in which no token can gain by not being outside, by a bound, need no decoding.
    """

    def __init__(self, model: ChainField, most: int = 200_000, together: int = 1_000_000):
        """Amounts of a word are kept; beyond ``most`` words they are dropped."""
        self.model, self.most, self.together = model, most, together
        self.own: dict[tuple, np.ndarray] = {}  # by traits
        self.beside: dict[str, np.ndarray] = {}
        places = [str(b) for b in BESIDE]
        for f, at in model.index.items():
            step, _, form = f.partition(":")
            if step in places:
                k = 2 + 2 * places.index(step)
                self.beside.setdefault(form, np.zeros(2 + 2 * len(BESIDE)))[k : k + 2] = _gains(model.emit[at])
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.known = _Numbers(), np.zeros((0, 2 + 2 * len(BESIDE)))

    def _learn(self) -> None:
        """Amounts of the words that were numbered since the last time."""
        had = len(self.seen)
        new = list(islice(reversed(self.numbers), len(self.numbers) - had))[::-1]
        rows = np.zeros((len(new), self.known.shape[1]))
        for row, w in zip(rows, new, strict=True):
            if (seen := self.beside.get(beside_form(w))) is not None:
                row += seen
            if w:
                if (own := self.own.get(key := traits(w))) is None:
                    own = self.own[key] = _gains(self.model.score(own_features(w)))
                row[:2] = own
        if len(self.numbers) > len(self.known):
            self.known = np.concatenate([self.seen, np.zeros((max(had, len(new), 1024), rows.shape[1]))])
        self.known[had : len(self.numbers)] = rows
        self.seen = self.known[: len(self.numbers)]

    def gains(self, texts: list[list[str]], files: np.ndarray) -> np.ndarray:
        """How far begin and inside lie above outside, for all words of ``texts``, one after another; ``files``: what the
        features of each text add."""
        if len(self.numbers) > self.most:
            self._forget()
        self.seen = self.known[: len(self.numbers)]
        words = [w for t in texts for w in (*t, "", "")]  # nothing stands beside a text's ends
        ids = np.fromiter(map(self.numbers.__getitem__, ["", "", *words]), np.int64, len(words) + 2)
        if len(self.numbers) > len(self.seen):
            self._learn()
        each, n = self.known[ids], len(words)
        out = each[2:, :2].copy()
        for k, step in enumerate(BESIDE, 1):
            lo, hi = max(0, 2 + step), min(n + 2, n + 2 + step)
            out[lo - 2 - step : hi - 2 - step] += each[lo:hi, 2 * k : 2 * k + 2]
        counts = np.array([len(t) for t in texts])
        keep = np.ones(n, dtype=bool)
        ends = np.cumsum(counts + 2)
        keep[ends - 1] = keep[ends - 2] = False
        return out[keep] + np.repeat(files, counts, axis=0)

    def many(self, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """(base spans, all spans) of every text."""
        out, start, size = [], 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= self.together or k + 1 == len(texts):
                out += self._some(texts[start : k + 1])
                start, size = k + 1, 0
        return out

    def _some(self, texts: list[str]) -> list:
        base = [base_spans(t) for t in texts]
        added: list[list] = [[] for _ in texts]
        if self.model.index:
            words = [_TOKEN.findall(t) for t in texts]
            gains = self.gains(words, np.array([_gains(self.model.score(file_features(t))) for t in texts]))
            ends, bound = np.cumsum([len(w) for w in words]), self.model.bounds(gains)
            first = np.array([e - len(w) for e, w in zip(ends.tolist(), words, strict=True) if w], dtype=np.int64)
            bound[first] = np.maximum(bound[first], gains[first, 0])
            least = -max(0.0, self.model.leaving) - 1e-6
            able = np.unique(np.searchsorted(ends, np.flatnonzero(bound > least), side="right"))
            for k in able.tolist():
                a, b = int(ends[k]) - len(words[k]), int(ends[k])
                tags = self.model.tags(np.column_stack([np.zeros(b - a), gains[a:b]]))
                if tags.any():
                    added[k] = self._spans(texts[k], tags, base[k])
        return [(b, sorted([*b, *more], key=lambda s: (s[0], s[2]))) for b, more in zip(base, added, strict=True)]

    def _spans(self, text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        spans: list[list[int]] = []
        for m, tag in zip(_TOKEN.finditer(text), tags.tolist(), strict=True):
            if tag == B:
                spans.append([*m.span()])
            elif tag == I:
                spans[-1][1] = m.end()
        out, k, reach = [], 0, 0
        for a, b in spans:  # both by start; ``reach``: how far the base spans that start before ``b`` go
            while k < len(base) and base[k][0] < b:
                reach, k = max(reach, base[k][1]), k + 1
            if reach <= a:
                out.append((a, b, 3))
        return out

    def __call__(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        return self.many([text])[0]


def _gains(scores: np.ndarray) -> np.ndarray:
    return scores[1:] - scores[0]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, model: ChainField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, a digest of the base spans, and all spans of every whole text."""

    def make():
        scan = Scanner(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = scan.many(batch.column(1).to_pylist())
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in range(3)]
            digests = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([_joined(s) for _, s in found], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [F.col(id_col).alias("doc_id"), F.col(text_col)], make, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """``text`` with each stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: ChainField, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets in their texts replaced; all rows and columns stay."""
    place = docs.columns.index(text_col)

    def clean(batches):
        scan = Scanner(model)
        for whole in batches:
            for batch in slices(whole, place):
                texts = batch.column(place).to_pylist()
                new = pa.array([t if t is None else redacted(t, spans) for t, (_, spans) in zip(texts, scan.many([t or "" for t in texts]), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([new if k == place else batch.column(k) for k in range(batch.num_columns)], names=batch.schema.names)

    return docs.mapInArrow(clean, docs.schema)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, fit_field(docs))
