"""A run-length index: run-compressed Burrows-Wheeler transform, suffix positions sampled at the ends of its runs.

:meth:`RunLengthIndex.matching_statistics` streams a text from its end: for every position the length of the longest match
of the text from there on with the indexed texts, and where one such match lies. While the transform's character before the
current suffix is the text's next one, the match grows by a step back; otherwise it moves to the nearest run of that
character above or below, whichever suffix agrees longer. :meth:`long_matches` marks the stretches covered by matches of a
minimum length. The index is as large as the number of runs, which repetitive texts keep small, beside the texts themselves.

An index is built in memory for a bounded set of texts. Matches cross no border between texts.
"""

from __future__ import annotations

import numpy as np


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling."""
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    n, width = len(values), 1
    while True:
        after = np.full(n, -1, dtype=np.int64)
        after[: n - width] = rank[width:]
        order = np.lexsort((after, rank))
        new = np.ones(n, dtype=np.int64)
        new[0] = 0
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        rank[order] = np.cumsum(new)
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        width *= 2


class RunLengthIndex:
    END, BORDER = 0, 1  # below all bytes, which are held plus 2

    def __init__(self, texts: list[bytes]):
        parts = []
        for t in texts:
            parts += [np.frombuffer(t, np.uint8).astype(np.int16) + 2, np.array([self.BORDER], dtype=np.int16)]
        self.text = np.concatenate([*parts, np.array([self.END], dtype=np.int16)])
        order = suffix_array(self.text)
        last = self.text[order - 1]  # the character before each suffix
        self.size = len(last)
        self.starts = np.concatenate([[0], np.flatnonzero(last[1:] != last[:-1]) + 1])
        self.ends = np.concatenate([self.starts[1:], [self.size]]) - 1
        self.chars = last[self.starts]
        self.at_start, self.at_end = order[self.starts], order[self.ends]
        lengths = self.ends - self.starts + 1
        self.before = np.zeros(258, dtype=np.int64)  # suffixes that begin with a smaller character
        counts = np.bincount(last, minlength=258)
        self.before[1:] = np.cumsum(counts)[:-1]
        self.runs_of = {int(c): np.flatnonzero(self.chars == c) for c in np.unique(self.chars)}
        self.seen = np.zeros(len(self.starts), dtype=np.int64)  # of the run's character, before the run
        for runs in self.runs_of.values():
            self.seen[runs] = np.cumsum(lengths[runs]) - lengths[runs]

    @property
    def runs(self) -> int:
        return len(self.starts)

    def _step(self, run: int, row: int) -> int:
        """The row of the suffix one character longer."""
        return int(self.before[self.chars[run]] + self.seen[run] + row - self.starts[run])

    def _agree(self, a: int, b: int, most: int) -> int:
        """How far the suffixes at ``a`` and ``b`` agree, up to ``most``."""
        n = min(most, self.size - max(a, b))
        differ = np.flatnonzero(self.text[a : a + n] != self.text[b : b + n])
        return int(differ[0]) if len(differ) else n

    def matching_statistics(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, places in the joined texts) for every position of ``text``."""
        lengths, places = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=np.int64)
        run, row = 0, 0
        place, length = int(self.at_start[0]), 0
        for i in range(len(text) - 1, -1, -1):
            c = text[i] + 2
            if self.chars[run] == c:
                length += 1
            elif (own := self.runs_of.get(c)) is None:
                length = 0
                continue
            else:
                k = int(np.searchsorted(own, run))
                ways = []
                if k:
                    up = int(own[k - 1])
                    ways.append((self._agree(place, int(self.at_end[up]), length), up, int(self.ends[up]), int(self.at_end[up])))
                if k < len(own):
                    down = int(own[k])
                    ways.append((self._agree(place, int(self.at_start[down]), length), down, int(self.starts[down]), int(self.at_start[down])))
                length, run, row, place = max(ways)
                length += 1
            row, place = self._step(run, row), place - 1
            run = int(np.searchsorted(self.starts, row, side="right")) - 1
            lengths[i], places[i] = length, place
        return lengths, places

    def long_matches(self, text: bytes, length: int) -> list[tuple[int, int]]:
        """Stretches of ``text`` covered by matches of at least ``length``."""
        lengths, _ = self.matching_statistics(text)
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(lengths >= length).tolist():
            end = i + int(lengths[i])
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((i, end))
        return out
