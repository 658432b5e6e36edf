"""Tokenising for byte-level BPE vocabularies.

:class:`Encoder` gives the ids of a vocabulary file; :func:`chunks` and :class:`Memo` let slower encoders work once per
distinct chunk. A byte-level BPE vocabulary encodes each match of its splitting pattern on its own. A space that follows
a character other than white space always starts a new match, and the end of a chunk before such a space matches as the
end of the text does. So a text may be cut before every such space, and equal chunks have equal ids wherever they stand.
"""

from __future__ import annotations

import base64
import json
import re

#: White space before a space: the space between belongs to a run, where the text is not cut.
_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_DOUBLE = re.compile(r"\s\s")


def chunks(text: str) -> list[str]:
    """``text`` cut before each space that follows a character other than white space."""
    if not text:
        return []
    if _RUN.search(text):
        return _CUT.split(text)
    head, *rest = text.split(" ")
    return [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]


class Memo(dict):
    """``memo[chunk]`` is ``encode(chunk)``; holds two generations of at most ``limit`` short chunks each."""

    def __init__(self, encode, limit: int = 50_000, longest: int = 48):
        super().__init__()
        self.encode, self.limit, self.longest, self.old = encode, limit, longest, {}

    def __missing__(self, chunk):
        value = self.old.get(chunk)
        if value is None:
            value = self.encode(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[chunk] = value
        return value


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: Latin-1 letters and signs stand for
    themselves, the other bytes take code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


#: For ``str.translate`` of bytes decoded as Latin-1.
SYMBOL_OF = dict(enumerate(byte_symbols()))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a rank file, or from the vocabulary of a byte-level BPE ``.json`` (its added tokens left out:
    they are no merges)."""
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    special = {x["content"] for x in whole.get("added_tokens", [])}
    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in whole["model"]["vocab"].items() if t not in special}


def read_added(path: str) -> dict[str, int]:
    """Ids of the tokens that a ``.json`` vocabulary adds to its merges; a rank file adds none."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens", [])
    if odd := [x["content"] for x in added if x.get("lstrip") or x.get("rstrip") or x.get("single_word")]:
        raise ValueError(f"added tokens that take blanks or stand alone are not known: {odd}")
    return {x["content"]: x["id"] for x in added}


class Encoder:
    """Ids of whole texts. Where a text holds the name of an added token, that is one id, and what lies between such names
    is encoded piece by piece.

    Where a text has no two white-space characters in a row, the pattern's look-ahead for runs decides nothing, and a
    pattern without it, which the regex engine runs several times faster, gives the same matches.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = read_ranks(path)
        self.whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        plain = pattern.replace(r"\s+(?!\S)|", "")
        self.plain = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ranks, special_tokens={})
        self.added = read_added(path)
        names = sorted(self.added, key=len, reverse=True)  # of names that begin together the longest counts
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None

    def __call__(self, text: str) -> list[int]:
        if self.split and any(name in text for name in self.added):
            return [i for k, part in enumerate(self.split(text)) for i in ([self.added[part]] if k % 2 else self._ordinary(part))]
        return self._ordinary(text)

    def _ordinary(self, text: str) -> list[int]:
        return (self.whole if _DOUBLE.search(text) else self.plain).encode_ordinary(text)
