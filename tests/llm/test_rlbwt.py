"""The run-length index against plain search."""

import numpy as np
import pytest

from rollview.llm.rlbwt import RunLengthIndex, suffix_array


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    random = np.random.default_rng(seed)
    draw = lambda n: bytes(random.choice(list(b"ab\x00\xff"[: 2 + seed % 3]), n).astype(np.uint8))
    base = draw(60)
    texts = [base, base[5:50] + draw(5), b"", draw(40), base]
    index = RunLengthIndex(texts)
    for text in (base, draw(80), base[20:] + b"z" + base[:30], b"", b"zz"):
        lengths, places = index.matching_statistics(text)
        for i in range(len(text)):
            longest = max(k for k in range(len(text) - i + 1) if any(text[i : i + k] in t for t in texts))
            assert lengths[i] == longest
            if longest:
                assert bytes((index.text[places[i] : places[i] + longest] - 2).astype(np.uint8)) == text[i : i + longest]
        covered = {p for i in range(len(text)) if lengths[i] >= 12 for p in range(i, i + lengths[i])}
        assert {p for a, b in index.long_matches(text, 12) for p in range(a, b)} == covered
    assert RunLengthIndex([base] * 20).runs < 3 * RunLengthIndex([base]).runs


def test_suffix_array():
    values = np.array([2, 3, 2, 3, 2, 0])
    assert suffix_array(values).tolist() == sorted(range(6), key=lambda i: values[i:].tolist())
