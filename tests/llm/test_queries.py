"""The registered queries on the smallest tables, digests included, against plain versions of their contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from rollview.llm import chat, near_dedup, queries, toxicity
from rollview.llm.tokens import read_ranks


@pytest.fixture(scope="module")
def docs(sf_dir):
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf_dir}/documents.parquet'").fetchall())


def run(spark, sf_dir, name):
    rows = queries.queries()[name](spark, sf_dir).collect()
    return {r.doc_id: r for r in rows} if rows and "doc_id" in rows[0] and "piece" not in rows[0] else rows


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_op1(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    whole, pieces, bins = Tokenizer.from_file(P.path("byte_bpe_50k.json")), defaultdict(dict), defaultdict(list)
    for r in run(spark, sf_dir, "op1_best_fit_packing"):
        pieces[r.doc_id][r.piece] = r
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for i, parts in pieces.items():
        ids = np.array([*whole.encode(docs[i], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k in range(len(parts)):
            r = parts[k]
            assert r.start == at and (k == 0 or r.length == 2048) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and len(parts) == -(-len(ids) // 2048)
    for held in bins.values():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    assert len(bins) <= -(-sum(n for held in bins.values() for _, n in held) // 2048) + 1


def test_op2(spark, sf_dir, docs):
    sets = {i: np.sort(near_dedup.shingles(near_dedup.words_of(t))) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in docs if len(sets[i]))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if near_dedup.probability_jaccard(sets[a], sets[b]) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    found = run(spark, sf_dir, "op2_near_dedup")
    assert {i: r.class_id for i, r in found.items()} == {i: find(i) for i in docs} and all(r.kept == (i == r.class_id) for i, r in found.items())


def test_op3(spark, sf_dir):
    given = defaultdict(list)
    for conv, turn, role, text in duckdb.sql(f"select conv_id, turn, role, text from '{sf_dir}/conversations.parquet'").fetchall():
        given[conv].append((turn, role, text or ""))
    found = defaultdict(list)
    for r in run(spark, sf_dir, "op3_chat_formatting"):
        found[r.conv_id].append(r)
    assert set(found) == set(given)
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r.place, r.part))
        assert len({(r.place, r.part) for r in rows}) == len(rows) and sum(r.part == 0 for r in rows) == len(given[conv])
        states = [chat.START, *(chat.ROLES.index(r.role) + 1 for r in rows if "merge" not in r.action)]
        assert all(b in chat.NEXT[a] for a, b in zip(states, states[1:], strict=False)) and states[-1] == chat.ASSISTANT


def test_op5(spark, sf_dir, docs):
    import tiktoken

    reference = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    found = run(spark, sf_dir, "op5_byte_level_bpe")
    assert set(found) == set(docs)
    for i, r in found.items():
        ids = reference.encode_ordinary(docs[i])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(docs[i]))


def test_op6(spark, sf_dir, docs):
    found = run(spark, sf_dir, "op6_toxicity")
    assert set(found) == set(docs)
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) == toxicity.held_out(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def test_op8(spark, sf_dir, docs):
    found = run(spark, sf_dir, "op8_secret_scans")
    assert set(found) == set(docs)
    for i, r in found.items():
        spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, docs[i], re.IGNORECASE | re.ASCII) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", docs[i]) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", docs[i]) if len(m[0]) >= 24]
        joined = [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3)) and r.base_sha256 == sha(",".join(joined))
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("field:")] == joined


def test_op9(spark, sf_dir, docs):
    found = run(spark, sf_dir, "op9_quality_rules")
    assert set(found) == set(docs)
    for i, r in found.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[i])
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k : k + 3])] > 1}
        lines = [x for x in docs[i].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", docs[i])), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert sum(r.kept for r in found.values()) > len(docs) // 2


def test_op10(spark, sf_dir, docs):
    found, first = run(spark, sf_dir, "op10_suffix_dedup"), {}
    assert set(found) == set(docs)
    for i in sorted(docs):
        b = docs[i].encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:-1]).sum())
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, sha(kept))
