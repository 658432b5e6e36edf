"""Training-data operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from rollview.llm.components import components
from rollview.llm import bpe, chat, line_dedup, near_dedup, packing, quality, queries, secrets, substrings, topk, toxicity
from rollview.llm.tokens import Encoder, chunks, read_ranks

#: Nulls, empty and odd texts, copies under other ids, repeated rows, and columns whose names operators use themselves.
ODD = [None, "", " ", "a", "a  b   c\n\n \td", "  lead", "tail  ", "x\r\ny", "don't we'll 12 345!!", "é ß 漢字 \U0001f600", "<|endoftext|>", "word " * 700, "z" * 3000, "one two three four five six seven\n" * 40]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "bucket", 1, 1) for i, t in enumerate([*ODD, *ODD])]
    rows += [rows[5], (None, "a text without an id", None, "x", 1, 1), (90, "a text without an id", None, "x", 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, bucket string, length int, task int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())


def empty(df):
    return df.limit(0)


def encoder():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_chunks_keep_matches():
    import regex

    pattern = regex.compile(P.PATTERN)
    for t in ODD[1:]:
        assert [m for c in chunks(t) for m in pattern.findall(c)] == pattern.findall(t)


def test_encoder_gives_the_ids_of_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = Encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    for t in [*ODD[1:], "a <|endoftext|> b", "<|endoftext|>  <|endoftext|><|endoftext|>x <|endoftext", "tail  <|endoftext|>\n\n head"]:
        assert encode(t) == whole.encode(t, add_special_tokens=False).ids
    assert 50256 in encode("a <|endoftext|> b")


def test_bpe_round_trip(odd, docs):
    reference = encoder()
    for r in bpe.encode_documents(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        text = (ODD[r.doc_id % len(ODD)] or "") if r.doc_id is not None and r.doc_id < 90 else "a text without an id"
        ids = reference.encode_ordinary(text)
        assert r.ids == " ".join(map(str, ids)) and r.n_tokens == len(ids) and bytes(r.decoded) == text.encode()
    model = bpe.ByteLevelBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in list(docs.values())[:40]:
        assert model.encode(t) == " ".join(map(str, reference.encode_ordinary(t)))
    assert empty(bpe.encode_documents(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).count() == 0


def check_packing(rows, most):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(places), sum(r.length for r in rows)


def test_packing(spark, odd, sf_dir):
    packed = packing.pack_documents(odd, packing.Capacities(256), with_ids=True)
    rows, reference = packed.collect(), Encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    n, total = check_packing(rows, 256)
    assert n <= -(-total // 256) + 1
    by = defaultdict(list)
    for r in rows:
        if r.doc_id is not None and r.doc_id < len(ODD) and r.doc_id != 5:
            by[r.doc_id].append(r)
    for i, parts in by.items():
        ids = np.array([*reference(ODD[i] or ""), 0], "<u4")
        parts.sort(key=lambda r: r.piece)
        assert b"".join(bytes(p.ids) for p in parts) == ids.tobytes()
        assert all(p.length == 256 for p in parts[1:]) and all(p.ids_crc32 == zlib.crc32(bytes(p.ids)) for p in parts)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert sum(map(len, whole.values())) == 4 * total
    assert packing.pack_documents(empty(odd), packing.Capacities(256)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_capacity(rule):
    capacities = packing.Capacities(100, documents=4, attention=4500)
    histogram = {60: 7, 41: 5, 30: 11, 17: 9, 3: 50, 1: 13}
    bins, seen = defaultdict(list), Counter()
    for length, first, each, count, sequence, offset in packing.plan_bins(histogram, capacities, rule=rule):
        assert first == seen[length]
        seen[length] += each * count
        for k in range(count):
            bins[sequence + k] += [(offset + j * length, length) for j in range(each)]
    assert dict(seen) == histogram
    for parts in bins.values():
        assert len(parts) <= 4 and sum(n for _, n in parts) <= 100 and sum(n * n for _, n in parts) <= 4500
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]


def brute_lines(texts, min_chars, min_docs):
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark):
    line = "The same line of more than forty characters Ä"
    texts = {i: "\n".join([f"own {i}", ("  " + line.upper().replace("Ä", "Ä")) if i % 3 else line + "\t", line, "short"]) for i in range(12)}
    texts |= {20: None, 21: "", 22: line * 2, 23: "\n\n"}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(3, texts[3], "x")], "doc_id long, text string, h1 string")
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)  # with many tasks one line crosses their edges
        kept = line_dedup.drop_lines(df)
        assert kept.columns == df.columns
        want = brute_lines(texts, 40, 5)
        for r in kept.collect():
            assert r.text == (None if texts[r.doc_id] is None else want[r.doc_id][2])
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert line_dedup.drop_lines(empty(df)).count() == 0


def compare(con, df, sql):
    found = con.sql(sql)
    at = [found.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    compare(con, queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name])


def brute_classes(texts, similarity=0.8):
    sets = {i: near_dedup.shingles(near_dedup.words_of(t or "")) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a]) and len(sets[b]) and near_dedup.probability_jaccard(np.sort(sets[a]), np.sort(sets[b])) >= similarity:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in texts}


def test_near_dedup(spark):
    random = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    texts, base = {}, list(random.choice(words, 150))
    for i in range(60):  # a family of copies, each with some words changed
        copy = list(base)
        for k in random.integers(0, 150, i % 7):
            copy[k] = str(random.choice(words))
        texts[i] = " ".join(copy)
    texts |= {100 + i: " ".join(random.choice(words, 80)) for i in range(20)}
    texts |= {200: None, 201: "", 202: "two words", 203: "Two  words", 204: "three little words", 205: texts[7].upper()}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(4, texts[4], 1)], "doc_id long, text string, n int")
    found = {r.doc: r["class"] for r in near_dedup.near_classes(df).collect()}
    assert found == brute_classes(texts)
    kept = near_dedup.drop_near_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, c in found.items() if i == c}
    assert near_dedup.near_classes(empty(df)).count() == 0


@pytest.mark.parametrize("per_task", [100_000, 90, 30])
def test_components(spark, per_task):
    random = np.random.default_rng(9)
    links = [(int(a), int(b)) for a, b in random.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(40)]
    root = {n: n for link in links for n in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    random.shuffle(links)
    df = spark.createDataFrame([tuple(map(int, x)) for x in links], "a long, b long")
    found = dict(map(tuple, components(df, per_task).select("node", "component").collect()))
    tied = {n for a, b in links if a != b for n in (a, b)}
    assert found == {n: find(n) for n in tied} and found[1040] == 1000
    assert components(empty(df), per_task).count() == 0


def test_prob_minhash_estimates_probability_jaccard():
    random = np.random.default_rng(5)
    keys = random.integers(1, 1 << 62, 60).astype(np.uint64)
    a, b = keys[:45], keys[15:]
    wa, wb = random.integers(1, 9, 45), random.integers(1, 9, 45)
    signatures = near_dedup.prob_minhash(np.concatenate([a, b]), np.concatenate([wa, wb]).astype(float), np.repeat([0, 1], 45), 2, 4096)
    exact = near_dedup.probability_jaccard(np.sort(np.repeat(a, wa)), np.sort(np.repeat(b, wb)))
    assert abs((signatures[0] == signatures[1]).mean() - exact) < 0.03
    p, q = dict(zip(a.tolist(), wa / wa.sum())), dict(zip(b.tolist(), wb / wb.sum()))
    plain = sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in {*p, *q}) for i in p if i in q)
    assert abs(exact - plain) < 1e-9


def brute_substrings(texts, length):
    first, out = {}, {}
    for i in sorted(texts):
        b, goes = (texts[i] or "").encode(), set()
        for k in range(len(b) - length + 1):
            if first.setdefault(b[k : k + length], i) < i:
                goes.update(range(k, k + length))
        spans = sum(k - 1 not in goes for k in goes)
        out[i] = (len(b), len(goes), spans, bytes(c for k, c in enumerate(b) if k not in goes))
    return out


def test_substrings(spark):
    random = np.random.default_rng(7)
    letters = lambda n: "".join(random.choice(list("abcdeé \n"), n))
    passage, other = letters(120), letters(60)
    texts = {i: letters(50) + passage[i % 3 : 100 + i] + letters(30) + other for i in range(12)}
    texts |= {20: None, 21: "", 22: "a" * 300, 23: "a" * 49, 24: "ba" + "a" * 80, 25: texts[3], 26: texts[3] + texts[4], 27: other[:49]}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(25, texts[25], 1)], "doc_id long, text string, version int")
    want = brute_substrings(texts, 50)
    found = substrings.remove_repeats(df).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
    assert substrings.remove_repeats(empty(df)).count() == 0


@pytest.mark.parametrize("bits", [64, 6, 1])
def test_substrings_of_one_hash_are_told_apart(monkeypatch, bits):
    random, length, real = np.random.default_rng(11), 50, substrings.hash_runs
    passage = bytes(random.integers(97, 100, 70).astype(np.uint8))
    texts = {i: passage[i % 4 : 66] + bytes(random.integers(97, 100, 20).astype(np.uint8)) for i in range(9)}
    monkeypatch.setattr(substrings, "hash_runs", lambda *a: real(*a) & np.uint64((1 << bits) - 1))
    head = np.array([(d, 0, 0, len(t)) for d, t in texts.items()], dtype="<i8")
    import struct

    import pandas as pd
    import zstandard

    data = zstandard.ZstdCompressor().compress(struct.pack("<q", len(texts)) + head.tobytes() + b"".join(texts.values()))
    scattered = []
    monkeypatch.setattr(substrings, "_scatter", lambda parts, *columns: scattered.append(np.column_stack(columns)))

    class Segments:  # runs the function of a bucket here
        groupBy = lambda self, *_: self
        applyInPandas = lambda self, run, *_: run(pd.DataFrame({"bucket": [0], "kind": [0], "data": [data]}))

    monkeypatch.setattr(substrings, "_gather", lambda *_, **__: None)
    substrings._gone(Segments(), length, 1)
    gone = {i: set() for i in texts}
    for doc, _, a, b in np.concatenate(scattered).tolist():
        gone[doc] |= set(range(a, b))
    want = brute_substrings({i: t.decode() for i, t in texts.items()}, length)
    assert {i: len(g) for i, g in gone.items()} == {i: n for i, (_, n, _, _) in want.items()}


def test_substrings_of_rows_that_share_an_id(spark):
    random = np.random.default_rng(5)
    letters = lambda n: "".join(random.choice(list("abcdeé \n"), n))
    passages = [letters(90) for _ in range(6)]
    rows = [(i % 40 if i < 120 else 1000 + i, letters(20) + passages[i % 6] + letters(int(random.integers(0, 60))) + passages[i * 5 % 6][:60]) for i in range(180)]
    rows += [(None, passages[0] + letters(9)), (None, letters(9) + passages[1]), (3, rows[3][1]), (-(1 << 62), passages[2]), (1 << 62, passages[2])]
    first, want = {}, []
    order = lambda r: -(1 << 63) if r[0] is None else r[0]
    for r in sorted(rows, key=order):
        b, goes = r[1].encode(), set()
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], order(r)) < order(r):
                goes.update(range(k, k + 50))
        want.append((order(r), len(b), len(goes), sum(k - 1 not in goes for k in goes), bytes(c for k, c in enumerate(b) if k not in goes)))
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((order(r[:1]), *r[1:4], bytes(r.kept)) for r in found) == sorted(want)
    alone = spark.createDataFrame([r for r in rows if r[0] and r[0] > 1000], "doc_id long, text string")
    assert [r.version for r in substrings.repeated_stretches(alone).select("version").distinct().collect()] == [0]


def test_substrings_move_no_more_in_many_buckets(spark):
    random = np.random.default_rng(3)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of ", "or ", "nt ", "ea ", "ti", "to ", "it "]
    texts = ["".join(random.choice(syllables, 1600)) for _ in range(400)]
    rows = [(i, texts[i], 0) for i in range(400)] + [(400 + i, texts[2 * i][: 100 + 9 * i], 0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(2).cache()
    moved, real = {}, {}
    for buckets in (8, 120):
        with pytest.MonkeyPatch.context() as patch:
            sizes = {}
            for name in ("_anchors", "_segments"):

                def measured(*a, name=name, of=getattr(substrings, name)):
                    out = of(*a).cache()
                    sizes[name] = out.selectExpr("sum(length(data))").first()[0]
                    return out

                patch.setattr(substrings, name, measured)
            patch.setattr(substrings, "shuffle_partitions", lambda _, n=buckets: n)
            real[buckets] = sorted((r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(df).collect())
        moved[buckets] = sizes
    assert real[8] == real[120] and sum(r[1] for r in real[8]) > 100_000
    assert all(moved[120][k] < 1.3 * moved[8][k] for k in moved[8]), moved


def test_substrings_of_a_large_bucket_are_compared_in_parts(monkeypatch):
    import struct
    import tracemalloc

    import pandas as pd
    import zstandard

    random, n, held = np.random.default_rng(4), 20_000, []
    texts = random.integers(97, 123, (n, 80)).astype(np.uint8)
    texts = np.concatenate([texts, texts, texts])  # the segments of ids below n come again, twice
    head = np.column_stack([np.arange(3 * n), np.zeros(3 * n), np.full(3 * n, 7), np.full(3 * n, 80)]).astype("<i8")
    data = zstandard.ZstdCompressor().compress(struct.pack("<q", 3 * n) + head.tobytes() + texts.tobytes())

    class Segments:  # runs the function of a bucket here
        groupBy = lambda self, *_: self
        applyInPandas = lambda self, run, *_: run(pd.DataFrame({"bucket": [0], "kind": [0], "data": [data]}))

    monkeypatch.setattr(substrings, "_scatter", lambda parts, *columns: held.append(np.column_stack(columns)))
    monkeypatch.setattr(substrings, "_gather", lambda *_, **__: None)
    monkeypatch.setattr(substrings, "STRINGS", 100_000, raising=False)
    tracemalloc.start()
    substrings._gone(Segments(), 50, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(map(tuple, held[0].tolist())) == [(i, 0, 7, 87) for i in range(n, 3 * n)]
    assert most < 25 * 31 * 3 * n, most  # bytes; 31 strings a segment


@pytest.mark.parametrize("factor", [None, 0])
def test_segments_of_one_hash_are_told_apart(monkeypatch, factor):
    random = np.random.default_rng(8)
    texts, size = random.integers(97, 99, (400, 80)).astype(np.uint8), random.integers(50, 53, 400)
    texts[:, 3:] = 97
    texts[np.arange(80) >= size[:, None]] = 0
    doc, least = random.integers(0, 1000, 400), {}
    if factor is not None:
        monkeypatch.setattr(substrings, "_M", (np.uint64(factor),) * 5)
    rows = [t[:k].tobytes() for t, k in zip(texts, size.tolist(), strict=True)]
    for t, d in zip(rows, doc.tolist(), strict=True):
        least[t] = min(d, least.get(t, d))
    assert substrings._least_holder(texts, size, doc).tolist() == [least[t] for t in rows]


def test_substrings_of_whole_copies_are_not_sent_again(spark, monkeypatch):
    random, sent = np.random.default_rng(6), []
    texts = ["".join(random.choice(list("abcdeé \n"), 900)) for _ in range(40)] + ["b" * 50, "b" * 49, "é" * 24, ""]

    def measured(*a, of=substrings._segments):
        out = of(*a).cache()
        sent.append(out.selectExpr("sum(length(data))").first()[0])
        return out

    monkeypatch.setattr(substrings, "_segments", measured)
    for copies in (2, 6):  # each set of copies in a task of its own
        table = {len(texts) * k + i: t for k in range(copies) for i, t in enumerate(texts)}
        df = spark.createDataFrame(list(table.items()), "doc_id long, text string").repartitionByRange(copies, "doc_id")
        want = brute_substrings(table, 50)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(df).collect()} == want
    assert sent[1] < 1.5 * sent[0], sent


def test_top_k_ties_and_odd_vectors(spark):
    random = np.random.default_rng(2)
    rows = [(i, [float(x) for x in random.normal(0, 1, 6)]) for i in range(240)]
    rows += [(240 + i, [0.5] * 6) for i in range(60)]  # copies: ties go to the smaller id
    rows += [(400, None), (450, [float("nan")] * 6), (451, [None, 1.0]), (500, [1.0, float("inf")]), (550, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    s = topk.Settings(pivots=5, rings=3, block=40, queries=3)
    found = defaultdict(list)
    for r in topk.top_k(df, lambda i: i % 50 == 0, s).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = {i: np.array([int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (6 - len(v))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in whole if i % 50 == 0]:
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(found[q]) == [(k + 1, i, -x) for k, (x, i) in enumerate(best)]
    assert set(found) == {i for i in whole if i % 50 == 0}
    assert topk.top_k(empty(df), lambda i: i % 50 == 0).count() == 0


def test_top_k_repeated_query_ids(spark, tmp_path):
    random = np.random.default_rng(7)
    rows = [(i, [float(x) for x in random.normal(0, 1, 6)]) for i in range(1, 200) if i % 50]
    for q in (50, 100, 150):  # a query id with several vectors, one of them twice
        rows += [(q, [float(x) for x in random.normal(0, 1, 6)]) for _ in range(3)]
    rows += [rows[-1], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    for parts in (1, 7):
        found = topk.top_k(df.repartition(parts), lambda i: i % 50 == 0, topk.Settings(pivots=5, rings=3, block=40, queries=3))
        assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == sorted(con.sql(topk.ORACLE_SQL).fetchall())


def cheapest(roles, costs):
    best = {chat.START: 0}
    for r in roles:
        new = {}
        for a, cost in best.items():
            for b in (1, 2, 3):
                change = 0 if b == r else costs.relabel
                ways = [cost + change + costs.merge] if a == b else []
                if chat.INSERTS[a, b] is not None:
                    ways.append(cost + change + costs.insert * len(chat.INSERTS[a, b]))
                for w in ways:
                    new[b] = min(new.get(b, 10**9), w)
        best = new
    return min(c + costs.insert * len(chat.ENDINGS[a]) for a, c in best.items())


@pytest.mark.parametrize("parts", [1, 5])
def test_chat_repair(spark, parts):
    random = np.random.default_rng(parts)
    kinds = ["system", "user", "Assistant ", "tool", None]
    talks = {k: [kinds[j] for j in random.integers(0, 5, n)] for k, n in enumerate([1, 2, 3, 5, 8, 200])}
    rows = [(k, i, r, None if i == 1 else f"t{i}.") for k, rs in talks.items() for i, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)  # long conversations cross tasks
    found = defaultdict(list)
    for r in chat.repair_chats(df).collect():
        found[r.conv_id].append(r)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    for k, roles in talks.items():
        assert sum(r.cost for r in found[k]) == cheapest([chat.role_state(r) for r in roles], chat.Costs())
        text = "".join(r.piece for r in sorted(found[k], key=lambda r: (r.place, r.part)))
        turns = re.findall(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", text, re.DOTALL)
        assert "".join(f"<|{a}|>\n{t}\n<|end|>\n" for a, t in turns) == text
        states = [chat.START, *(chat.ROLES.index(a) + 1 for a, _ in turns)]
        assert all(b in chat.NEXT[a] for a, b in zip(states, states[1:], strict=False)) and states[-1] == chat.ASSISTANT
        assert re.findall(r"t\d+\.", text) == [f"t{i}." for i in range(len(roles)) if i != 1]
    assert chat.repair_chats(empty(df)).count() == 0


def test_chat_order_of_equal_turn_numbers(spark):
    rows = [(1, 7, ("user", "assistant")[i % 2], f"t{i:03d}.", "x") for i in range(200)] + [(None, None, "user", None, "x")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    found = [r for r in chat.repair_chats(df).collect() if r.conv_id == 1]
    assert len({(r.place, r.part) for r in found}) == len(found) and {r.place for r in found} == set(range(200))
    text = "".join(r.piece for r in sorted(found, key=lambda r: (r.place, r.part)))
    roles = [x for x in re.findall(r"<\|(\w+)\|>", text) if x != "end"]
    assert roles[0] == "user" and roles[-1] == "assistant" and all(a != b for a, b in zip(roles, roles[1:], strict=False))
    assert sorted(re.findall(r"t\d+\.", text)) == [f"t{i:03d}." for i in range(200)]


def test_secrets(spark, odd):
    texts = ['password = "hunter22x" and token: abc', "AKIA" + "A1" * 9 + " " + "0f" * 12, "Api_Key=abcdefg secret:'x'", *[t or "" for t in ODD]]
    for t in texts:
        spans = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in secrets.HEX.finditer(t) if len(m[0]) >= 24]
        assert secrets.base_spans(t) == [(a, b, k) for a, k, b in sorted(spans)]
    random = np.random.default_rng(1)
    value = lambda: "".join(random.choice(list("0123456789abcdef"), 40))
    rows = [(i, f'some words here {i} token = "{value()}" and more words after it' if i % 2 else f"call +1 (555) 123-4567 on day {i} about item {i}.", 1) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    field = secrets.fit_field(df)
    scan = secrets.Scanner(field)
    odd_key = f'some words here 7 ticket = "{value().upper()}" and more'  # no base pattern knows this
    base, spans = scan(odd_key)
    assert not base and [odd_key[a:b] for a, b, _ in spans] == [odd_key.split('"')[1]]
    assert all(scan(r[1])[1] == secrets.base_spans(r[1]) for r in rows)
    clean = secrets.redact(df, field)
    assert clean.columns == df.columns and not [r for r in clean.collect() if secrets.base_spans(r.text)]
    assert secrets.scan_secrets(odd, field).count() == odd.count() and secrets.scan_secrets(empty(odd), field).count() == 0


def test_secrets_are_learnt_from_whole_texts(spark):
    random = np.random.default_rng(3)
    value = lambda: "".join(random.choice(list("0123456789abcdef"), 40))
    rows = [(i, "some words here\n" * 1500 + f'and token = "{value()}" at the end') for i in range(12)]  # beyond 20,000 characters
    field = secrets.fit_field(spark.createDataFrame(rows, "doc_id long, text string"))
    assert field.index and secrets.fit_field(spark.createDataFrame(rows, "doc_id long, text string"), chains=1).emit.shape != field.emit.shape
    late = "some words here\n" * 1500 + f'and ticket = "{value().upper()}" at the end'
    assert [late[a:b] for a, b, _ in secrets.Scanner(field)(late)[1]] == [late.split('"')[1]]
    cut = list(secrets.pieces(list(range(200)), [secrets.B, *[secrets.I] * 99, *[secrets.O] * 100]))
    assert [len(t) for t, _ in cut] == [100, 64, 36] and sum((t for t, _ in cut), []) == list(range(200))


def test_field_sees_all_tokens():
    random = np.random.default_rng(5)
    letters = lambda n: "".join(random.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), n))
    train = [c for _ in range(150) for c in secrets.tagged_chains(f'some words here password: {letters(16)} and more words follow after it. The bearer came home.')]
    field = secrets.train_field(train)
    text = "some words here bearer QwErTyUiOpAsDfGh and more words follow after it"  # no digit, sign or long run anywhere
    base, spans = secrets.Scanner(field)(text)
    assert not base and [text[a:b] for a, b, _ in spans] == ["QwErTyUiOpAsDfGh"]
    words = secrets._TOKEN.findall(text) * 3
    slow = np.array([field.score(secrets.token_features(words, i, ["signs0"])) for i in range(len(words))])
    scan, file = secrets.Scanner(field, most=4), field.score(["signs0"])
    together = np.array([file[1:] - file[0]] * 3)
    for _ in range(3):
        assert np.allclose(scan.gains([words, [], words[:5]], together)[: len(words)], slow[:, 1:] - slow[:, :1])
    texts = [text, "", "a", text * 2, "no secret here", text[::-1], *(t or "" for t in ODD)]
    one_by_one = [secrets.Scanner(field)(t) for t in texts]
    for size in (1, 100, 10**6):
        assert secrets.Scanner(field, most=50, together=size).many(texts) == one_by_one
    for t, (base, spans) in zip(texts, one_by_one, strict=True):  # against Viterbi over all tokens
        tokens = [m.span() for m in secrets._TOKEN.finditer(t)]
        of_file, own = secrets.file_features(t), [t[a:b] for a, b in tokens]
        tags = field.decode([secrets.token_features(own, i, of_file) for i in range(len(own))]) if own else []
        found = []
        for (a, b), tag in zip(tokens, tags, strict=True):
            if tag == secrets.B:
                found.append([a, b])
            elif tag == secrets.I:
                found[-1][1] = b
        assert [s for s in spans if s[2] == 3] == [(a, b, 3) for a, b in found if not any(x < b and a < y for x, y, _ in base)]
    for seed in range(300):  # bounds leave the best path as it is
        random = np.random.default_rng(seed)
        field = secrets.ChainField({"a": 0}, np.zeros((1, 3)), random.normal(0, 2, (3, 3)))
        scores = random.normal(0, 2, (40, 3)) + [random.uniform(0, 5), 0, 0]
        total = lambda tags: sum(scores[i, t] for i, t in enumerate(tags)) + sum(field.move[x, y] for x, y in zip(tags, tags[1:], strict=False))  # noqa: B023, E731
        assert abs(total(field.tags(scores).tolist()) - total(field.best_path(scores))) < 1e-6


def test_viterbi_is_best_path():
    random = np.random.default_rng(4)
    field = secrets.ChainField({"a": 0, "b": 1, "c": 2}, random.normal(0, 1, (3, 3)), random.normal(0, 1, (3, 3)))
    chain = [[x] for x in "abcab"]
    score = lambda tags: sum(field.emit[field.index[t[0]], y] for t, y in zip(chain, tags, strict=True)) + sum(field.move[x, y] for x, y in zip(tags, tags[1:], strict=False))
    import itertools

    legal = [t for t in itertools.product(range(3), repeat=5) if t[0] != secrets.I and not any(x == secrets.O and y == secrets.I for x, y in zip(t, t[1:], strict=False))]
    assert abs(score(field.decode(chain)) - max(map(score, legal))) < 1e-9


def test_quality(odd, docs):
    found = quality.score_quality(odd).collect()
    assert len(found) == odd.count() and quality.score_quality(empty(odd)).count() == 0
    for t in [*ODD, *list(docs.values())[:60]]:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        twice = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k : k + 3])] > 1}
        assert quality.repeated_words(quality.words_of(t)) == len(twice)
        assert quality.class_counts(t).sum() == len(t)
    assert quality.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1 and quality.distance(np.array([2.0, 2]), np.array([1.0, 1])) == 0


def test_quality_rejects_wrong_language_and_wordless_texts(spark):
    random = np.random.default_rng(8)
    common = {lang: [lang + chr(97 + k) for k in range(24)] for lang in "pq"}

    def text(n, lang=None):  # a third of the words are common ones, by falling frequency
        weights = 1 / np.arange(1, 25)
        rare = ["".join(random.choice(list("abcdefgh"), 7)) for _ in range(n)]
        return " ".join(str(random.choice(common[lang], p=weights / weights.sum())) if lang and random.random() < 0.34 else w for w in rare)

    prose = [(i, text(int(random.integers(60, 600)), "pq"[i % 2]), "pq"[i % 2]) for i in range(300)]
    odd = [(1000 + i, text(n, other), lang) for i, (n, other, lang) in enumerate([(n, o, x) for n in (60, 150, 500) for o, x in ((None, "p"), (None, "q"), ("q", "p"), ("p", "q"), (None, None))])]
    unnamed = [(2000 + i, text(n, lang), None) for i, (n, lang) in enumerate([(60, "p"), (150, "q"), (500, "p")])]
    df = spark.createDataFrame([*prose, *odd, *unnamed], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality.score_quality(df).collect()}
    assert not any(r.base_failed for r in found.values())
    assert not [i for i, _, _ in odd if found[i].kept]
    assert all(found[i].kept for i, _, _ in unnamed) and np.mean([found[i].kept for i, _, _ in prose]) > 0.98


def test_common_words_have_any_length(spark):
    texts = {"de": "über einstweilen über einstweilen über der", "el": "όμως γιατί όμως γιατί όμως και", "th": "และก็ ทั้งหมด และก็ ทั้งหมด และก็ !"}
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    found = quality.learn_references(df, quality.Rules(common=2))
    expected = {"de": ("über", "einstweilen"), "el": ("όμως", "γιατί"), "th": ("และก็", "ทั้งหมด")}
    for lang, words in expected.items():
        assert list(found[lang].words) == [w.encode() for w in words] and list(found[lang].counts[:2]) == [3, 2]
        assert found[lang].counts.sum() == len(texts[lang].split())
        near = quality.distances(texts[lang] * 20, quality.words_of(" ".join([texts[lang]] * 20)), found[lang], quality.Rules())
        assert near[1] < 1e-6


def test_toxicity(spark, odd):
    random = np.random.default_rng(6)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        text = list(random.choice(words, 60))
        for k in random.integers(0, 60, 4 if bad else 0):
            text[k] = str(random.choice(["nasty", "vilest", "rottenly"]))
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    held = [r for r in toxicity.score_toxicity(df, model).collect() if r.held_out]
    assert all(toxicity.held_out(r.doc_id) for r in held) and len(held) > 400
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and np.mean([truth[r.doc_id] for r in kept.collect()]) < 0.02
    scores = toxicity.score_toxicity(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score_toxicity(odd, toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))).where("score > 0").count() == 0


def test_stages_on_odd_tables(spark, odd, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(28)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    clashing = odd.selectExpr("*", "1 as n_chars", "'k' as `key`", "2 as `lines`", "'d' as doc", "3 as `class`", "x'00' as version", "0 as hit", "'i' as id", "1.5 as y")
    for df in (clashing, empty(clashing)):
        at = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, at, str(tmp_path))
            assert after.columns == df.columns and [f.dataType for f in after.schema] == [f.dataType for f in df.schema], name
            kept = after.collect()
            assert len(kept) <= at.count() and all(r["key"] == "k" and r["lines"] == 2 and r["id"] == "i" for r in kept)
            at = spark.createDataFrame(kept, after.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
        assert {r.doc_id for r in last} == {r.doc_id for r in at.collect()}


def test_ids_must_be_integers(spark):
    df = spark.createDataFrame([("a", "some text", "user", "x")], "doc_id string, text string, role string, turn string")
    for run in (near_dedup.near_classes, line_dedup.keep_bitmaps, substrings.remove_repeats, lambda d: chat.repair_chats(d, conv_col="doc_id")):
        with pytest.raises(TypeError, match="integer ids"):
            run(df)


def test_pipeline_against_its_stages(spark, sf_dir, docs):
    import corpus_pipeline

    df, names = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, df, sf_dir)
        assert after.columns == df.columns
        before = {r.doc_id: r.text for r in df.collect()}
        rows = {r.doc_id: r.text for r in after.collect()}
        if name == "line_dedup":
            assert rows == {i: t for i, (_, _, t) in brute_lines(before, 40, 5).items()}
        if name == "near_dedup":
            assert set(rows) == {i for i, c in brute_classes(before).items() if i == c}
        if name == "secret_scans":
            assert set(rows) == set(before) and not [t for t in rows.values() if secrets.base_spans(t)]
        df = spark.createDataFrame(after.collect(), after.schema)
        names.append(name)
    assert names == ["toxicity", "line_dedup", "near_dedup", "secret_scans"]
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    n, total = check_packing(packed, 2048)
    assert n <= -(-total // 2048) + 1 and {r.doc_id for r in packed} == set(rows)
