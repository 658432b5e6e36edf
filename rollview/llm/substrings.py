"""Exact removal of byte strings that documents with smaller ids hold too.

A byte goes if some string of ``length`` bytes (50) over it also starts in a document with a smaller id. Work is found by
hashes and decided on the bytes; only texts that equal another as a whole are told by their SHA-256. Those of ``length`` bytes
or more go but for the smallest document's, which holds all their strings, so they send anchors and nothing after that. Of the
others:

1. Anchors. A run of 20 bytes is an anchor if its hash is the least among all runs of 20 bytes of some 50-byte string over
   it. The least run of a string depends on the string alone, so documents that share a string share an anchor. Tasks send
   each distinct anchor once per block of text to the bucket of its hash; an anchor of two documents of one block is known
   to be shared there and then, so a passage that most documents hold is sent once per block and not once per document.
2. Shared anchors go back to their documents. Each string of 50 bytes belongs to its least run; the strings of a shared
   anchor are one segment of text, 50 to 80 bytes long. Equal segments of one block are settled there: all but the smallest
   document lose them. What is left goes, as bytes, to the bucket of its anchor.
3. In a bucket all strings of 50 bytes are grouped by hash, the bytes of each group are compared, and each group's smallest
   document keeps it. A task compares about a million strings at once: those of some shelves, into which the anchors of a
   bucket are divided, or of a part of one shelf's hashes.

No task sees more than a bucket of distinct segments, and nothing is sent for text that is nobody else's. Buckets grow in
number with the table, so a block sends each of them less: rows are packed so that small packs take little more a row. The named method,
streaming matching statistics over a run-length index, is in :mod:`.rlbwt`; the README says why it does not run here.

Defined results: a null text is empty; texts shorter than 50 bytes lose nothing; a document is an id, so strings that only
rows of the same id hold stay; null ids count as one document below all others; repeated rows fare alike; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_back, id_key, shuffle_partitions, slices, table

GRAM = 20
SHELVES = 32
#: Strings that a task compares at once, and segments that it holds before it sends them. They bound memory, not results.
STRINGS, SEGMENTS = 1_000_000, 250_000
_M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _words(blob: bytes | bytearray, at: int, n: int) -> np.ndarray:
    """The 8 bytes from each position on, as numbers."""
    return np.ndarray((n,), "<u8", blob, offset=at, strides=(1,))


def hash_runs(blob: bytes | bytearray, n: int, length: int, places: np.ndarray | slice = slice(None)) -> np.ndarray:
    """64-bit hashes of the ``length`` bytes from each of the first ``n`` positions on, or from ``places`` among them; ``blob``
    goes on for 8 bytes more."""
    out = np.zeros(n if isinstance(places, slice) else len(places), dtype=np.uint64)
    for k, at in enumerate([*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]):
        out ^= _words(blob, at, n)[places]
        out *= _M[k % 3]
        out ^= out >> np.uint64(32)
    out *= _M[3]
    return out ^ (out >> np.uint64(29))


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each ``width`` values from a position on; the last ones take what there is."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = best(out[:-step], out[step:])
        have += step
    return out


class Block:
    """Texts of some rows, joined, with their anchors.

    ``owner``: for each string of ``length`` bytes, by where it starts, the position of its least run, leftmost of equal
    ones; -1 where no string starts.
    """

    def __init__(self, texts: list[bytes], length: int):
        self.texts, self.length = texts, length
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.blob = b"".join(texts) + b"\0" * (length + 8)
        n, width = int(self.starts[-1]), length - GRAM + 1
        self.hashes = hash_runs(self.blob, n, GRAM) if n else np.zeros(0, dtype=np.uint64)
        # the place is put into the low bits, so that of equal hashes the leftmost is least; only order matters here
        place = np.arange(n, dtype=np.uint64)
        least = _slide((self.hashes >> np.uint64(32) << np.uint64(32)) | place, width, np.minimum)
        self.owner = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        row_end = np.repeat(self.starts[1:], sizes)
        self.owner[np.arange(n) + length > row_end] = -1
        self.anchors = np.unique(self.owner[self.owner >= 0])
        self.rows = np.searchsorted(self.starts, self.anchors, side="right") - 1


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of anchors. Anchors are least hashes, so small ones abound: they are mixed once more."""
    return (hashes * _M[4] >> np.uint64(48)).astype(np.int64) * buckets >> 16


def _shelf(hashes: np.ndarray) -> np.ndarray:
    """Shelves of anchors within their bucket, so that a task need not look at all strings of a bucket at once."""
    return (hashes * _M[4] >> np.uint64(40)).astype(np.int64) & SHELVES - 1


@cache
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, each compressed on its own: long ones as differences of neighbours, all as planes of bytes without
    the upper ones that hold nothing. So a pack takes little more for each row if it holds few of them."""
    out, n = [], len(arrays[0])
    for a in arrays:
        if a.dtype == np.int64:
            a = np.diff(a, prepend=np.int64(0))  # may wrap; so does the sum
            a = (a << 1) ^ (a >> 63)
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(n, a.dtype.itemsize).T
        width = int(np.max(np.flatnonzero(planes.any(axis=1)), initial=-1)) + 1
        data = _zstd()[0].compress(planes[:width].tobytes()) if width else b""
        out += [struct.pack("<BI", width, len(data)), data]
    return struct.pack("<I", n) + b"".join(out)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    n, out, at = struct.unpack_from("<I", data)[0], [], 4
    for k in kinds:
        (width, size), kind = struct.unpack_from("<BI", data, at), np.dtype(k)
        planes = np.zeros((n, kind.itemsize), dtype=np.uint8)
        if width:
            planes[:, :width] = np.frombuffer(_zstd()[1].decompress(data[at + 5 : at + 5 + size]), np.uint8).reshape(width, n).T
        a = planes.view(kind)[:, 0]
        out.append(np.cumsum((a >> 1 & np.int64((1 << 63) - 1)) ^ -(a & 1)) if kind == np.int64 else a)
        at += 5 + size
    return out


def _low(h: np.ndarray) -> np.ndarray:
    """The low 32 bits of hashes, which tell the anchors of one bucket apart: two of them that fall together (a share of a
    bucket's anchors / 2**32) cost work and change no result. The high bits say little, as anchors are least hashes."""
    return h.astype(np.uint32)


def _scatter(parts: int, doc: np.ndarray, version: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    """(part, data): rows packed by a part that depends on the document."""
    part = (doc.astype(np.uint64) * _M[0] >> np.uint64(48)).astype(np.int64) * parts >> 16
    by = np.lexsort((columns[0], version, doc, part))
    cuts = np.searchsorted(part[by], np.arange(parts + 1))
    rows = [(p, _pack(doc[m], version[m], *(c[m] for c in columns))) for p in range(parts) if len(m := by[cuts[p] : cuts[p + 1]])]
    return pd.DataFrame(rows, columns=["part", "data"])


def _gather(scattered: DataFrame, settle: Callable[..., tuple[np.ndarray, ...]], **kinds: str) -> DataFrame:
    """One row per document and version, each of ``kinds`` as bytes. ``settle`` gets numbers of rows and the arrays, in order of
    row and first array, and returns those that stay."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        unpacked = [_unpack(x, "<i8", "<i8", *kinds.values()) for x in frame["data"]]
        doc, version, *columns = (np.concatenate(c) for c in zip(*unpacked, strict=True))
        order = np.lexsort((columns[0], version, doc))
        doc, version, columns = doc[order], version[order], [c[order] for c in columns]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
        row, *columns = settle(np.cumsum(new) - 1, *columns)
        cuts = [*np.flatnonzero(np.diff(row, prepend=-1)), len(row)]
        rows = [(d, v, *(c[a:b].tobytes() for c in columns)) for d, v, a, b in zip(doc[new].tolist(), version[new].tolist(), cuts[:-1], cuts[1:], strict=True)]
        return pd.DataFrame(rows, columns=["doc", "version", *kinds])

    return scattered.groupBy("part").applyInPandas(run, "doc long, version long, " + ", ".join(f"{k} binary" for k in kinds))


def _steps(row: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each place of a row once, as the step from the place before it."""
    first = np.diff(row, prepend=-1) > 0
    steps = np.where(first, places, np.diff(places, prepend=places[:1]))
    keep = first | (steps > 0)
    return row[keep], steps[keep]


def _merged(row: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of a row that overlap or touch, as one."""
    base = row << 40  # no text is so long
    reach, new = np.maximum.accumulate(base + ends), np.ones(len(row), dtype=bool)
    new[1:] = (base + begins)[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(row)) - 1
    return row[new], begins[new], reach[last] - base[last]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, version, text). The version tells the texts of one id apart. It is a hash of the text for ids on several rows and
    for those that share one of 32768 slots with such an id; the others have 0, as eight bytes that differ for each
    document would travel with nearly every anchor and segment."""
    doc, text = id_key(docs, id_col), F.coalesce(F.col(text_col), F.lit(""))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 15))
    twice = docs.select(doc.alias("doc")).groupBy("doc").count().where("count > 1")
    bits = np.frombuffer(twice.select(F.bitmap_construct_agg(slot(F.col("doc"))).alias("bits")).first()["bits"], "<i8")
    repeated = F.getbit(F.element_at(F.lit(bits.tolist()).cast("array<bigint>"), F.floor(slot(doc) / 64).cast("int") + 1), F.pmod(slot(doc), F.lit(64)).cast("int")) == 1
    return docs.select(doc.alias("doc"), (F.when(repeated, F.xxhash64(text)).otherwise(F.lit(0)) if bits.any() else F.lit(0).cast("long")).alias("version"), text.alias("text"))


def _texts(rows: DataFrame) -> DataFrame:
    """(doc, version, zipped): compressed, for texts are shuffled."""

    def zip_(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for batch in slices(whole, 2):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())], names=["doc", "version", "zipped"])

    return rows.mapInArrow(zip_, "doc long, version long, zipped binary")


def _anchors(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, kind, data). Kind 0: anchors for the bucket, with flag 1 if the block knows them to be shared. Kind 1: places
    of anchors that the block knows to be shared."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 2, limit=24_000_000):
                ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                found = []
                for part in slices(batch, 2, limit=500_000):  # arrays that fit the processor's cache
                    block = Block([t.encode() for t in part.column(2).to_pylist()], length)
                    first = len(ids) - batch.num_rows if not found else found[-1][3]
                    found.append((block.hashes[block.anchors], block.rows + first, (block.anchors - block.starts[block.rows]).astype("<u4"), first + part.num_rows))
                h, row, place = (np.concatenate([f[k] for f in found]) for k in range(3))
                doc, version = ids[row], versions[row]
                order = np.lexsort((doc, h))
                hs, ds = h[order], doc[order]
                begins = np.ones(len(hs), dtype=bool)
                begins[1:] = hs[1:] != hs[:-1]
                at = np.flatnonzero(begins)
                if not len(at):
                    continue
                ends = np.concatenate([at[1:], [len(hs)]]) - 1
                many = ds[ends] != ds[at]  # of two documents of this block
                local = np.repeat(many, np.diff([*at, len(hs)]))
                sent = np.sort(np.where(many, order[at], -1)[many])  # one place for each of them
                alone = np.sort(order[~local])
                take = np.concatenate([sent, alone])
                flags = np.concatenate([np.ones(len(sent), np.uint8), np.zeros(len(alone), np.uint8)])
                bucket = _bucket(h[take], buckets)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
                out = []
                for b in range(buckets):
                    mine = by[cuts[b] : cuts[b + 1]]
                    if len(mine):
                        t = take[mine]
                        out.append((b, 0, _pack(_low(h[t]), doc[t], version[t], place[t], flags[mine])))
                known = np.sort(order[local])
                for k in range(0, len(known), 100_000):
                    some = known[k : k + 100_000]
                    out.append((int((h[0] + np.uint64(k // 100_000)) % np.uint64(buckets)), 1, _pack(doc[some], version[some], place[some])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "data"])

    return rows.mapInArrow(run, "bucket int, kind int, data binary")


def _shared(anchors: DataFrame, parts: int) -> DataFrame:
    """(doc, version, places) of the anchors that more than one document has; a place is the step from the one before it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = [_unpack(x, "<u4", "<i8", "<i8", "<u4", "u1") for x in frame["data"][frame["kind"] == 0]]
        docs, versions, places = [], [], []
        if own:
            h, doc, version, place, flag = (np.concatenate([x[k] for x in own]) for k in range(5))
            order = np.lexsort((doc, h))
            h, doc, flag = h[order], doc[order], flag[order]
            begins = np.ones(len(h), dtype=bool)
            begins[1:] = h[1:] != h[:-1]
            at = np.flatnonzero(begins)
            ends = np.concatenate([at[1:], [len(h)]]) - 1
            many = (doc[at] != doc[ends]) | (np.maximum.reduceat(flag, at) > 0)
            # those that a block knows already are among its places of kind 1
            keep = np.repeat(many, np.diff([*at, len(h)])) & (flag == 0)
            docs, versions, places = [doc[keep]], [version[order][keep]], [place[order][keep]]
        for x in frame["data"][frame["kind"] == 1]:
            for column, value in zip((docs, versions, places), _unpack(x, "<i8", "<i8", "<u4"), strict=True):
                column.append(value)
        if not docs:
            return pd.DataFrame({"part": [], "data": []})
        return _scatter(parts, *(np.concatenate(c) for c in (docs, versions, places)))

    return _gather(anchors.groupBy("bucket").applyInPandas(run, "part int, data binary"), _steps, places="<u4")


def _least_holder(texts: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each segment, a row of ``texts`` that is zero beyond its ``size``, the smallest document that holds an equal one."""
    words = texts.view("<u8")
    key = size.astype(np.uint64)
    for k in range(words.shape[1]):
        key ^= words[:, k]
        key *= _M[k % 3]
        key ^= key >> np.uint64(32)
    order = np.lexsort((doc, key))
    begins = np.ones(len(order), dtype=bool)
    begins[1:] = np.diff(key[order]) != 0
    first = order[np.flatnonzero(begins)][np.cumsum(begins) - 1]  # of the group, in order
    least = np.empty_like(doc)
    least[order] = doc[first]
    unlike = [size[order] != size[first]]
    for k in range(words.shape[1]):
        unlike.append(unlike.pop() | (words[order, k] != words[first, k]))
    if unlike[0].any():  # different segments of one hash: their groups are settled by their bytes
        for f in np.unique(first[unlike[0]]).tolist():
            own, smallest = order[first == f], {}
            held = [texts[i, : size[i]].tobytes() for i in own.tolist()]
            for t, d in zip(held, doc[own].tolist(), strict=True):
                smallest[t] = min(d, smallest.get(t, d))
            least[own] = [smallest[t] for t in held]
    return least


def _segments(marked: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, kind, data) from (doc, version, zipped, places). Kind 0: segments of shared anchors. Kind 1: stretches that go,
    as equal segments of the block show."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def groups():
            rows, size = [], 0
            for batch in batches:
                for doc, version, zipped, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    text = unpack(zipped)
                    rows.append((doc, version, text, np.cumsum(np.frombuffer(places, "<u4"), dtype=np.int64)))
                    size += len(text)
                    if size > 500_000:
                        yield rows
                        rows, size = [], 0
            if rows:
                yield rows

        def blocks():  # as many segments as memory allows, for buckets get few of each block
            found, count = [], 0
            for group in groups():
                block = Block([r[2] for r in group], length)
                wanted = np.concatenate([r[3] + s for r, s in zip(group, block.starts, strict=False)])
                starts = np.flatnonzero(np.isin(block.owner, wanted))
                if not len(starts):
                    continue
                owner = block.owner[starts]
                cut_at = np.flatnonzero((owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
                begin, end = starts[np.concatenate([[0], cut_at])], starts[np.concatenate([cut_at - 1, [len(starts) - 1]])]
                own = np.searchsorted(block.starts, begin, side="right") - 1
                size, hashes = end - begin + length, block.hashes[block.owner[begin]]
                texts = np.ndarray((len(block.blob) - width + 1, width), np.uint8, block.blob, strides=(1, 1))[begin]
                texts[np.arange(width) >= size[:, None]] = 0
                doc, version = (np.array([r[k] for r in group], dtype=np.int64)[own] for k in range(2))
                found.append((doc, version, begin - block.starts[own], size, _bucket(hashes, buckets), _shelf(hashes), texts))
                count += len(begin)
                if count > SEGMENTS:
                    yield [np.concatenate([f[k] for f in found]) for k in range(7)]
                    found, count = [], 0
            if found:
                yield [np.concatenate([f[k] for f in found]) for k in range(7)]

        width = -(-(2 * length - GRAM) // 8) * 8  # of the longest segment, in whole words
        pack = zstandard.ZstdCompressor(level=1).compress
        for doc, version, at, size, bucket, shelf, texts in blocks():
            least = _least_holder(texts, size, doc)
            sent = np.flatnonzero(doc == least)
            sent = sent[np.lexsort((at[sent], version[sent], doc[sent], bucket[sent]))]
            out, cuts = [], np.searchsorted(bucket[sent], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                mine = sent[cuts[b] : cuts[b + 1]]
                head = np.column_stack([doc[mine], version[mine], at[mine], size[mine] | shelf[mine] << 32]).astype("<i8")
                held = texts[mine][np.arange(width) < size[mine][:, None]]
                out.append((b, 0, pack(struct.pack("<q", len(mine)) + head.tobytes() + held.tobytes())))
            gone = np.flatnonzero(doc != least)
            if len(gone):
                gone = gone[np.lexsort((at[gone], version[gone], doc[gone]))]
                out.append((int(doc[gone[0]] % buckets), 1, _pack(doc[gone], version[gone], at[gone], at[gone] + size[gone])))
            del doc, version, at, size, bucket, shelf, texts, least, sent, gone
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "data"])

    return marked.select("doc", "version", "zipped", "places").mapInArrow(run, "bucket int, kind int, data binary")


def _equal_strings(blob: bytes | bytearray, at: np.ndarray, other: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at ``at`` equal those at ``other``, byte by byte. ``blob`` goes on for 8 bytes more.

    Where a string and its other both lie one byte after those before them, 49 bytes are compared already, and only the last
    one is left; if any bytes differ, all strings are compared in full.
    """
    moved = at != other
    chained = np.zeros(len(at), dtype=bool)
    chained[1:] = moved[1:] & moved[:-1] & (at[1:] == at[:-1] + 1) & (other[1:] == other[:-1] + 1)
    each, words = np.frombuffer(blob, np.uint8), _words(blob, 0, len(blob) - 7)

    def in_full(which: np.ndarray) -> np.ndarray:
        same = np.ones(len(which), dtype=bool)
        for k in [*range(0, length - 7, 8), length - 8]:
            same &= words[at[which] + k] == words[other[which] + k]
        return same

    out, whole, last = np.ones(len(at), dtype=bool), np.flatnonzero(moved & ~chained), np.flatnonzero(chained)
    out[whole] = in_full(whole)
    out[last] = each[at[last] + length - 1] == each[other[last] + length - 1]
    if not out.all():
        which = np.flatnonzero(moved)
        out[which] = in_full(which)
    return out


def _not_first(blob: bytearray, at: np.ndarray, h: np.ndarray, ranks: np.ndarray, length: int) -> np.ndarray:
    """Whether the string at each of ``at``, which ascend, is also that of a smaller rank. ``h``: their hashes."""
    order = np.argsort(h)
    begins = np.ones(len(h), dtype=bool)
    begins[1:] = np.diff(h[order]) != 0
    heads, sorted_ranks = np.flatnonzero(begins), ranks[order]
    sizes = np.diff([*heads, len(h)])
    goes, first = np.zeros(len(h), dtype=bool), np.empty(len(h), dtype=np.int64)
    goes[order] = np.repeat(np.minimum.reduceat(sorted_ranks, heads), sizes) < sorted_ranks
    first[order] = np.repeat(np.minimum.reduceat(at[order], heads), sizes)
    unlike = np.flatnonzero(~_equal_strings(blob, at, first, length))
    if len(unlike):  # different strings of one hash: their groups are settled by their bytes
        group = np.cumsum(begins) - 1
        for g in np.unique(group[np.isin(order, unlike)]).tolist():
            own = order[heads[g] : heads[g] + sizes[g]]
            texts, least = [bytes(blob[p : p + length]) for p in at[own].tolist()], {}
            for t, r in zip(texts, ranks[own].tolist(), strict=True):
                least[t] = min(r, least.get(t, r))
            goes[own] = [least[t] < r for t, r in zip(texts, ranks[own].tolist(), strict=True)]
    return goes


def _shelves(shelf: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of shelves, from and to, that hold STRINGS strings together or are one shelf."""
    out, held = [], 0
    for k, n in enumerate(np.bincount(shelf, weights=counts, minlength=SHELVES).tolist()):
        if out and held + n <= STRINGS:
            out[-1], held = (out[-1][0], k + 1), held + n
        else:
            out.append((k, k + 1))
            held = n
    return out


def _gone(segments: DataFrame, length: int, parts: int) -> DataFrame:
    """(doc, version, begins, ends) of the stretches that go."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        stretches = [np.column_stack(_unpack(x, "<i8", "<i8", "<i8", "<i8")) for x in frame["data"][frame["kind"] == 1]]
        heads, blob = [], bytearray()
        for x in frame["data"][frame["kind"] == 0]:
            raw = unpack(x)
            n = struct.unpack_from("<q", raw)[0]
            heads.append(np.frombuffer(raw, "<i8", 4 * n, 8).reshape(n, 4).copy())
            blob += memoryview(raw)[8 + 32 * n :]
            del raw
        if heads:
            doc, version, place, size = np.concatenate(heads).T
            del heads
            blob += b"\0" * (length + 8)
            shelf, size = (size >> 32).astype(np.uint8), size & 0xFFFFFFFF
            starts, counts = np.cumsum(size) - size, size - length + 1  # counts: of the strings of each segment
            n, rank = len(blob) - length - 8, np.unique(doc, return_inverse=True)[1].astype(np.uint32)
            for low, high in _shelves(shelf, counts):
                rows = np.flatnonzero((shelf >= low) & (shelf < high))
                if not len(rows):
                    continue
                ends = np.cumsum(counts[rows])  # the strings of these rows are numbered
                goes, turns = np.zeros(ends[-1], dtype=bool), -(-int(ends[-1]) // STRINGS)
                for turn in range(turns):  # several where one shelf holds more: by hash, as equal strings have equal hashes
                    parts_ = []
                    for a, b in zip(cuts := np.searchsorted(ends, np.arange(turns) * STRINGS), [*cuts[1:], len(rows)], strict=True):
                        own = rows[a:b]
                        row = np.repeat(own.astype(np.uint32), counts[own])
                        number = np.arange(ends[a - 1] if a else 0, ends[b - 1] if b else 0)
                        at = number - np.repeat(ends[a:b] - counts[own] - starts[own], counts[own])
                        h = hash_runs(blob, n, length, at)
                        if turns > 1:
                            mine = np.flatnonzero(h % np.uint64(turns) == turn)
                            row, number, at, h = row[mine], number[mine], at[mine], h[mine]
                        parts_.append((number, at, h, rank[row]))
                    number, at, h, ranks = parts_[0] if turns == 1 else (np.concatenate([x[k] for x in parts_]) for k in range(4))
                    del parts_
                    if len(at):
                        goes[number] = _not_first(blob, at, h, ranks, length)
                    del row, number, at, h, ranks
                hit = np.flatnonzero(goes)
                if len(hit):
                    row = np.searchsorted(ends, hit, side="right")
                    new = np.flatnonzero((row[1:] != row[:-1]) | (hit[1:] != hit[:-1] + 1)) + 1
                    a, b = hit[np.concatenate([[0], new])], hit[np.concatenate([new - 1, [len(hit) - 1]])]
                    r = rows[row[np.concatenate([[0], new])]]
                    inside = a - (ends - counts[rows])[row[np.concatenate([[0], new])]]
                    stretches.append(np.column_stack([doc[r], version[r], place[r] + inside, place[r] + inside + (b - a) + length]))
        if not stretches:
            return pd.DataFrame({"part": [], "data": []})
        return _scatter(parts, *np.concatenate(stretches).astype("<i8").T)

    return _gather(segments.groupBy("bucket").applyInPandas(run, "part int, data binary"), _merged, begins="<i8", ends="<i8")


def _copies(rows: DataFrame, length: int) -> DataFrame:
    """(doc, version, size) of the texts that a smaller document has as a whole, by their SHA-256: all their bytes go."""
    long = rows.withColumn("size", F.octet_length("text").cast("long")).where(F.col("size") >= length)
    told = long.select("doc", "version", "size", F.unhex(F.sha2("text", 256)).alias("digest"))
    first = told.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    return told.join(first.select("digest", "first"), "digest").where("first < doc").select("doc", "version", "size").distinct()


def _wholes(copies: DataFrame) -> DataFrame:
    """(doc, version, begins, ends): one stretch for each of the copies, the whole text."""

    def run(batches):
        for batch in batches:
            ends = [n.to_bytes(8, "little") for n in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bytes(8)] * len(ends), pa.binary()), pa.array(ends, pa.binary())], names=["doc", "version", "begins", "ends"])

    return copies.mapInArrow(run, "doc long, version long, begins binary, ends binary")


def repeated_stretches(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, zipped, begins, ends): every row with the stretches of bytes that go, as packed arrays, null
    where none go."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    buckets = max(8, shuffle_partitions(docs.sparkSession))
    rows = _rows(docs, id_col, text_col)
    shared = _shared(_anchors(rows, length, buckets), buckets)
    # both joins read the texts from one shuffle: the same rows, dealt by the same columns
    texts = _texts(rows).where("doc is not null and version is not null")
    copies = _copies(rows, length)
    marked = texts.join(shared.join(copies, ["doc", "version"], "left_anti"), ["doc", "version"])
    gone = _gone(_segments(marked, length, buckets), length, buckets).union(_wholes(copies))
    return texts.join(gone, ["doc", "version"], "left")


def _spans(begins: bytes | None, ends: bytes | None) -> list[tuple[int, int]]:
    return list(zip(np.frombuffer(begins, "<i8").tolist(), np.frombuffer(ends, "<i8").tolist(), strict=True)) if begins else []


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, length: int = 50, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, and kept: the remaining bytes, or with ``digest`` kept_sha256) of every row."""
    last = "kept_sha256" if digest else "kept"

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for zipped, begins, ends in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                text, spans = unpack(zipped), _spans(begins, ends)
                kept = _kept(text, spans)
                rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest() if digest else kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", last])

    found = repeated_stretches(docs, length, id_col, text_col).select(id_back("doc").alias("doc_id"), "zipped", "begins", "ends")
    return found.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {'string' if digest else 'binary'}")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the 50-byte strings that smaller ids hold."""
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


#: Strings are cut from stretches of 1000 bytes in hexadecimal, so that no cut looks through a whole long text.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, k, substr(h, 2000 * k + 1, 2098) AS part FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2000)) AS k FROM d)),
s AS (SELECT doc_id, 1000 * k + j AS i, substr(part, 2 * j + 1, 100) AS g FROM (SELECT doc_id, k, part, unnest(generate_series(0, least(999, length(part) // 2 - 50))) AS j FROM b)),
m AS (SELECT g, min(doc_id) AS keeper FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, i FROM s JOIN m USING (g) WHERE keeper < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + 50 OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marked) GROUP BY doc_id, r),
edges AS (SELECT doc_id, coalesce(lag(z) OVER w, 0) AS since, a FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
          UNION ALL SELECT doc_id, max(z), NULL FROM runs GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(CASE WHEN a IS NULL THEN substr(h, 2 * since + 1) ELSE substr(h, 2 * since + 1, 2 * (a - since)) END, '' ORDER BY since) AS kept FROM edges JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n, count(*) AS k FROM runs GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN rest ON rest.doc_id = d.doc_id
"""
