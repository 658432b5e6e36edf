"""Byte-level BPE through sentencepiece.

A sentencepiece BPE model is serialised directly from a rank file: each byte string becomes a piece of printable
characters, one per byte, scored by its negative rank, under identity normalisation. BPE merges the pair whose joined
piece has the highest score, leftmost first, which is the order of the ranks. Each match of the splitting pattern is
encoded by itself; decoding maps ids back to byte strings and joins them.

Defined results: null and empty texts have no ids and decode to no bytes; texts of any length are encoded whole; repeated
rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table
from .tokens import SYMBOL_OF, Memo, chunks, read_ranks


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: an integer, a 32-bit float or a length-delimited string."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def symbols(token: bytes) -> str:
    return token.decode("latin-1").translate(SYMBOL_OF)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised BPE model in which the id of each token is its rank; the unknown piece comes last."""
    # Field numbers and values of sentencepiece's public model format.
    pieces, bpe, normal, unknown = 1, 2, 1, 2
    out = bytearray()
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    for token in ordered:
        out += _field(pieces, _field(1, symbols(token).encode()) + _field(2, float(-ranks[token])) + _field(3, normal))
    out += _field(pieces, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    absent = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + b"".join(_field(n, absent) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class ByteLevelBPE:
    """Encode and decode with a rank file and a splitting pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(ranks_path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.matches = regex.compile(pattern).findall
        self.bytes_of = {str(i): t for t, i in ranks.items()}
        self.words = Memo(self._encode_match)
        self.chunks = Memo(lambda chunk: " ".join([self.words[x] for x in self.matches(chunk)]))

    def _encode_match(self, match: str) -> str:
        return " ".join(map(str, self.model.encode(symbols(match.encode()))))

    def encode(self, text: str) -> str:
        """Decimal ids joined by spaces."""
        memo = self.chunks
        return " ".join([memo[c] for c in chunks(text)])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (decimal, joined by spaces) and decoded (bytes) of every whole text."""
    return _encoded(docs, ranks_path, pattern, id_col, text_col, digest=False)


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    def make():
        bpe = ByteLevelBPE(ranks_path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            decoded = [bpe.decode(x) for x in ids]
            counts = pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64())
            if digest:
                columns = [pa.array([sha(x.encode()) for x in ids]), pa.array([sha(x) for x in decoded])]
            else:
                columns = [pa.array(ids, pa.string()), pa.array(decoded, pa.binary())]
            return pa.RecordBatch.from_arrays([batch.column(0), counts, *columns], names=["doc_id", "n_tokens", *names])

        return work

    names = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
    kind = docs.schema[id_col].dataType.simpleString()
    last = "ids_sha256 string, decoded_sha256 string" if digest else "ids string, decoded binary"
    return map_texts(docs, [F.col(id_col).alias("doc_id"), F.col(text_col)], make, f"doc_id {kind}, n_tokens long, {last}")


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of all ``documents``, made where the ids are, so that no ids move."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return _encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "doc_id", "text", digest=True)
