"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Each byte becomes one character (``BYTE_BASE`` + byte), each rank a piece whose score is its negative rank, and
normalisation is the identity, so sentencepiece's best-score-first merging equals lowest-rank-first merging of bytes.
Nothing is trained. Texts are cut by the pre-token pattern, distinct pre-tokens are encoded once per worker's cache
(bounded by ``CACHE_PIECES``; a full cache is emptied, results do not depend on it), and ids are decoded by the inverse
of the byte mapping.

Defined cases: a null text counts as empty and has no ids; decoding null ids gives null; rows that repeat are encoded
each; an empty table gives an empty result; other columns pass through untouched, and a column that clashes with an output
name is an error.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spectrel.llm.base import small_batches, texts_of

BYTE_BASE = 0x100
CACHE_PIECES = 400_000
#: Longer pre-tokens are forgotten after their batch, so that the cache is bounded in bytes too.
LONGEST = 100


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file (base64 piece, rank on each line), in order of rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = sorted((int(r), base64.b64decode(p)) for p, r in pairs)
    if [r for r, _ in ranks] != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    if not {bytes([b]) for b in range(256)} <= {p for _, p in ranks}:
        raise ValueError("every single byte must have a rank")
    return [p for _, p in ranks]


def to_chars(piece: bytes) -> str:
    return "".join(chr(BYTE_BASE + b) for b in piece)


def to_bytes(chars: str) -> bytes:
    return bytes(ord(c) - BYTE_BASE for c in chars)


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(pieces: list[bytes]) -> bytes:
    """The sentencepiece ModelProto: piece i has id i and score -i; the obligatory unknown piece comes last."""
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()

    def add(text: str, score: float, kind: int) -> None:
        out.extend(_field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind)))

    for rank, piece in enumerate(pieces):
        add(to_chars(piece), -float(rank), normal)
    add("<unk>", 0.0, unknown)
    absent = -1
    trainer = _field(3, bpe) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_field(i, absent) for i in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out) + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encoder and decoder over a serialised model."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.n = self.sp.get_piece_size() - 1
        self.table = [to_bytes(self.sp.id_to_piece(i)) for i in range(self.n)]
        # A pre-token that is a piece as a whole has that id, also where merges would not lead to it.
        merged = self.sp.encode([to_chars(p) for p in self.table], num_threads=1)
        self.whole = {p: i for i, p in enumerate(self.table) if merged[i] != [i]}

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        ids = self.sp.encode([to_chars(r) for r in raw], num_threads=1)
        return [struct.pack("<I", self.whole[r]) if r in self.whole else np.asarray(i, dtype="<u4").tobytes() for r, i in zip(raw, ids, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.cut(t) for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        cache = self.cache
        missing = list({p for pieces in cut for p in pieces if p not in cache})
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            cache.update(zip(part, self._encode_pieces(part), strict=True))
        out = [b"".join(map(cache.__getitem__, pieces)) for pieces in cut]
        for p in missing:
            if len(p) > LONGEST:
                del cache[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_LOADED: dict[bytes, ByteBPE] = {}


def _loaded(model: bytes, pattern: str) -> ByteBPE:
    key = hashlib.sha256(model + pattern.encode()).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE(model, pattern)
    return _LOADED[key]


def _with_column(df: DataFrame, name: str) -> T.StructType:
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])


def _appended(batch: pa.RecordBatch, name: str, values: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], names=[*batch.schema.names, name])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the text's token ids, packed as little-endian unsigned 32-bit integers. Narrow: no shuffle."""
    spark = df.sparkSession
    small_batches(spark)
    schema = _with_column(df, ids)
    model = spark.sparkContext.broadcast(serialise_model(read_ranks(ranks_path)))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(model.value, pattern)
        for batch in batches:
            yield _appended(batch, ids, bpe.encode(texts_of(batch.column(text))))

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that the packed ``ids`` stand for. Narrow: no shuffle."""
    spark = df.sparkSession
    small_batches(spark)
    schema = _with_column(df, out)
    model = spark.sparkContext.broadcast(serialise_model(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(model.value, pattern)
        for batch in batches:
            yield _appended(batch, out, [None if x is None else bpe.decode(x) for x in batch.column(ids).to_pylist()])

    return df.mapInArrow(run, schema)
