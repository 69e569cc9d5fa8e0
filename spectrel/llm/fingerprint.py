"""Homomorphic multiset hash of a document's paragraphs.

A paragraph (the text between line ends) becomes a wide vector: ``STRONG`` lanes of 64 bits from an extendable hash of the
whole paragraph, and ``LANES`` lanes of 32 bits that count its word pairs, each with a hashed sign in a hashed lane. A document's
fingerprint is the lane-wise sum of its paragraphs' vectors modulo 2^64 and 2^32. So the order of paragraphs does not
matter, a paragraph is inserted by adding and deleted by subtracting its vector, and fingerprints of parts add up.
Equal multisets of paragraphs have equal fingerprints; the strong lanes tell others apart. The counting lanes are a linear
sketch, whose normalised inner product estimates how much two documents share (0 to 1).

Defined cases: a null text is the empty text, which is one empty paragraph; repeated rows get equal fingerprints; an
empty table gives an empty result; a column that clashes with an output name is an error. ``with_next`` orders null keys
last and breaks ties by the other columns' hash; a table of one row is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrel.llm.base import small_batches, texts_of

STRONG, LANES = 8, 256
CACHE_WORDS = 100_000
RANGE_BYTES = 64_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    for w in set(words):
        if w not in _WORDS:
            _WORDS[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Multiset:
    """The running sum. ``add`` and ``remove`` take paragraphs, ``digest`` gives the fingerprint's bytes."""

    def __init__(self, digest: bytes | None = None):
        if digest is None:
            self.strong, self.lanes = np.zeros(STRONG, np.uint64), np.zeros(LANES, np.uint32)
        else:
            self.strong = np.frombuffer(digest[: 8 * STRONG], "<u8").copy()
            self.lanes = np.frombuffer(digest[8 * STRONG :], "<u4").copy()

    def add(self, *paragraphs: str) -> Multiset:
        strong, lanes = vectors(paragraphs)
        self.strong, self.lanes = self.strong + strong, self.lanes + lanes
        return self

    def remove(self, *paragraphs: str) -> Multiset:
        strong, lanes = vectors(paragraphs)
        self.strong, self.lanes = self.strong - strong, self.lanes - lanes
        return self

    def merge(self, other: Multiset) -> Multiset:
        self.strong, self.lanes = self.strong + other.strong, self.lanes + other.lanes
        return self

    def digest(self) -> bytes:
        return self.strong.astype("<u8").tobytes() + self.lanes.astype("<u4").tobytes()


def vectors(paragraphs: tuple[str, ...] | list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the paragraphs' vectors."""
    raw = b"".join(hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(8 * STRONG) for p in paragraphs)
    strong = np.frombuffer(raw, "<u8").reshape(-1, STRONG).sum(axis=0, dtype=np.uint64)
    cut = [p.split() for p in paragraphs]
    words = [w for c in cut for w in c]
    if not words:
        return strong, np.zeros(LANES, np.uint32)
    h = _word_hashes(words)
    # A pair for each word and the one after it in its paragraph; the last word of a paragraph pairs with the edge.
    after = np.append(h[1:], np.uint64(0))
    after[np.cumsum([len(c) for c in cut if c]) - 1] = np.uint64(0)
    pair = _mixed(h * _MIX + after)
    sign = 1 - 2 * ((pair >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
    lanes = np.bincount((pair & np.uint64(LANES - 1)).astype(np.int64), sign, LANES)
    return strong, lanes.astype(np.int64).astype(np.uint32)


def fingerprint_text(text: str) -> bytes:
    return Multiset().add(*text.split("\n")).digest()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated share that two documents have in common, 0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(d[8 * STRONG :], "<i4").astype(np.float64) for d in (a, b))
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / norm)) if norm else 0.0


def _extended(schema: T.StructType, *new: tuple[str, T.DataType]) -> T.StructType:
    for name, _ in new:
        if name in schema.names:
            raise ValueError(f"column {name} exists")
    return T.StructType([*schema.fields, *[T.StructField(name, kind) for name, kind in new]])


def _likenesses(columns: dict[str, list], pairs: tuple[tuple[str, str, str], ...]) -> list[pa.Array]:
    return [pa.array([None if x is None or y is None else likeness(x, y) for x, y in zip(columns[a], columns[b], strict=True)], pa.float64()) for a, b, _ in pairs]


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", *pairs: tuple[str, str, str]) -> DataFrame:
    """Adds the fingerprint's bytes, and for each of ``pairs`` what ``compare`` adds, which may name the new column. Narrow."""
    small_batches(df.sparkSession)
    schema = _extended(df.schema, (out, T.BinaryType()), *[(name, T.DoubleType()) for *_, name in pairs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [fingerprint_text(t) for t in texts_of(b.column(text))]
            told = {c: made if c == out else b.column(c).to_pylist() for *both, _ in pairs for c in both}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary()), *_likenesses(told, pairs)], names=schema.names)

    return df.mapInArrow(run, schema)


def compare(df: DataFrame, *pairs: tuple[str, str, str]) -> DataFrame:
    """Adds the likeness of two fingerprint columns, null if one is null, for each (a, b, name of the new column), in one go. Narrow."""
    small_batches(df.sparkSession)
    schema = _extended(df.schema, *[(name, T.DoubleType()) for *_, name in pairs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = {c: batch.column(c).to_pylist() for *both, _ in pairs for c in both}
            yield pa.RecordBatch.from_arrays([*batch.columns, *_likenesses(told, pairs)], names=schema.names)

    return df.mapInArrow(run, schema)


def with_next(df: DataFrame, key: str = "doc_id", parts: int | None = None, keys: DataFrame | None = None, size: Column | None = None) -> DataFrame:
    """Adds next_<column> for every column: the row after it in descending order of ``key`` (a whole number); after the last, the first.

    Rows are dealt into ranges of the key by quantiles, each range also gets the first row of the one after it, and each
    task goes through its sorted ranges once. So rows move once, and no task has more than its ranges. A key that many rows have, or
    null, takes several ranges, by a hash of the row, which orders equal keys. ``keys``: a table of
    the same rows that is cheaper to read than ``df``, which is gone through before for the ranges; the hash is that of its columns. ``size``: the
    bytes of a row, by the columns of ``keys``; there are so many ranges that one has about ``RANGE_BYTES``, or as many as shuffle partitions if that is more.
    """
    spark = df.sparkSession
    small_batches(spark)
    if clash := {f"next_{c}" for c in df.columns} & set(df.columns):
        raise ValueError(f"columns exist: {', '.join(sorted(clash))}")
    keys = df if keys is None else keys
    if not parts:
        total = 0 if size is None else keys.agg(F.sum(size)).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // RANGE_BYTES))
    least = -(1 << 63)
    number, tie = F.coalesce(F.col(key).cast("long"), F.lit(least)), F.xxhash64(*[F.col(c) for c in keys.columns])
    steps = [i / parts for i in range(1, parts)]
    keys = keys.select(number.alias("key"), tie.alias("tie"))
    found = keys.agg(F.percentile_approx("key", steps, max(10_000, 10 * parts)).alias("q")).first()["q"] if steps else None
    bounds, often = np.unique(np.array(found or [], np.int64), return_counts=True)
    # In descending order: the keys above the last bound, that bound, the keys below it, and so on; a bound takes as many ranges as it has quantiles.
    shares = np.ones(2 * len(bounds) + 1, np.int64)
    shares[1::2] = often[::-1]
    first = np.concatenate([[0], np.cumsum(shares)])

    def ranges(values: pa.Array, ties: pa.Array) -> np.ndarray:
        """0 for the largest keys."""
        v, t = values.to_numpy(zero_copy_only=False), ties.to_numpy(zero_copy_only=False)
        below = np.searchsorted(bounds, v, side="left")
        place = 2 * (len(bounds) - below) - np.isin(v, bounds)
        within = np.minimum(((t / 2.0**64 + 0.5) * shares[place]).astype(np.int64), shares[place] - 1)
        return first[place] + within

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranges(b.column(0), b.column(1)), pa.int32()), *b.columns], names=["part", "key", "tie"])

    of_part = keys.mapInArrow(firsts, "part int, key long, tie long").groupBy("part").agg(F.max(F.struct("key", F.bitwise_not("tie").alias("t"))).alias("top"))
    tops = sorted((r.part, r.top.key, ~r.top.t) for r in of_part.collect())  # one row per range
    halo: dict[tuple[int, int], int] = {tuple(top): tops[i - 1][0] for i, (_, *top) in enumerate(tops)}  # the row that also goes to the range before it
    source = df.select(*df.columns, number.alias("__key"), tie.alias("__tie"))
    dealt_schema = T.StructType([*source.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__halo", T.IntegerType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sent = [f.name for f in dealt_schema.fields], set()
        for b in batches:
            own = b.column("__key")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranges(own, b.column("__tie")), pa.int32()), pa.array([0] * len(b), pa.int32())], names=names)
            for i, row in enumerate(zip(own.to_pylist(), b.column("__tie").to_pylist(), strict=True)):
                if row in halo and row not in sent:  # equal rows: one of them will do
                    sent.add(row)
                    yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, pa.array([halo[row]], pa.int32()), pa.array([1], pa.int32())], names=names)

    dealt = source.mapInArrow(deal, dealt_schema).repartition(parts, "__part").sortWithinPartitions("__part", "__halo", F.desc("__key"), "__tie")
    out_schema = T.StructType([*df.schema.fields, *[T.StructField(f"next_{f.name}", f.dataType) for f in df.schema.fields]])
    width = len(df.columns)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for b in batches:
            if not len(b):
                continue
            both = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            held = b.slice(len(b) - 1)
            if len(both) < 2:
                continue
            this, after = both.slice(0, len(both) - 1), both.slice(1)
            keep = pa.array(np.asarray(this.column("__halo")) == 0)
            out = pa.RecordBatch.from_arrays([*this.columns[:width], *after.columns[:width]], names=[f.name for f in out_schema.fields])
            yield out.filter(keep)

    return dealt.mapInArrow(pair, out_schema)
