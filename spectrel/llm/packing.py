"""Packing by power-of-two decomposition.

A document's ids plus the end id are cut into pieces whose lengths are powers of two: as many of ``max_len`` as fit, then
the binary digits of what is left, from large to small. Each piece is a sequence of its own, so no sequence crosses
documents, none needs padding (a power of two is not padded), and pieces of equal length form a bucket from which
batches of one shape can be drawn.

Defined cases: a null text counts as empty, whose one piece is the end id; repeated rows are packed each; an empty table
gives an empty result; other columns are dropped. ``sequence_id`` is unique for each piece and stable as long as the input's
partitions are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.llm.base import need, small_batches
from spectrel.llm.wordcache import gathered, loaded, takes_leading_blank

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int"


def binary_lengths(total: int, max_len: int) -> list[int]:
    """Powers of two from ``max_len`` down that sum to ``total``."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    rest = total % max_len
    return [max_len] * (total // max_len) + [1 << b for b in range(max_len.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 1, max_len: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (packed 32-bit), doc_tokens, bucket, sequence_id, offset. No shuffle."""
    spark = df.sparkSession
    small_batches(spark)
    binary_lengths(0, max_len)
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    leading, data = takes_leading_blank(raw), spark.sparkContext.broadcast(raw)  # bounded by the vocabulary
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(data.value, leading)
        for batch in gathered(batches, "text"):
            ids, counts = encoder.encode_array(batch.column("text"))
            rows: list[list] = [[], [], [], [], [], []]
            at = 0
            for key, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own, start = ids[at : at + n].tobytes() + end, 0
                at += n
                for length in binary_lengths(n + 1, max_len):
                    for column, value in zip(rows, (key, start, length, own[4 * start : 4 * (start + length)], n + 1, length.bit_length() - 1), strict=True):
                        column.append(value)
                    start += length
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()), strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])
            for first in range(0, len(out), 1024):
                yield out.slice(first, 1024)

    source = need(df, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, SCHEMA).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
