"""Token counts through a cache that is keyed by content digest and tokenizer version.

A text is normalised as the tokenizer sees it (null becomes the empty text; the tokenizer file used has no normaliser, so
nothing else is changed), and its SHA-256 is joined to the stored counts of the same tokenizer version, which is the
SHA-256 of the tokenizer file. The probe moves distinct digests alone. Only texts that the cache lacks are moved, one of equal
ones per task, and encoded; their counts are appended to the cache.

The cache is a folder of Parquet tables (version, digest, n_bytes, n_tokens), one for each run that had misses, in a store that all
executors share. Two runs that append the same digest do no harm: equal digests have equal counts, and the probe takes one.

The join back to the documents carries digests and counts only; the counts are stored one to a digest, and Spark splits the
partition of a digest that many documents have.

Defined cases: null and empty texts have no tokens; repeated rows keep their rows; an empty table gives an empty result
and leaves the cache as it was; columns of the input other than the id and the text are dropped.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.llm.base import need, path_exists, small_batches, store
from spectrel.llm.wordcache import gathered, loaded, takes_leading_blank

CACHE_SCHEMA = "version string, digest binary, n_bytes long, n_tokens long"


def tokenizer_version(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: Digests that a task remembers while it looks for the first of equal texts; beyond, some are sent twice.
SEEN = 1_000_000


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """digest, n_bytes, n_tokens of one tokenizer; a digest may repeat."""
    if not path_exists(spark, cache_path):
        return spark.createDataFrame([], "digest binary, n_bytes long, n_tokens long")
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version).select("digest", "n_bytes", "n_tokens")


def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task whose digest it meets for the first time."""
    seen: set[bytes] = set()
    for batch in batches:
        if len(seen) > SEEN:
            seen.clear()
        keep = []
        for d in batch.column("digest").to_pylist():
            keep.append(d not in seen)
            seen.add(d)
        yield batch.filter(pa.array(keep, pa.bool_()))


def count_tokens(df: DataFrame, tokenizer_path: str, cache_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, n_bytes, n_tokens for each row. Appends to the cache at once; the result reads what was stored lazily."""
    spark = df.sparkSession
    small_batches(spark)
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    leading = takes_leading_blank(raw)
    version, data = tokenizer_version(raw), spark.sparkContext.broadcast(raw)  # bounded by the vocabulary
    content = F.coalesce(F.col(text), F.lit(""))
    source = need(df, doc_id, text).select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"), content.alias("text"))

    asked = source.select("digest").distinct().join(read_cache(spark, cache_path, version), "digest", "left")
    probed = store(asked.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens")), "counts-probe")
    known, misses = probed.where("n_tokens is not null"), probed.where("n_tokens is null").select("digest")
    if misses.isEmpty():
        return source.select("doc_id", "digest").join(known, "digest", "left").select("doc_id", "digest", "n_bytes", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(data.value, leading, counts_only=True)
        for batch in gathered(batches, "text"):
            texts = batch.column("text")
            _, n_tokens = encoder.encode_array(texts)
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(texts)), batch.column("digest"), pc.binary_length(texts).cast(pa.int64()), pa.array(n_tokens, pa.int64())], names=["version", "digest", "n_bytes", "n_tokens"])

    texts = source.select("digest", "text").mapInArrow(first_of_each, "digest binary, text string")
    if not known.isEmpty():
        texts = texts.join(misses, "digest", "left_semi")
    run_path = f"{cache_path}/run={uuid.uuid4().hex}"
    texts.groupBy("digest").agg(F.first("text").alias("text")).mapInArrow(run, CACHE_SCHEMA).write.parquet(run_path)
    fresh = spark.read.schema(CACHE_SCHEMA).parquet(run_path).select("digest", "n_bytes", "n_tokens")
    return source.select("doc_id", "digest").join(known.unionByName(fresh), "digest", "left").select("doc_id", "digest", "n_bytes", "n_tokens")
