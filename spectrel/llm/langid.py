"""Language identification by multilingual mixture inference.

Training counts letter trigrams (with word edges) by language, in ``BUCKETS`` hash buckets; the model is one distribution
of buckets for each language, of a size that does not grow with the corpus. A document is a mixture: expectation-
maximisation estimates its languages' proportions from the trigrams' likelihoods under each language. Languages are then
taken in order of proportion while the penalised likelihood rises (a language costs ``PENALTY`` log n), each set with
proportions of its own; the language with the largest proportion of the chosen set is the prediction, and that
proportion its score.

Training counts are added up within each task before the shuffle. A language that fewer than ``LEAST_SHARE`` of the rows with one have is not
learned, so the model is bounded even where the column holds other things than languages.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text if nothing was learned;
rows without language or text teach nothing; ties go to the language that sorts first; repeated rows count each; an empty
table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrel.llm.base import discard, need, small_batches, store

BUCKETS = 1 << 16
SMOOTHING = 0.5
PENALTY = 3.0
ROUNDS = 12
#: Of the rows with a language: what one must have to be learned. It bounds the number of languages.
LEAST_SHARE = 1 / 512

_LETTER = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)
    return _LETTER


def trigrams(text: str) -> np.ndarray:
    """Bucket of the trigram around each letter; other characters count as one edge."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    c = np.where(letter, codes, np.uint32(0)).astype(np.uint64)
    mixed = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(48)).astype(np.int64)[letter[1:-1]]


@dataclass
class Languages:
    names: list[str]
    log_p: np.ndarray  # languages x BUCKETS

    def predict(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """Best language, its proportion, and the chosen set with proportions."""
        found = trigrams(text) if text else np.empty(0, np.int64)
        if not len(found) or not self.names:
            return "und", 0.0, []
        n = np.bincount(found, minlength=BUCKETS)
        index = np.flatnonzero(n)
        n = n[index].astype(np.float64)
        log_p = self.log_p[:, index].astype(np.float64)
        top = log_p.max(axis=0)
        p, total = np.exp(log_p - top), n.sum()

        def mixture(p: np.ndarray) -> tuple[np.ndarray, float]:
            share = np.full(len(p), 1 / len(p))
            for _ in range(ROUNDS):
                share = share * (p @ (n / (share @ p))) / total
            return share, float(n @ np.log(share @ p))

        full, _ = mixture(p)
        order = np.argsort(-full, kind="stable")
        single = p @ np.zeros(len(n)) + np.log(p) @ n
        chosen, share, best = [int(np.argmax(single))], np.ones(1), float(single.max())
        for k in (k for k in order.tolist() if k != chosen[0]):
            new_share, value = mixture(p[[*chosen, k]])
            if value - best <= PENALTY * np.log(total + 1):
                break
            chosen, share, best = [*chosen, k], new_share, value
        ranked = sorted(zip((-share).tolist(), (self.names[k] for k in chosen), strict=True))
        return ranked[0][1], min(1.0, -ranked[0][0]), [(name, -s) for s, name in ranked]


def train(df: DataFrame, text: str = "text", lang: str = "lang", least_share: float = LEAST_SHARE) -> Languages:
    """Counts by language of all rows of the languages that at least ``least_share`` of the rows with one have.

    So there are 1 / ``least_share`` languages at most, whatever a dirty column holds: that bounds what a task adds up and what reaches the
    driver (``BUCKETS`` numbers a language, one language at a time).
    """
    spark = df.sparkSession
    small_batches(spark)
    named = need(df, text, lang).toDF("text", "lang").where("lang is not null")
    counts = store(named.groupBy("lang").count(), "langid-counts")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    names = sorted(r.lang for r in counts.where(F.col("count") >= least_share * total).select("lang").collect())
    discard(counts)
    if not names:
        return Languages([], np.zeros((0, BUCKETS), np.float32))
    rows = named.where(F.col("text").isNotNull() & F.col("lang").isin(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k not in counts:
                    counts[k] = np.zeros(BUCKETS, np.int64)
                counts[k] += np.bincount(trigrams(t), minlength=BUCKETS)
        for k, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(c[some], pa.int64())], names=["lang", "bucket", "n"])

    summed = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for r in summed.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).toLocalIterator():
        own = np.zeros(BUCKETS)
        own[np.array(r.bucket)] = r.n
        found[r.lang] = np.log((own + SMOOTHING) / (own.sum() + SMOOTHING * BUCKETS)).astype(np.float32)
    names = sorted(found)
    return Languages(names, np.stack([found[k] for k in names]) if names else np.zeros((0, BUCKETS), np.float32))


def predict(df: DataFrame, model: Languages, *keep: Column | str, text: str = "text") -> DataFrame:
    """The columns of ``keep``, lang_pred, score, and languages (array of lang, share). Narrow."""
    spark = df.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    source = df.select(*keep, F.col(text).alias("__text"))
    fields = source.schema.fields[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double, languages array<struct<lang: string, share: double>>"])
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = [m.predict(t) for t in batch.column("__text").to_pylist()]
            sets = [[{"lang": a, "share": s} for a, s in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(sets, kind)], names=[*batch.schema.names[:-1], "lang_pred", "score", "languages"])

    return source.mapInArrow(run, schema)
