"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector over hashed text features is shared by all grades, and the
thresholds theta are kept in order. Features of a text, hashed to ``DIM`` buckets: each distinct lower-case word without
outer punctuation (presence), the share of tokens of each shape (letter case, digits, punctuation; runs collapsed), and
the shares of tokens that repeat the token before and that repeat any earlier token.

The model is fitted on at most ``sample_rows`` rated rows (those of the smallest hashed id) by full-batch Adam on the
driver, as a fixed number of passes over sparse arrays; prediction is narrow and takes one model of ``DIM`` floats.

Defined cases: null and empty texts have no features, so the thresholds decide alone; a rating whose document lacks, a null
grade or a grade outside the range is ignored; of rows that repeat a rated doc_id the smallest text teaches; without ratings every document gets the best grade (nothing can be
rejected); repeated rows get equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.llm.base import need, small_batches, texts_of

DIM = 1 << 18
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CACHE_TOKENS = 300_000
WORD_VALUE, SHARE_VALUE = 0.5, 4.0


def bucket(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & (DIM - 1)


def shape(token: str) -> str:
    """A letter for each run of a class of characters, punctuation as itself."""
    out = ""
    for c in token:
        k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if k != out[-1:]:
            out += k
    return out[:12]


_CACHE: dict[str, tuple[int, int]] = {}


def _coded(token: str) -> tuple[int, int]:
    found = _CACHE.get(token)
    if found is None:
        if len(_CACHE) >= CACHE_TOKENS:
            _CACHE.clear()
        word = token.lower().strip(PUNCTUATION)
        found = (bucket("w:" + word) if word else -1, bucket("s:" + shape(token)))
        if len(token) <= 100:
            _CACHE[token] = found
    return found


REPEATS, AGAIN = bucket("r:adjacent"), bucket("r:earlier")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (each once) and values."""
    tokens = text.split()
    if not tokens:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    words: set[int] = set()
    share: dict[int, float] = {}
    counts = Counter(tokens)
    for token, n in counts.items():
        w, s = _coded(token)
        words.add(w)
        share[s] = share.get(s, 0) + n
    words.discard(-1)
    values = dict.fromkeys(words, WORD_VALUE)
    each = SHARE_VALUE / len(tokens)
    share[REPEATS] = share.get(REPEATS, 0) + sum(map(str.__eq__, tokens, tokens[1:]))
    share[AGAIN] = share.get(AGAIN, 0) + len(tokens) - len(counts)
    for s, n in share.items():
        values[s] = values.get(s, 0.0) + n * each
    return np.fromiter(values.keys(), np.int32, len(values)), np.fromiter(values.values(), np.float32, len(values))


@dataclass
class Ordinal:
    """weights (DIM), thresholds (one fewer than grades, increasing)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a row for each score."""
        z = np.clip(score[:, None] - self.thresholds[None, :], -500, 500)
        return 1 / (1 + np.exp(-z))


def fit_arrays(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, passes: int = 150, l2: float = 2e-3, rate: float = 0.05, min_docs: int = 4) -> Ordinal:
    """Maximum penalised likelihood by full-batch Adam. Features in fewer than ``min_docs`` rows keep weight 0."""
    if not len(grades):
        return Ordinal(np.zeros(DIM, np.float32), np.full(n_grades - 1, -1e3))
    index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    used = np.flatnonzero(np.bincount(index, minlength=DIM) >= min_docs)
    place = np.full(DIM, -1, np.int64)
    place[used] = np.arange(len(used))
    ok = place[index] >= 0
    index, value, row = place[index][ok], value[ok], row[ok]
    n, d, k = len(grades), len(used), n_grades - 1
    # Parameters: weights, first threshold, logs of the gaps. Start at the shares of the grades.
    shares = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades)[:-1]) / n, 0.005, 0.995)
    theta = np.log(shares / (1 - shares))
    gaps = np.log(np.maximum(np.diff(theta), 0.05))
    x = np.concatenate([np.zeros(d), theta[:1], gaps])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, passes + 1):
        w, t = x[:d], np.concatenate([[x[d]], x[d] + np.cumsum(np.exp(x[d + 1 :]))])
        score = np.bincount(row, value * w[index], n)
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        up, low = 1 / (1 + np.exp(-np.clip(edges[grades + 1] - score, -500, 500))), 1 / (1 + np.exp(-np.clip(edges[grades] - score, -500, 500)))
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        g_score = (du - dl) / n  # of the negative log likelihood
        g_edge = np.bincount(grades, dl / n, n_grades)[1:] - np.bincount(grades, du / n, n_grades)[:-1]
        tail = np.cumsum(g_edge[::-1])[::-1]
        g = np.concatenate([np.bincount(index, value * g_score[row], d) + l2 * w / 10, tail[:1], tail[1:] * np.exp(x[d + 1 :])])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIM, np.float32)
    weights[used] = x[:d]
    assert k == len(x) - d
    return Ordinal(weights, np.concatenate([[x[d]], x[d] + np.cumsum(np.exp(x[d + 1 :]))]))


def fit(df: DataFrame, ratings: DataFrame, n_grades: int, sample_rows: int = 8000, doc_id: str = "doc_id", text: str = "text", grade: str = "grade") -> Ordinal:
    """``ratings``: doc_id, grade (0 to ``n_grades`` - 1). At most ``sample_rows`` of them are used."""
    spark = df.sparkSession
    small_batches(spark)
    rated = need(ratings, doc_id, grade).toDF("doc_id", "grade").where(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1))
    chosen = rated.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "grade").limit(sample_rows)  # this bounds what is broadcast
    rows = need(df, doc_id, text).toDF("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One text of each rating, however often its id repeats, so no more than ``sample_rows`` are collected.
    rows = rows.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("grade").cast(pa.int32()), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], names=["doc_id", "grade", "i", "v"])

    got = sorted(rows.select("doc_id", "grade", "text").mapInArrow(run, "doc_id string, grade int, i binary, v binary").collect())
    return fit_arrays([(np.frombuffer(r.i, np.int32), np.frombuffer(r.v, np.float32)) for r in got], np.array([r.grade for r in got], np.int64), n_grades)


def predict(df: DataFrame, model: Ordinal, select_grade: int, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """Adds expected_grade, tail_probability (of ``select_grade`` or better) and kept. Narrow."""
    spark = df.sparkSession
    small_batches(spark)
    clash = {"expected_grade", "tail_probability", "kept"} & set(df.columns)
    if clash:
        raise ValueError(f"columns exist: {', '.join(sorted(clash))}")
    sent = spark.sparkContext.broadcast(model)  # DIM floats
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "expected_grade double, tail_probability double, kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            scores = np.array([float(m.weights[i] @ v) for i, v in map(features, texts_of(batch.column(text)))])
            tails = m.tails(scores.reshape(-1))
            best = tails[:, select_grade - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(axis=1), pa.float64()), pa.array(best, pa.float64()), pa.array(best >= threshold, pa.bool_())], names=[*batch.schema.names, "expected_grade", "tail_probability", "kept"])

    return df.mapInArrow(run, schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """Three grades: 0 poor, 1 well-formed but toxic, 2 well-formed and clean. A null toxic mark counts as clean."""
    labels = need(labels, "doc_id", "quality", "toxic")
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") < 1, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2).alias("grade"))
