"""Exact n-gram Jaccard self-join by partitions of the token universe, and its connected components.

A document's set are its distinct n-word shingles (64-bit hashes). Sets of sizes a and b with Jaccard similarity of at
least num/den differ in at most H = floor((den - num)(a + b) / (den + num)) tokens. Sizes fall into bands whose ends are in
the ratio of the threshold, so partners lie in the same band or the one below or above. In each band the hashes are dealt into m
segments; a segment's subset that two sets share exactly stands for one unit, and one that they share up to one
insertion or deletion for two. By the pigeonhole principle sets that are similar agree somewhere whenever the units exceed H.

``allocation`` chooses for each band, by cost (signatures written, and chance agreements of short segments), how many
segments get the one-deletion neighbourhood; m follows from that. A set writes all signatures of its own band, and in the
band below as many of the fullest segments as its own H there asks for. Equal sets are reduced to one representative
before. Signatures that occur once are left out by a count that is combined before the shuffle. Documents of the others are
paired with the smallest document of their signature (a star, not all pairs), pairs are thinned by sizes and by the distance of
parity sketches (a lower bound of the true distance), and what is left is verified exactly on the texts. Pairs of a signature
that its star does not settle, because its documents are still in different components, are searched block by block inside tasks,
by the same bound, then verified too; a signature has blocks of about ``BLOCK`` documents, dealt by a hash. So no link between
components is missed, at any group size, and no task holds all documents of a signature: those meet their group's figures
in joins, whose hot keys Spark splits.

Defined cases: a document without words or with null text has the empty set, is linked with nothing and is its own
component; with fewer than n words the whole sequence is its one shingle; rows that repeat a doc_id are one document that has
each of their sets, and links by any of them; a null doc_id gets the component of its equals, null if there are none; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.llm.base import discard, need, small_batches, store

#: A sketch has as many bits as the set has tokens, rounded up to a power of two, within these.
LEAST_BITS, MOST_BITS = 256, 1 << 17
BLOCK = 512
#: Links of one task and file in the rounds for the components.
LINKS_A_TASK = 250_000
CACHE_WORDS = 400_000
#: Chance that a token of one set is in another by accident, and documents that a segment's chance agreements cost.
CHANCE, CROWD = 0.01, 1e5
_U = np.uint64
_WORDS: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes. Words are runs between ASCII white space, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U)
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    for w in set(words):
        if w not in _WORDS:
            _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_WORDS.__getitem__, words), _U, len(words))
    k = min(n, len(h))
    acc = np.full(len(h) - k + 1, k if k < n else 0, _U)
    for i in range(k):
        acc = mixed(acc * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(acc)


def distance(a: int, b: int, num: int, den: int) -> int:
    """The most tokens in which similar sets of these sizes differ."""
    return (den - num) * (a + b) // (den + num)


@lru_cache(maxsize=None)
def allocation(lo: int, hi: int, num: int, den: int) -> tuple[int, int]:
    """(m, e): segments of the band, and how many of them, the first, get one-deletion neighbourhoods."""
    most = distance(hi, hi * den // num, num, den)
    best = None
    for e in range((most + 1) // 2 + 1):
        m = max(1, most + 1 - e)
        held = lo / m
        cost = m + 2 * e * held + CROWD * ((m - e) * CHANCE**held + e * CHANCE ** max(0.0, held - 1))
        # Empty segments agree by accident; they do no harm while so many need not be looked up.
        empty = m * math.exp(-held)
        spare = m + e - distance(hi, hi, num, den) - 1
        cost += CROWD / 1000 * max(0.0, empty + 3 * math.sqrt(empty) - spare)
        if best is None or cost < best[0]:
            best = (cost, m, e)
    return best[1], best[2]


@lru_cache(maxsize=None)
def band_of(size: int, num: int, den: int) -> tuple[int, int, int]:
    """Number, least and largest size of the band."""
    k, lo = 0, 1
    while True:
        hi = lo * den // num
        if size <= hi:
            return k, lo, hi
        k, lo = k + 1, hi + 1


INDEX, PROBE = 1, 2


def signatures(tokens: np.ndarray, band: tuple[int, int, int], num: int, den: int, own: bool) -> np.ndarray:
    """Signatures of a set in a band; the lowest two bits tell what each is for.

    In its own band a set is indexed by all segments. It is looked up there, and in the band below, by as many of its
    fullest segments as its own H with the band asks for, so that segments with few tokens, or none, meet no one.
    """
    k, lo, hi = band
    m, e = allocation(lo, hi, num, den)
    most = distance(len(tokens), hi, num, den)
    segment = ((tokens >> _U(20)) % _U(m)).astype(np.int64)
    content = mixed(tokens)
    # A segment's subset is known by the sum of its tokens' hashes; the band and segment number keep others apart.
    sums = np.zeros(m, _U)
    np.add.at(sums, segment, content)
    salt = mixed(np.arange(m, dtype=_U) + _U((k + 1) << 32))
    fill = np.bincount(segment, minlength=m)
    units = np.where(np.arange(m) < e, 2, 1)
    order = np.argsort(-fill, kind="stable")
    kind = np.full(m, INDEX if own else 0, _U)
    kind[order[: int(np.searchsorted(np.cumsum(units[order]), most + 1)) + 1]] |= _U(PROBE)
    use = kind > 0
    out = [mixed(sums ^ salt)[use] & ~_U(3) | kind[use]]
    if e:
        near = (segment < e) & use[segment]
        out.append(mixed((sums[segment[near]] - content[near]) ^ salt[segment[near]]) & ~_U(3) | kind[segment[near]])
    return np.unique(np.concatenate(out))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens in each place, as words of 64 bits. Halves may be folded by exclusive or."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(tokens) - 1).bit_length()))
    place = (mixed(tokens) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).view("<i8")


def folded(words: np.ndarray, length: int) -> np.ndarray:
    while len(words) > length:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


SET_SCHEMA = "doc_id long, n_shingles long, set_hash binary, sketch array<long>"
SIGN_SCHEMA = "doc_id long, set_hash binary, sigs array<long>"


def set_hash(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def sets(df: DataFrame, n: int) -> DataFrame:
    """A row per document: size, hash and sketch of its set. Narrow."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, n) for t in batch.column("text").to_pylist()]
            sketches = pa.array([sketch(t) for t in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, found), pa.int64()), pa.array([set_hash(t) for t in found], pa.binary()), sketches], names=["doc_id", "n_shingles", "set_hash", "sketch"])

    return df.mapInArrow(run, SET_SCHEMA)


def signed(df: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """A row per document with words: its signatures in its own band and the one below. Narrow."""

    def all_signatures(t: np.ndarray) -> np.ndarray:
        band = band_of(len(t), num, den)
        out = signatures(t, band, num, den, True)
        if band[0] and (band[1] - 1) * den >= len(t) * num:
            out = np.concatenate([out, signatures(t, band_of(band[1] - 1, num, den), num, den, False)])
        return out.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, t) for k, t in zip(batch.column("doc_id").to_pylist(), (shingles(x, n) for x in batch.column("text").to_pylist()), strict=True) if len(t) and k is not None]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([set_hash(t) for _, t in found], pa.binary()), pa.array([all_signatures(t) for _, t in found], pa.list_(pa.int64()))], names=["doc_id", "set_hash", "sigs"])

    return df.mapInArrow(run, SIGN_SCHEMA)


def thin(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches do not rule out."""
    side = lambda x: sizes.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # Similar sizes differ by one power of two at most; sketches that differ by more are not compared.
    half = lambda c, n: F.zip_with(F.slice(c, 1, n), F.slice(c, n + 1, n), lambda x, y: x.bitwiseXOR(y))
    even = lambda c, d: F.when(F.size(c) == 2 * F.size(d), half(c, F.size(d))).otherwise(F.col(c))
    both = both.withColumn("x", even("sketch_a", "sketch_b")).withColumn("y", even("sketch_b", "sketch_a"))
    counted = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    apart = F.when(F.size("x") == F.size("y"), counted).otherwise(F.lit(0))
    close = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    return both.where(close).where(apart <= F.floor((den - num) * (F.col("n_a") + F.col("n_b")) / (den + num))).select("a", "b").distinct()


def verify(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs whose sets are similar, by their texts."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(wanted, "doc_id", "left_semi").distinct()
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, np.empty(0, _U)
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if ta != last:
                    last, found = ta, shingles(ta, n)
                other = shingles(tb, n)
                common = len(np.intersect1d(found, other, assume_unique=True))
                keep.append(den * common >= num * (len(found) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that each linked node reaches. Rounds of smallest neighbour and pointer jump.

    Tables of the rounds have tasks and files by the number of links (counted from the footers of the stored links), so that
    few links do not write a small file for each shuffle partition in every round.
    """
    tasks = max(1, -(-links.count() // LINKS_A_TASK))
    edges = store(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks), "jaccard-edges")
    labels = held = store(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")).coalesce(tasks), "jaccard-labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(seen.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        # A component is a node, so its own label may be smaller still.
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = store(step.join(jump, "component", "left").select("node", "old", F.least("component", "further").alias("component")).coalesce(tasks), "jaccard-labels")
        changed = not new.where("component <> old").isEmpty()
        discard(held)
        labels, held = new.drop("old"), new
        if not changed:
            discard(edges)
            return labels


def _unsettled(hits: DataFrame, parts: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that share a signature, are in different components and were in no star; searched block by block."""
    named = hits.join(parts, hits["doc_id"] == parts["node"], "left").drop("node")
    named = named.withColumn("component", F.coalesce("component", "doc_id"))
    mixed_groups = named.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size"))
    # Stored, so that Spark knows its size before it moves rows to meet it.
    mixed_groups = store(mixed_groups.where("x <> y").select("sig", F.floor((F.col("size") - 1) / BLOCK).alias("last")), "jaccard-mixed")
    rows = named.join(mixed_groups, "sig").join(sizes, "doc_id").select("sig", "last", "doc_id", "kind", "leader", "component", "n_shingles", "sketch")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "sig"), F.col("last") + 1))
    # Block pair (i, j), i <= j: a row goes to the pairs that its block is part of.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = rows.select("sig", "i", "j", "block", "doc_id", "kind", "leader", "component", "n_shingles", "sketch")
    rows = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "block", "doc_id")

    def group(part: pa.Table) -> tuple[list[int], list[int]]:
        doc, kind, comp, size = (part.column(c).to_numpy() for c in ("doc_id", "kind", "component", "n_shingles"))
        block, leader = part.column("block").to_numpy(), part.column("leader").to_numpy()[0]
        words = [np.array(x, np.int64) for x in part.column("sketch").to_pylist()]
        lengths = np.array([len(x) for x in words])
        none = {n: np.zeros(n, np.int64) for n in np.unique(lengths).tolist()}
        bits = {n: np.stack([folded(x, n) if len(x) >= n else none[n] for x in words]).view(_U) for n in none}
        i, j = int(part.column("i")[0].as_py()), int(part.column("j")[0].as_py())
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a_out, b_out = [], []
        for x in left.tolist():
            r = right[right > x] if i == j else right
            meets = (kind[r] & INDEX > 0) & (kind[x] & PROBE > 0) | (kind[r] & PROBE > 0) & (kind[x] & INDEX > 0)
            r = r[(comp[r] != comp[x]) & meets & (doc[r] != leader)]
            if doc[x] == leader or not len(r):
                continue
            r = r[np.minimum(size[r], size[x]) * den >= np.maximum(size[r], size[x]) * num]
            shared = np.minimum(lengths[r], lengths[x])
            apart = np.zeros(len(r), np.int64)
            for n in np.unique(shared).tolist():
                some = r[shared == n]
                apart[shared == n] = np.bitwise_count(bits[n][some] ^ bits[n][x]).sum(axis=1, dtype=np.int64)
            r = r[apart <= (den - num) * (size[r] + size[x]) // (den + num)]
            a_out += np.minimum(doc[r], doc[x]).tolist()
            b_out += np.maximum(doc[r], doc[x]).tolist()
        return a_out, b_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _ended(batches):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held is None or not len(held):
                continue
            keys = np.stack([held.column(c).to_numpy() for c in ("sig", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(held)]
            whole = cuts if batch is None else cuts[:-1]  # the last group may go on
            a_out, b_out = [], []
            for at, to in zip(whole[:-1], whole[1:], strict=True):
                a, b = group(held.slice(at, to - at).combine_chunks())
                a_out, b_out = a_out + a, b_out + b
            held = held.slice(whole[-1])
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def join(df: DataFrame, n: int = 3, num: int = 90, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, links). classes: doc_id, n_shingles, representative, component_id, a row per document; links: a, b, the verified
    pairs of representatives that connect the components."""
    docs = need(df, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = store(sets(docs, n), "jaccard-sets")
    filled = found.where("n_shingles > 0")
    equal = store(filled.groupBy("set_hash").agg(F.min("doc_id").alias("representative")), "jaccard-equal")
    sizes = filled.join(equal, "set_hash").where("doc_id = representative").dropDuplicates(["doc_id", "set_hash"])
    sizes = store(sizes.select("doc_id", "n_shingles", "sketch"), "jaccard-sizes")
    # Equal sets are reduced to one before signatures move; that of the smallest id, as in ``equal``.
    chosen = signed(docs, n, num, den).groupBy("set_hash").agg(F.min_by("sigs", "doc_id").alias("sigs"), F.min("doc_id").alias("doc_id"))
    chosen = store(chosen.select("doc_id", "sigs"), "jaccard-signatures")
    rows = chosen.select("doc_id", F.explode("sigs").alias("coded"))
    rows = rows.select("doc_id", F.expr("coded & -4L").alias("sig"), F.expr("cast(coded & 3L as int)").alias("kind"))
    # Nearly all signatures occur once; the others are known before rows move.
    again = store(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("sig"), "jaccard-again")
    met = store(rows.join(again, "sig"), "jaccard-met")
    discard(chosen, again)
    leader = F.min(F.when(F.col("kind").bitwiseAND(INDEX) > 0, F.col("doc_id")))
    groups = met.groupBy("sig").agg(leader.alias("leader"), F.count(F.lit(1)).alias("group_size"), F.count_if(F.col("kind").bitwiseAND(PROBE) > 0).alias("probes"))
    groups = store(groups.where("leader is not null and probes > 0").drop("probes"), "jaccard-groups")
    hits = store(met.join(groups, "sig"), "jaccard-hits")
    discard(met, groups)
    star = hits.where("doc_id <> leader").select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct()
    links = store(verify(store(thin(star, sizes, num, den), "jaccard-pairs"), docs, n, num, den), "jaccard-links")
    parts = components(links)
    more = store(_unsettled(hits.where("group_size > 2"), parts, sizes, num, den), "jaccard-pairs")
    if not more.isEmpty():
        links = store(links.unionByName(verify(more, docs, n, num, den)), "jaccard-links")
        parts = components(links)
    classes = found.select("doc_id", "n_shingles", "set_hash").join(equal, "set_hash", "left")
    classes = classes.join(parts.withColumnRenamed("node", "representative"), "representative", "left")
    whole = F.when(F.col("n_shingles") > 0, F.coalesce("component", "representative")).otherwise(F.col("doc_id"))
    return classes.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("representative")).alias("representative"), whole.alias("component_id")), links
