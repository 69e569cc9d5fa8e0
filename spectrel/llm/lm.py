"""Language-model scoring by a weighted backoff automaton of any order.

The model interpolates: P(w | h) = a c(hw) / c(h) + (1 - a) P(w | h without its first word), where a = ``WEIGHT`` x / (x + ``DAMP``)
and x = c(h) - ``HELD``, as a context that was seen once says little of what comes next elsewhere. At the end stands
P(w) = (c(w) + 1) / (N + V + 1), with one unit for unseen words. As an automaton: a state for each context of up to order - 1
words that was seen, an arc for each word seen after it (weight: the interpolated probability), and a failure arc to the state
without the context's first word (weight 1 - a), down to the root, which has an arc for every word. A text is scored from left to
right, carrying the state. The state depends on the last order - 1 words alone, so a long text is gone through in segments
of ``SEGMENT`` words that each read those words first without a score; all segments of a block advance together.

The counts grow with the corpus and are never gathered in one place. Texts are put into blocks of about ``BLOCK_BYTES``; each
block asks for the n-grams that its texts hold, giving its own training counts; the requests are dealt into ranges of
hashed n-grams, where the blocks' counts are added up; and each block gets back, in the order in which it asked, by how much the
totals exceed its own counts. With them it builds the part of the automaton that its texts can reach. So memory depends on the
sizes of a block and of a range alone, a frequent word costs each block one entry, and every n-gram counts, however rare. A
request is one row for each block and range. Both have fixed sizes, so rows are as many as the pieces of Spark's own exchange
of that size, and never more than the n-grams, as no row is empty; with a given number of ranges they grow as the blocks do.

Words are told apart by 64-bit hashes, longer n-grams by 56 bits of theirs. Words are runs between ASCII white space, A-Z in lower
case; each text ends with one end token, and begins in the state of a text's beginning.

Defined cases: a null text is empty and scores its end token; without training rows N = V = 0, the base score is 0 and so
is the score; repeated rows count each; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrel.llm.base import need, small_batches, store, texts_of

ORDER = 3
BLOCK_BYTES = 8_000_000
#: Blocks whose n-grams make one range, which is gone through in as many slices.
RANGE_BLOCKS = 4
SEGMENT = 512
WEIGHT, DAMP, HELD = 0.8, 2.0, 0.95
END, BEGIN = 0, 1
_U = np.uint64
BLOCKS = "block long, payload binary"
REQUESTS = "part int, block long, h array<binary>, c array<binary>"
TOTALS = "block long, part int, more array<binary>, n long, v long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, so that the upper planes compress to nothing."""
    return zstandard.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def pack_sorted(h: np.ndarray, order: int) -> bytes:
    """Differences of sorted hashes; the low byte of longer n-grams is 0 and left out."""
    h = h if order == 1 else h >> _U(8)
    return packed(np.diff(h, prepend=_U(0)))


def unpack_sorted(data: bytes, order: int) -> np.ndarray:
    h = np.cumsum(unpacked(data), dtype=_U)
    return h if order == 1 else h << _U(8)


class Block:
    """Texts as numbers. ``words`` has local word ids (``END``, ``BEGIN``, then words) of all tokens; for each order k, ``grams[k]`` the
    local id of the k-gram that ends at each token (-1 where the text is too short), and of each k-gram its hash, training
    count in the block, context and suffix (ids of order k - 1) in ``hashes``, ``counts``, ``contexts`` and ``suffixes``."""

    def __init__(self, texts: list[str], train: np.ndarray, order: int):
        local: dict[bytes, int] = {}
        ids: list[np.ndarray] = []
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").lower().split()
            for w in set(words):
                if w not in local:
                    local[w] = len(local) + 2
            ids.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
        hashes = np.empty(len(local) + 2, _U)
        hashes[END], hashes[BEGIN] = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
        hashes[2:] = np.fromiter(map(xxhash.xxh3_64_intdigest, local), _U, len(local))
        del local
        width = len(hashes)
        self.order, self.lengths = order, np.array([len(x) + 1 for x in ids], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        words = np.full(int(self.lengths.sum()), END, np.int32)
        for at, x in zip(self.starts.tolist(), ids, strict=True):
            words[at : at + len(x)] = x
        del ids
        learns = np.repeat(train, self.lengths)
        self.grams, self.hashes, self.counts = {1: words}, {1: hashes}, {1: np.bincount(words[learns], minlength=width)}
        self.contexts: dict[int, np.ndarray] = {}
        self.suffixes: dict[int, np.ndarray] = {}
        for k in range(2, order + 1):
            shorter = self.grams[k - 1]
            context = np.empty_like(shorter)
            context[1:] = shorter[:-1]
            context[self.starts] = BEGIN if k == 2 else -1
            key = context.astype(np.int64) * width + words
            key[context < 0] = -1
            del context
            by = np.argsort(key, kind="stable").astype(np.int32)
            key = key[by]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
            first = first[key[first] >= 0]
            gram = np.empty(len(words), np.int32)
            none = first[0] if len(first) else len(by)
            gram[by[:none]] = -1
            gram[by[none:]] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(by))))
            unique, at = key[first], by[first]
            del key, by
            self.grams[k], self.suffixes[k] = gram, shorter[at]
            self.contexts[k] = (unique // width).astype(np.int32)
            self.hashes[k] = mixed(self.hashes[k - 1][self.contexts[k]] * _U(0x9E3779B97F4A7C15) + hashes[(unique % width)]) & ~_U(255)
            self.counts[k] = np.bincount(gram[learns & (gram >= 0)], minlength=len(unique))

    def asked(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(order, ids by hash, hashes) of what the block asks for: all n-grams, without the beginning as a word."""
        for k in range(1, self.order + 1):
            by = np.argsort(self.hashes[k], kind="stable")
            by = by[by != BEGIN] if k == 1 else by
            yield k, by, self.hashes[k][by]


class Automaton:
    """States are contexts of 0 to order - 1 words that were seen. ``arc[k]`` has the weight of the arc that each k-gram is, from its
    context, and ``has[k]`` whether there is one; ``failure[k]`` the weight of the failure arc of each context of k words."""

    def __init__(self, block: Block, counts: dict[int, np.ndarray], n: int, v: int):
        self.block, self.begins = block, int(block.order > 1 and counts[1][END] > 0)
        known = counts[1].astype(np.float64)
        known[BEGIN] = known[END]  # as many texts begin as end
        p = (counts[1] + 1.0) / (n + v + 1.0)
        self.arc, self.has, self.failure = {1: np.log10(p)}, {1: counts[1] > 0}, {}
        for k in range(2, block.order + 1):
            x = np.maximum(known - HELD, 0.0)
            share = WEIGHT * x / (x + DAMP)
            self.failure[k - 1] = np.log10(1 - share)
            context, c = block.contexts[k], counts[k]
            p = share[context] * c / np.maximum(known, 1.0)[context] + (1 - share[context]) * p[block.suffixes[k]]
            self.arc[k], self.has[k], known = np.log10(p), c > 0, c.astype(np.float64)

    def step(self, at: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the tokens ``at`` and the next states. A state is its number of words: its n-gram ends before the token."""
        weight = np.zeros(len(at))
        after = np.full(len(at), -1)
        for k in range(self.block.order - 1, 0, -1):  # contexts of k words: an arc, or the failure arc to those of k - 1
            here = np.flatnonzero((state == k) & (after < 0))
            if not len(here):
                continue
            gram = self.block.grams[k + 1][at[here]]
            arc = self.has[k + 1][gram]
            hit, miss = here[arc], here[~arc]
            weight[hit] += self.arc[k + 1][gram[arc]]
            after[hit] = k + 1
            weight[miss] += self.failure[k][self.block.contexts[k + 1][gram[~arc]]]
            state[miss] = k - 1
        rest = np.flatnonzero(after < 0)
        word = self.block.grams[1][at[rest]]
        weight[rest] += self.arc[1][word]
        after[rest] = self.has[1][word]
        return weight, np.minimum(after, self.block.order - 1)

    def score(self) -> np.ndarray:
        """The log10 probability of each text."""
        warm = self.block.order - 1
        pieces = -(-self.block.lengths // SEGMENT)
        text = np.repeat(np.arange(len(pieces)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = self.block.starts[text] + number * SEGMENT
        last = np.minimum(first + SEGMENT, (self.block.starts + self.block.lengths)[text])
        at = np.maximum(first - warm, self.block.starts[text])
        at[number == 0] = first[number == 0]
        # A text's first segment starts in the state of the beginning, the others at the root, some words earlier.
        state = np.where(at == self.block.starts[text], self.begins, 0)
        order = np.argsort(at - last, kind="stable")
        at, first, last, state = at[order], first[order], last[order], state[order]
        total = np.zeros(len(at))
        steps = last - at
        ends = np.searchsorted(-steps, -np.arange(steps[0] if len(steps) else 0), side="left")
        for t, alive in enumerate(ends.tolist()):
            here = at[:alive] + t
            weight, state[:alive] = self.step(here, state[:alive])
            total[:alive] += np.where(here >= first[:alive], weight, 0.0)
        return np.bincount(text[order], total, len(pieces))


def _unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def blocks(df: DataFrame) -> DataFrame:
    """block, payload: the rows of an input partition in compressed blocks. ``df``: doc_id, held_out, text."""
    limit = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def packed_block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

        for batch in batches:
            for at in range(0, len(batch), 32):
                part = batch.slice(at, 32)
                part = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts_of(part.column(2)), pa.string())], names=["doc_id", "held_out", "text"])
                held.append(part)
                size += part.column("text").nbytes
                if size >= limit:
                    yield packed_block()
                    number, held, size = number + 1, [], 0
        if held:
            yield packed_block()

    return df.mapInArrow(run, BLOCKS)


def _block(payload: pa.Buffer, order: int) -> tuple[pa.Table, Block]:
    table = _unpacked(payload)
    block = Block(table.column("text").to_pylist(), ~np.asarray(table.column("held_out")), order)
    return table.select(["doc_id", "held_out"]), block


def requests(blocks_: DataFrame, parts: int, order: int) -> DataFrame:
    """part, block, and for each order and slice of the part the block's n-grams and training counts there."""
    slices = RANGE_BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                _, block = _block(payload.as_buffer(), order)
                rows: dict[int, tuple[list, list]] = {}
                for k, by, h in block.asked():
                    c = block.counts[k][by]
                    fine = ((h >> _U(32)) * _U(parts * slices)) >> _U(32)
                    cuts = np.searchsorted(fine, np.arange(parts * slices + 1).astype(_U)).tolist()
                    for p in range(parts):
                        if cuts[p * slices] < cuts[(p + 1) * slices]:
                            hs, cs = rows.setdefault(p, ([None] * (order * slices), [None] * (order * slices)))
                            for s in range(slices):
                                own = slice(cuts[p * slices + s], cuts[p * slices + s + 1])
                                hs[(k - 1) * slices + s], cs[(k - 1) * slices + s] = pack_sorted(h[own], k), packed(c[own])
                del block
                for p, (hs, cs) in rows.items():
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([number], pa.int64()), pa.array([hs], pa.list_(pa.binary())), pa.array([cs], pa.list_(pa.binary()))], names=["part", "block", "h", "c"])

    return blocks_.mapInArrow(run, REQUESTS)


def totals(blocks_: DataFrame, parts: int, order: int) -> DataFrame:
    """For each block and part by how much the total counts exceed the block's own; in block -1, N and V of a part."""
    slices = RANGE_BLOCKS

    def added(table: pa.Table) -> pa.Table:
        numbers = table.column("block").to_pylist()
        more: list[list] = [[None] * (order * slices) for _ in numbers]
        n = v = 0
        for i in range(order * slices):
            k = i // slices + 1
            some = [r for r in range(len(numbers)) if table.column("h")[r][i].is_valid]
            if not some:
                continue
            hs = [unpack_sorted(table.column("h")[r][i].as_py(), k) for r in some]
            cuts = np.cumsum([0, *map(len, hs)])
            h = np.concatenate(hs)
            del hs
            by = np.argsort(h, kind="stable")
            h = h[by]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
            del h
            c = np.concatenate([unpacked(table.column("c")[r][i].as_py()) for r in some]).astype(np.int64)
            total = np.add.reduceat(c[by], first) if len(first) else c
            if k == 1:
                n, v = n + int(total.sum()), v + int((total > 0).sum())
            beyond = np.empty_like(c)
            beyond[by] = np.repeat(total, np.diff(np.append(first, len(by))))
            beyond -= c
            for at, r in enumerate(some):
                more[r][i] = packed(beyond[cuts[at] : cuts[at + 1]])
        part = table.column("part")[0].as_py()
        rows = [[*numbers, -1], [part] * (len(numbers) + 1), [*more, []], [0] * len(numbers) + [n], [0] * len(numbers) + [v]]
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=["block", "part", "more", "n", "v"])

    return requests(blocks_, parts, order).repartition(2 * parts, "part").groupBy("part").applyInArrow(added, TOTALS)


def _counts(block: Block, model: pa.Table) -> dict[int, np.ndarray]:
    """The block's counts with what the others have."""
    rows = np.argsort(np.asarray(model.column("part"))).tolist() if len(model) else []
    slices, out = RANGE_BLOCKS, {}
    for k, by, _ in block.asked():
        pieces = [x for r in rows for x in model.column("more")[r].as_py()[(k - 1) * slices : k * slices] if x is not None]
        counts = block.counts[k].copy()
        if pieces:
            counts[by] += np.concatenate([unpacked(x) for x in pieces]).astype(np.int64)
        out[k] = counts
    return out


def score(df: DataFrame, held_out: Column, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all rows by the model of those that are not held out: ``SCORES``."""
    if order < 1:
        raise ValueError("the order is 1 at least")
    spark = df.sparkSession
    small_batches(spark)
    need(df, doc_id, text)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    held = store(blocks(rows), "lm-blocks")
    n_blocks = max(1, held.count())
    parts = -(-n_blocks // RANGE_BLOCKS)
    model = store(totals(held, parts, order), "lm-totals")
    n, v = model.where("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for payload in left.column("payload"):
            table, block = _block(payload.as_buffer(), order)
            counts = _counts(block, right)
            automaton = Automaton(block, counts, n, v)
            words = block.grams[1]
            base = np.add.reduceat(automaton.arc[1][words], block.starts)
            known = np.add.reduceat((counts[1] > 0)[words].astype(np.int64), block.starts)
            value = automaton.score()
            arrays = [table.column("doc_id").combine_chunks(), table.column("held_out").combine_chunks(), pa.array(block.lengths), pa.array(known), pa.array(np.full(len(known), n, np.int64)), pa.array(base), pa.array(value)]
            out.append(pa.Table.from_arrays(arrays, names=[c.split()[0] for c in SCORES.split(", ")]))
        kinds = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables(out) if out else kinds.empty_table()

    # As many tasks as there are blocks: neither the ranges above nor these grow with the input.
    dealt = lambda df: df.repartition(n_blocks, "block").groupBy("block")
    return dealt(held).cogroup(dealt(model.where("block >= 0"))).applyInArrow(scored, SCORES)
