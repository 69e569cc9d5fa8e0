"""Tables of vectors as blocks: a row holds the packed numbers of some thousand vectors, so tasks work on whole matrices.

A block is (block, n, ids, m): the number of its rows, their ids (int64) and their values (float64, row after row), little-endian. Blocks
have a bounded number of rows, so a task holds a few matrices of bounded size at a time, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrel.operators.peaks import numbered
from spectrel.runtime import settled, ship

ROWS = 1024
#: Bytes of partial sums that a task holds before it passes them on, and edges of a pack.
HELD, PACK = 16 << 20, 1 << 16
SCHEMA = "block int, n int, ids binary, m binary"


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches, one at a time; binary values are views of the batch."""
    for batch in batches:
        columns = {name: (c, pa.types.is_binary(c.type)) for name, c in zip(batch.schema.names, batch.columns, strict=True)}
        for i in range(len(batch)):
            yield {name: c[i].as_buffer() if binary else c[i].as_py() for name, (c, binary) in columns.items()}


def floats(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(rows, -1)


def packed(x: np.ndarray, kind: str = "<f8") -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def vectors_of(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(flat.offsets.to_numpy())
    if (lengths != lengths[:1]).any():
        raise ValueError("the vectors are of unequal lengths")
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def pack(rows: DataFrame) -> DataFrame:
    """Blocks of (block, id, v), in each by id."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, m = table["id"].to_numpy(), vectors_of(table["v"], len(table))
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([packed(ids, "<i8")], pa.binary()), "m": pa.array([packed(m)], pa.binary())})

    return rows.select(F.col("block").cast("int").alias("block"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).groupBy("block").applyInArrow(run, SCHEMA)


def unpack(blocks: DataFrame, **columns: str) -> DataFrame:
    """id and an array column for each packed one: rows again. ``columns``: new name = packed column."""
    names = columns or {"v": "m"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            out = [pa.array(np.frombuffer(row["ids"], "<i8"))]
            for c in names.values():
                x = floats(row[c], row["n"])
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(row["n"] + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())))
            yield pa.RecordBatch.from_arrays(out, names=["id", *names])

    return blocks.select("n", "ids", *dict.fromkeys(names.values())).mapInArrow(run, "id long, " + ", ".join(f"{c} array<double>" for c in names))


def _one(block: int, n: int, ids: bytes | pa.Buffer, **columns: np.ndarray) -> pa.RecordBatch:
    """A block with its packed columns."""
    binary = [pa.array([bytes(ids)], pa.binary()), *(pa.array([packed(x)], pa.binary()) for x in columns.values())]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n], pa.int32()), *binary], names=["block", "n", "ids", *columns])


def mapped(blocks: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Each block with ``f`` of its matrix, row by row."""
    def run(batches):
        for row in each(batches):
            yield _one(row["block"], row["n"], row["ids"], m=f(floats(row["m"], row["n"])))

    return blocks.select("block", "n", "ids", "m").mapInArrow(run, SCHEMA)


def summed(blocks: DataFrame, columns: list[str], f: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``f`` of their packed columns, a matrix. Tasks add up their own; its rows are then added up by number
    on the executors, so the driver gets as many rows as the matrix has, however many tasks there are."""
    def run(batches):
        total = None
        for row in each(batches):
            part = f(*[floats(row[c], row["n"]) for c in columns])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([packed(r) for r in total], pa.binary())], names=["i", "m"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(m.as_buffer(), "<f8")
                held[i] = held[i] + x if i in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([packed(x) for x in held.values()], pa.binary())], names=["i", "m"])

    parts = blocks.select("n", *columns).mapInArrow(run, "i int, m binary")
    got = parts.repartition("i").mapInArrow(add, "i int, m binary").collect()
    if not got:
        raise ValueError("no rows")
    return np.stack([np.frombuffer(r.m, "<f8") for r in sorted(got, key=lambda r: r.i)])


def interleaved(x: str, y: str, bits: int = 24) -> Column:
    """The bits of two whole numbers from 0 in turn: a space-filling order of the plane."""
    at = lambda c: F.col(c).cast("long")
    spread = lambda c, up: [F.shiftleft(F.shiftright(at(c), b).bitwiseAND(1), 2 * b + up) for b in range(bits)]
    out = F.lit(0).cast("long")
    for bit in [*spread(x, 0), *spread(y, 1)]:
        out = out.bitwiseOR(bit)
    return out


class BlockedGraph:
    """A sparse matrix A, stored once as packs of the edges to a block of nodes, to be applied to blocks of rows again and again.

    Nodes are numbered in ``order`` (their id unless given); a space-filling order makes the edges of a block end in few blocks. A
    product sends each block to its packs, one unless it has more than ``PACK`` edges; what comes back is one partial sum a task and source row, so the
    rows of sums are no more than the edges, however many pairs of blocks these connect. An edge to a node that is not there is an error.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame, order: Column | None = None, rows: int = ROWS):
        ship(nodes.sparkSession)
        self.edges = settled(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")))
        self.rows = rows
        by = F.col("id") if order is None else order
        placed = numbered(nodes.withColumn("_by", by).select(F.col("id").cast("long").alias("id"), "_by"), [F.col("_by"), F.col("id")])
        self.nodes = settled(placed.select("id", F.floor(F.col("rn") / rows).cast("int").alias("block")))
        self.n = self.nodes.count()
        found = self.edges.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum(F.abs("w")), F.lit(0.0)).alias("s")).first()
        self.n_edges, self.total = found.m, found.s
        slot = self.nodes.select("id", (F.col("block").cast("long") * rows + F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1).alias("number"))
        end = lambda c, to: slot.select(F.col("id").alias(c), F.col("number").alias(to))
        self.packs = self._packs(self.edges.join(end("src", "i"), "src").join(end("dst", "j"), "dst").select("i", "j", "w"))
        self._turned: DataFrame | None = None
        if (self.packs.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]) != self.n_edges:
            ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
            lost = ends.join(self.nodes, "id", "left_anti").limit(3).collect()
            raise ValueError(f"edges to nodes that are not there: {', '.join(str(r.id) for r in lost)}")

    def _packs(self, entries: DataFrame) -> DataFrame:
        """Entries (i, j, w) by blocks of j: i, j inside the block, w, in order of i. A source block's edges to a block are in one pack."""
        rows = self.rows
        entries = entries.withColumn("block", F.floor(F.col("j") / rows).cast("int"))
        many = entries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("packs"))

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("i", "ascending"), ("j", "ascending")])
            i, j, w = (table[c].to_numpy() for c in "ijw")
            binary = lambda x, kind: pa.array([packed(x, kind)], pa.binary())
            return pa.table({"block": table["block"].slice(0, 1), "k": pa.array([len(i)], pa.int32()), "i": binary(i, "<i8"), "j": binary(j % rows, "<i4"), "w": binary(w, "<f8")})

        dealt = entries.join(many, "block").withColumn("_pack", F.pmod(F.xxhash64(F.floor(F.col("i") / rows)), F.col("packs")))
        return settled(dealt.select("block", "_pack", "i", "j", "w").groupBy("block", "_pack").applyInArrow(run, "block int, k int, i binary, j binary, w binary"))

    @property
    def turned(self) -> DataFrame:
        """The packs of A transposed."""
        if self._turned is None:
            rows = self.rows

            def run(batches):
                for row in each(batches):
                    i, j = np.frombuffer(row["i"], "<i8"), np.frombuffer(row["j"], "<i4") + np.int64(row["block"]) * rows
                    yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(i), pa.array(np.frombuffer(row["w"], "<f8"))], names=["i", "j", "w"])

            self._turned = self._packs(self.packs.mapInArrow(run, "i long, j long, w double"))
        return self._turned

    @property
    def cells(self) -> DataFrame:
        """Edges by (source block, target block): s, t, k (their number), a, b (places inside these), w."""
        rows = self.rows

        def run(batches):
            for row in each(batches):
                i, j, w = (np.frombuffer(row[c], kind) for c, kind in (("i", "<i8"), ("j", "<i4"), ("w", "<f8")))
                cut = np.flatnonzero(np.diff(i // rows, prepend=-1))
                parts = [slice(x, y) for x, y in zip(cut, [*cut[1:], len(i)], strict=True)]
                binary = lambda x, kind: pa.array([packed(x[p], kind) for p in parts], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(i[cut] // rows, pa.int32()), pa.array([row["block"]] * len(cut), pa.int32()), pa.array([p.stop - p.start for p in parts], pa.int32()), binary(i % rows, "<i4"), binary(j, "<i4"), binary(w, "<f8")], names=["s", "t", "k", "a", "b", "w"])

        return self.packs.mapInArrow(run, "s int, t int, k int, a binary, b binary, w binary")

    def pack(self, rows: DataFrame) -> DataFrame:
        """Blocks of (id, v), a row for each node."""
        return pack(rows.select("id", "v").join(self.nodes, "id"))

    def product(self, blocks: DataFrame, transpose: bool = False) -> DataFrame:
        """Adds ``lm``: L m with L = I / n + A / sum |A|, or with A transposed."""
        n, total, rows = self.n, self.total or 1.0, self.rows
        met = (self.turned if transpose else self.packs).join(blocks.select("block", "n", "m"), "block").select("i", "j", "w", "n", "m")

        def partial(batches):
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def give():
                number, x = (np.concatenate(part) for part in zip(*held, strict=True))
                by = np.argsort(number, kind="stable")
                first = np.flatnonzero(np.diff(number[by], prepend=-1))
                number, x = number[by][first], np.add.reduceat(x[by], first)
                cut = np.flatnonzero(np.diff(number // rows, prepend=-1))
                parts = [slice(i, j) for i, j in zip(cut, [*cut[1:], len(number)], strict=True)]
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(number[cut] // rows, pa.int32()), pa.array([False] * len(cut)), pa.array([p.stop - p.start for p in parts], pa.int32()), pa.array([packed(number[p] % rows, "<i4") for p in parts], pa.binary()), pa.array([packed(x[p]) for p in parts], pa.binary())], names=["block", "own", "n", "ids", "m"])

            for row in each(batches):
                m = floats(row["m"], row["n"])
                number, dst, w = np.frombuffer(row["i"], "<i8"), np.frombuffer(row["j"], "<i4"), np.frombuffer(row["w"], "<f8") / total
                step = max(1, HELD // (2 * 8 * max(1, m.shape[1])))
                for c in range(0, len(dst), step):
                    some = slice(c, c + step)
                    first = np.flatnonzero(np.diff(number[some], prepend=-1))
                    held.append((number[some][first], np.add.reduceat(w[some, None] * m[dst[some]], first)))
                    if sum(x.nbytes for _, x in held) > HELD:
                        yield give()
            if held:
                yield give()

        def added(batches):
            kept = None
            for row in each(batches):
                m = floats(row["m"], row["n"])
                if row["own"]:
                    if kept:
                        yield _one(*kept[:3], m=kept[3], lm=kept[4])
                    kept = row["block"], row["n"], row["ids"], m, m / n
                else:
                    kept[4][np.frombuffer(row["ids"], "<i4")] += m
            if kept:
                yield _one(*kept[:3], m=kept[3], lm=kept[4])

        parts = met.mapInArrow(partial, "block int, own boolean, n int, ids binary, m binary")
        every = blocks.select("block", F.lit(True).alias("own"), "n", "ids", "m").unionByName(parts)
        # A block comes before its partial sums, which are added as they come.
        return every.repartition("block").sortWithinPartitions("block", F.desc("own")).mapInArrow(added, SCHEMA + ", lm binary")
