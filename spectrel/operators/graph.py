"""Neighbour graphs as edge tables, and products with them. No n-by-n matrix is made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrel.operators import blocks
from spectrel.runtime import settled, ship

#: Cells are halved, so often at most, while one has more than so many times the neighbours that are wanted.
HALVINGS, CROWD = 24, 8
#: Cells along a tile, points that one task asks for, and pairs of points that it measures at once.
TILE, ASKED, PAIRS = 16, 20_000, 1 << 20


def _near(table: pa.Table, k: int, with_self: bool, side: float, x0: float, y0: float, all_: bool) -> pa.Table:
    """src, dst, w of a tile's points that ask, among all it was given: those with k neighbours nearer than ``side``, or all of them."""
    ids, x, y, gives, asks = (table[c].to_numpy(zero_copy_only=False) for c in ("id", "x", "y", "gives", "asks"))
    cells = lambda on: (np.floor((y[on] - y0) / side).astype(np.int64), np.floor((x[on] - x0) / side).astype(np.int64))
    to, of = np.flatnonzero(gives), np.flatnonzero(asks)
    if not len(to) or not len(of):
        return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "w": pa.array([], pa.float64())})
    (ty, tx), (oy, ox) = cells(to), cells(of)
    low = min(tx.min(), ox.min()) - 1
    wide, base = max(tx.max(), ox.max()) - low + 2, min(ty.min(), oy.min()) - 1
    key = (ty - base) * wide + tx - low
    by = np.argsort(key, kind="stable")
    key, to = key[by], to[by]
    mid = (oy - base) * wide + ox - low
    lo = np.stack([np.searchsorted(key, mid + d * wide - 1) for d in (-1, 0, 1)], axis=1)  # three runs of three cells
    many = np.stack([np.searchsorted(key, mid + d * wide + 1, side="right") for d in (-1, 0, 1)], axis=1) - lo
    ends = np.cumsum(many.sum(axis=1))
    out, start = [], 0
    while start < len(of):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
        size = many[start:stop].ravel()
        at = np.repeat(lo[start:stop].ravel() - np.cumsum(size) + size, size) + np.arange(size.sum())
        src, dst = np.repeat(of[start:stop], many[start:stop].sum(axis=1)), to[at]
        dx, dy = x[src] - x[dst], y[src] - y[dst]
        w = np.sqrt(dx * dx + dy * dy)
        on = np.ones(len(w), bool) if all_ else w < side
        if not with_self:
            on &= ids[src] != ids[dst]
        src, dst, w = src[on], ids[dst[on]], w[on]
        order = np.lexsort((dst, w, src))
        src, dst, w = src[order], dst[order], w[order]
        first = np.flatnonzero(np.diff(src, prepend=-1))
        found = np.diff(np.append(first, len(src)))
        rank = np.arange(len(src)) - np.repeat(first, found)
        kept = (rank < k) & (True if all_ else np.repeat(found >= k, found))
        out.append((ids[src[kept]], dst[kept], w[kept]))
        start = stop
    src, dst, w = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "w": pa.array(w, pa.float64())})


def knn(points: DataFrame, k: int, with_self: bool = True) -> DataFrame:
    """src, dst, w: the k nearest points in the plane (id, x, y), ties by id. Exact.

    Points fall into square cells so small that none has many, and cells into tiles. A task takes a tile with the cells around it; a point is done
    when it has k neighbours nearer than a cell's side, which the cells around its own surely cover. The others, in sparse parts, try again
    with cells twice as wide. So a dense spot is searched in small cells, whatever the rest looks like. Of points at one place only the
    k + 1 of least id are met, as no list can have more of them, and a tile with many points to ask for is dealt to several tasks.
    """
    ship(points.sparkSession)
    at = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    place = Window.partitionBy("x", "y").orderBy("id")
    gives = at.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k + 1).drop("_r")
    at, gives = settled(at), settled(gives)
    box = at.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not box.n:
        return points.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w")).limit(0)
    x0, y0, span = box.x0, box.y0, max(box.x1 - box.x0, box.y1 - box.y0) or 1.0
    wanted = k if with_self else k + 1
    cell = lambda c, least, side: F.floor((F.col(c) - least) / side).cast("long")
    placed = lambda df, side: df.withColumn("cx", cell("x", x0, side)).withColumn("cy", cell("y", y0, side))
    side = span / max(1.0, (box.n / wanted) ** 0.5)
    fullest = box.n + 1
    for _ in range(HALVINGS):
        now = placed(gives, side).groupBy("cx", "cy").count().agg(F.max("count")).first()[0]
        if now <= CROWD * wanted or now >= fullest:  # few enough, or points that no side tells apart
            break
        fullest, side = now, side / 2
    tile = lambda c, o=0: F.floor((F.col(c) + o) / TILE).cast("long")
    tiles = lambda c: F.explode(F.array_distinct(F.array(*[tile(c, o) for o in (-1, 0, 1)])))
    todo, done = at, None
    while True:
        last = side > span  # all points lie in two by two cells
        asked = placed(todo, side)
        there = placed(gives, side)
        if done is not None:  # few ask: only what is around them
            around = F.explode(F.array(*[F.lit(o).cast("long") for o in (-1, 0, 1)]))
            beside = asked.select("cx", "cy").distinct().withColumn("ox", around).withColumn("oy", around)
            there = there.join(beside.select((F.col("cx") + F.col("ox")).alias("cx"), (F.col("cy") + F.col("oy")).alias("cy")).distinct(), ["cx", "cy"], "left_semi")
        asked = asked.select("id", "x", "y", tile("cx").alias("tx"), tile("cy").alias("ty"))
        shares = settled(asked.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("shares")))
        asked = asked.join(shares, ["tx", "ty"]).select("tx", "ty", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), "id", "x", "y", F.lit(False).alias("gives"), F.lit(True).alias("asks"))
        there = there.select("id", "x", "y", tiles("cx").alias("tx"), "cy").select("id", "x", "y", "tx", tiles("cy").alias("ty")).join(shares, ["tx", "ty"])
        there = there.select("tx", "ty", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "id", "x", "y", F.lit(True).alias("gives"), F.lit(False).alias("asks"))

        def run(table: pa.Table) -> pa.Table:  # it is sent within the round
            return _near(table, k, with_self, side, x0, y0, last)

        found = settled(asked.unionByName(there).groupBy("tx", "ty", "share").applyInArrow(run, "src long, dst long, w double"))
        done = found if done is None else done.unionByName(found)
        if last:
            return done
        todo = settled(todo.join(found.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
        if todo.isEmpty():
            return done
        side *= 2


def check_nodes(edges: DataFrame, nodes: DataFrame) -> None:
    """An error if an edge names a node (id) that is not there, so that the matrix would not be square."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    if lost := ends.join(nodes.select("id"), "id", "left_anti").limit(3).collect():
        raise ValueError(f"edges to nodes that are not there: {', '.join(str(r.id) for r in lost)}")


#: Rows of a block of vectors, pivots at most, rows of the blocks that a task searches together, and candidates whose distance it takes at once.
VECTOR_ROWS, PIVOTS, GROUP, AT_ONCE = 1024, 256, 1 << 17, 1 << 16


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=x.copy(), where=norm > 0)


def _apart(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of vectors that stand opposite each other, by their differences."""
    if metric == "cosine":
        return 1 - (a * b).sum(axis=-1)
    d = a - b
    return np.sqrt((d * d).sum(axis=-1))


class _Nearest:
    """The k nearest of each row of a block among the blocks it has met: by distance to nine digits, then id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, metric: str):
        self.ids, self.x, self.k, self.metric = ids, x, k, metric
        self.w, self.dst = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
        self.squares = (x * x).sum(axis=1)

    def reach(self) -> float:
        """No vector farther than this from a row of the block can be among the k nearest of one."""
        return float(self.w[:, -1].max()) + 2e-9

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        """Rows of one block that was not met before. A product of matrices tells which may be near enough, as equal vectors can be at the
        last place, too; only these get their distance from differences."""
        squares = (y * y).sum(axis=1)
        rough = self.x @ y.T
        rough *= -1 if self.metric == "cosine" else -2
        if self.metric == "cosine":
            rough[self.ids[:, None] == ids] = np.inf
        else:
            rough += squares
        slack = 1e-8 * (1 + self.squares + squares.max())
        cut = (self.w[:, -1] - 1 if self.metric == "cosine" else self.w[:, -1] ** 2 - self.squares) + slack
        if self.k < len(ids) and (few := np.flatnonzero(np.isinf(cut))).size:
            cut[few] = np.partition(rough[few], self.k - 1, axis=1)[:, self.k - 1] + 2 * slack[few]
        row, at = np.nonzero(rough <= cut[:, None])
        for i in range(0, len(row), AT_ONCE):
            self._take(row[i : i + AT_ONCE], ids, y, at[i : i + AT_ONCE])

    def _take(self, row: np.ndarray, ids: np.ndarray, y: np.ndarray, at: np.ndarray) -> None:
        w, dst = _apart(self.x[row], y[at], self.metric), ids[at]
        if self.metric == "cosine":
            other = dst != self.ids[row]
            row, w, dst = row[other], w[other], dst[other]
        rows = np.unique(row)
        row, w, dst = np.concatenate([np.repeat(rows, self.k), row]), np.concatenate([self.w[rows].ravel(), w]), np.concatenate([self.dst[rows].ravel(), dst])
        by = np.lexsort((dst, np.round(w, 9), row))
        row, w, dst = row[by], w[by], dst[by]
        first = np.searchsorted(row, rows)[:, None] + np.arange(self.k)
        self.w[rows], self.dst[rows] = w[first], dst[first]


def _targets(ids: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that are equal only the k + 1 of least id, as no list of k neighbours can have more of them. ``ids`` ascend."""
    same = np.unique(np.ascontiguousarray(y + 0.0).view(f"V{8 * y.shape[1]}").ravel(), return_inverse=True)[1] if y.size else np.arange(len(y))
    by = np.argsort(same, kind="stable")
    rank = np.arange(len(by)) - np.searchsorted(same[by], same[by])
    kept = np.sort(by[rank <= k])
    return (ids, y) if len(kept) == len(ids) else (ids[kept], y[kept])


def vector_blocks(vectors: DataFrame, k: int, metric: str, rows: int = VECTOR_ROWS) -> DataFrame:
    """Blocks of vectors (unit vectors for cosine) that lie together, with their centre, radius and reach: the largest distance of a row
    to its k-th nearest inside the block, in Euclidean terms.

    Vectors go to the nearest of ``PIVOTS`` of them at most, drawn by a hash; a pivot with more than ``rows`` deals its vectors by a hash.
    """
    ship(vectors.sparkSession)
    v = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    n = v.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    size = max(1, min(rows, max(128, -(-n // cores))))
    drawn = v.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, -(-n // size)))).collect()
    pivots = np.array([r.v for r in drawn], float) if drawn else np.zeros((1, 1))
    pivots = _unit(pivots) if metric == "cosine" else pivots

    def assign(batches):
        for batch in batches:
            if len(batch):
                x = blocks.vectors_of(batch.column(1), len(batch))
                x = _unit(x) if metric == "cosine" else x
                at = ((pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=["pivot", "id", "v"])

    dealt = settled(v.mapInArrow(assign, "pivot int, id long, v array<double>"))
    counts = {r.pivot: -(-r["count"] // size) for r in dealt.groupBy("pivot").count().collect()}  # PIVOTS rows at most
    first = dict(zip(counts, np.cumsum([0, *counts.values()]).tolist(), strict=False))
    parts = F.create_map(*[F.lit(x) for p, c in counts.items() for x in (p, c)]) if counts else F.create_map(F.lit(0), F.lit(1))
    start = F.create_map(*[F.lit(x) for p, c in first.items() for x in (p, c)]) if counts else F.create_map(F.lit(0), F.lit(0))
    block = start[F.col("pivot")] + F.pmod(F.xxhash64("id"), parts[F.col("pivot")]).cast("int")
    made = blocks.pack(dealt.select(block.alias("block"), "id", "v"))

    def measured(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, ids = blocks.floats(row["m"], row["n"]), np.frombuffer(row["ids"], "<i8")
                own = _Nearest(ids, x, k, metric)
                own.meet(ids, x)
                centre, reach = x.mean(axis=0), own.reach()
                radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
                more = {"centre": centre.tolist(), "radius": radius, "reach": float(np.sqrt(2 * reach)) if metric == "cosine" else reach}
                yield pa.RecordBatch.from_pylist([row | more], schema=pa.schema([*batch.schema, ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("reach", pa.float64())]))

    return settled(made.mapInArrow(measured, blocks.SCHEMA + ", centre array<double>, radius double, reach double"))


def block_pairs(made: DataFrame) -> DataFrame:
    """a, b, least: the pairs of blocks that may hold neighbours of a's rows in b, with the least distance that their centres and radii allow.
    A pair stands for a product of two matrices of a block's rows, so pairs are few beside the work they stand for."""
    side = lambda c: made.select(F.col("block").alias(c), F.col("centre").alias(f"{c}_centre"), F.col("radius").alias(f"{c}_radius"), F.col("reach").alias(f"{c}_reach"))
    gap = F.sqrt(F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    least = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.greatest(F.lit(0.0), gap - F.col("a_radius") - F.col("b_radius") - 1e-9 * (1 + gap)))
    return side("a").crossJoin(side("b")).withColumn("least", least).where(F.col("least") <= F.col("a_reach")).select("a", "b", "least")


def dealt(made: DataFrame, groups: int, many: int) -> DataFrame:
    """group, least, and a block that the group's blocks, of ``many`` in all, may have neighbours in; its own have -1. A block goes to a group once at most."""
    group = lambda c: F.floor(F.col(c).cast("long") * groups / max(many, 1)).cast("int")
    pairs = block_pairs(made).groupBy(group("a").alias("group"), "b").agg(F.min("least").alias("least"))
    asked = pairs.withColumn("least", F.when(group("b") == F.col("group"), -1.0).otherwise(F.col("least")))
    return asked.join(made.withColumnRenamed("block", "b"), "b").select("group", "least", "b", "n", "ids", "m", "centre", "radius")


def knn_vectors(vectors: DataFrame, k: int, metric: str = "euclid", rows: int = VECTOR_ROWS) -> DataFrame:
    """src, dst, w of (id, v): exact k nearest by Euclidean (itself included) or cosine distance (itself not), ties by id.

    Vectors are packed into blocks. A task holds a group of blocks with the k best of each row, and other blocks come by one by one, nearest first,
    each once; it meets those of the group's blocks for which centres and radii don't tell that nothing in it can be near enough. There are two
    groups a core, more only beyond ``GROUP`` rows each, so the bytes that are shuffled grow with the table and not with its square. The
    result is settled, so that it is made once. Vectors of unequal lengths are an error; a zero vector has cosine distance 1 to all.
    """
    made = vector_blocks(vectors, k, metric, rows)
    many, n = made.agg(F.coalesce(F.max("block"), F.lit(-1)) + 1, F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(1, min(many, max(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-n // GROUP))))
    met = dealt(made, groups, many)
    met = met.repartitionById(groups, "group").sortWithinPartitions("group", "least", "b")

    def run(batches):
        own, centres, radii = [], [], []

        def near(centre: np.ndarray, radius: float) -> Iterator[_Nearest]:
            gap = np.sqrt(((np.array(centres) - centre) ** 2).sum(axis=1))
            least = np.maximum(gap - np.array(radii) - radius - 1e-9 * (1 + gap), 0)
            return (best for best, x in zip(own, least.tolist(), strict=True) if (x * x / 2 if metric == "cosine" else x) <= best.reach())

        for row in blocks.each(batches):
            ids, x = np.frombuffer(row["ids"], "<i8"), blocks.floats(row["m"], row["n"])
            centre, radius = np.array(row["centre"]), row["radius"]
            to = _targets(ids, x, k)
            if row["least"] < 0:  # the group's blocks come first; each meets itself, then those before it meet it, and it meets them
                mine = _Nearest(ids.copy(), x.copy(), k, metric)
                mine.meet(*to)
                for other in near(centre, radius) if own else ():
                    other.meet(*to)
                for other in own:
                    mine.meet(*_targets(other.ids, other.x, k))
                own.append(mine)
                centres.append(centre)
                radii.append(radius)
            else:
                for best in near(centre, radius):
                    best.meet(*to)
        for best in own:
            src, on = np.repeat(best.ids, k), np.isfinite(best.w).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(src[on]), pa.array(best.dst.ravel()[on]), pa.array(best.w.ravel()[on])], names=["src", "dst", "w"])

    return settled(met.mapInArrow(run, "src long, dst long, w double"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Weight 1 wherever an edge goes either way; no loops."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct().withColumn("w", F.lit(1.0))


def undirected(edges: DataFrame) -> DataFrame:
    """Parallel edges added up."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))


def matvec(edges: DataFrame, values: DataFrame) -> DataFrame:
    """id, y = A x for values (id, x)."""
    moved = edges.join(values, edges["dst"] == values["id"]).groupBy("src").agg(F.sum(F.col("w") * F.col("x")).alias("y"))
    return values.select("id").join(moved.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("y", F.lit(0.0)).alias("y"))


def quadratic_form(edges: DataFrame, values: DataFrame) -> DataFrame:
    """One row, q = x' L x with L = I / n + A / sum |A|."""
    s = edges.agg(F.sum(F.abs("w")).alias("s"))
    xx = values.agg((F.sum(F.col("x") * F.col("x")) / F.count(F.lit(1))).alias("xx"))
    other = values.select(F.col("id").alias("src"), F.col("x").alias("x1"))
    xax = edges.join(values, edges["dst"] == values["id"]).join(other, "src").agg(F.sum(F.col("w") * F.col("x") * F.col("x1")).alias("xax"))
    return xx.crossJoin(xax).crossJoin(s).select((F.col("xx") + F.coalesce(F.col("xax") / F.col("s"), F.lit(0.0))).alias("q"))  # one row each
