"""A planar layout of vectors of any number: fuzzy neighbour memberships, a spectral start, and forces by vertex partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.operators import blocks, graph
from spectrel.operators.blocks import BlockedGraph
from spectrel.runtime import ship, written

#: Rows of a part, rows whose places every task may see, and times that parts meet.
PART, POOL, MEETINGS = 20_000, 5_000, 20
#: Of the start: rounds of so many products each.
TURNS, PRODUCTS = 3, 4


def curve(min_dist: float) -> tuple[float, float]:
    """a, b so that 1 / (1 + a x^2b) is near 1 below ``min_dist`` and near exp(min_dist - x) beyond: damped least squares."""
    x = np.linspace(0, 3, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist)))
    f = lambda p: 1 / (1 + p[0] * x ** (2 * p[1]))
    p, damp = np.array([1.0, 1.0]), 1e-2
    for _ in range(200):
        u = x ** (2 * p[1])
        slope = np.stack([-u, -p[0] * u * 2 * np.log(x)], 1) * (f(p) ** 2)[:, None]
        h = slope.T @ slope
        step = np.linalg.solve(h + damp * np.diag(np.diag(h)), slope.T @ (y - f(p)))
        better = (p + step > 0).all() and ((y - f(p + step)) ** 2).sum() < ((y - f(p)) ** 2).sum()
        p, damp = (p + step, damp / 3) if better else (p, damp * 4)
    return float(p[0]), float(p[1])


def memberships(near: DataFrame, k: int) -> DataFrame:
    """a, b, w with a < b of neighbours (src, dst, w): each row's memberships fall off from its nearest, to log2 k in all; both ways joined as p + q - p q."""
    lists = near.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("w", "dst"))).alias("e"))  # k - 1 neighbours a row at most

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            e = batch.column(1)
            size = np.diff(e.offsets.to_numpy())
            flat = e.flatten()
            on = np.arange(size.max())[None] < size[:, None]
            d = np.full(on.shape, np.inf)
            d[on] = flat.field("w").to_numpy()
            least = np.where(d > 0, d, np.inf).min(axis=1)
            gap = np.maximum(d - np.where(np.isfinite(least), least, 0)[:, None], 0)
            lo, hi = np.full(len(d), 1e-12), np.maximum(np.where(on, d, 0).max(axis=1), 1e-6) * 1e3
            for _ in range(80):
                mid = (lo + hi) / 2
                few = np.exp(-gap / mid[:, None]).sum(axis=1) < np.log2(k)
                lo, hi = np.where(few, mid, lo), np.where(few, hi, mid)
            floor = 1e-3 * np.where(on, d, 0).sum(axis=1) / size
            p = np.exp(-gap / np.maximum(np.maximum(hi, floor), 1e-12)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)), flat.field("dst"), pa.array(p[on])], names=["src", "dst", "p"])

    ways = lists.mapInArrow(run, "src long, dst long, p double")
    way = lambda on: F.coalesce(F.max(F.when(on, F.col("p"))), F.lit(0.0))
    both = ways.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(way(F.col("src") < F.col("dst")).alias("p"), way(F.col("src") > F.col("dst")).alias("q"))
    return both.select("a", "b", (F.col("p") + F.col("q") - F.col("p") * F.col("q")).alias("w"))


def spectral_start(both: DataFrame, ids: DataFrame, seed: int) -> DataFrame:
    """id, x, y: two smooth directions of the graph (src, dst, w, both ways), by power steps from hashed values, the constant one taken out; 10 at most."""
    degree = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    ids = written(ids.join(degree, "id", "left").select("id", F.greatest(F.coalesce("d", F.lit(0.0)), F.lit(1e-12)).alias("d")))
    root = lambda c: ids.select(F.col("id").alias(c), F.sqrt("d").alias(f"{c}_root"))
    scaled = both.join(root("src"), "src").join(root("dst"), "dst").select("src", "dst", (F.col("w") / F.col("src_root") / F.col("dst_root")).alias("w"))
    g = BlockedGraph(scaled, ids.select("id"))
    n, total = g.n, g.total or 1.0
    noise = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(20001)) / 10000 - 1).cast("double")
    at = written(g.pack(ids.select("id", F.array(F.sqrt("d"), noise(1), noise(2)).alias("v"))))
    for _ in range(TURNS):
        for _ in range(PRODUCTS):
            made = g.product(at)
            both_ = made.select("block", "n", "ids", F.col("m"), "lm")

            def step(batches):
                for batch in batches:
                    for row in batch.to_pylist():
                        m, lm = blocks.floats(row["m"], row["n"]), blocks.floats(row["lm"], row["n"])
                        # (1 + A) / 2, whose eigenvalues are not negative.
                        yield pa.RecordBatch.from_pylist([{"block": row["block"], "n": row["n"], "ids": row["ids"], "m": blocks.packed((m + (lm - m / n) * total) / 2)}], schema=pa.schema([("block", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("m", pa.binary())]))

            at = both_.mapInArrow(step, blocks.SCHEMA)
        at = written(at)
        inner = blocks.summed(at, ["m"], lambda m: m.T @ m)
        basis = np.linalg.inv(np.linalg.cholesky(inner + np.eye(3) * 1e-12 * max(np.trace(inner), 1e-300))).T  # upper: the constant direction first
        at = blocks.mapped(at, lambda m, basis=basis: m @ basis)
    rows = written(blocks.unpack(at).join(ids, "id").select("id", (F.get("v", F.lit(1)) / F.sqrt("d")).alias("x"), (F.get("v", F.lit(2)) / F.sqrt("d")).alias("y")))
    most = rows.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")))).first()[0] or 1.0
    return rows.select("id", (F.col("x") / most * 10 + noise(3) * 1e-4).alias("x"), (F.col("y") / most * 10 + noise(4) * 1e-4).alias("y"))


def forces(at: np.ndarray, i: np.ndarray, j: np.ndarray, often: np.ndarray, own: int, pool: np.ndarray, same: np.ndarray, a: float, b: float, epochs: range, whole: int, rng: np.random.Generator) -> np.ndarray:
    """Places after some epochs. The first ``own`` rows move; edges go from i to j, each in the share of epochs that ``often`` says. ``pool``: places that repel, ``same``: which own row one is, or -1."""
    for t in epochs:
        rate = 1 - t / whole
        on = np.floor((t + 1) * often) > np.floor(t * often)
        u, v = i[on], j[on]
        gap = at[u] - at[v]
        q = (gap**2).sum(axis=1)
        pull = np.where(q > 0, -2 * a * b * np.maximum(q, 1e-300) ** (b - 1) / (1 + a * q**b), 0)
        step = np.clip(pull[:, None] * gap, -4, 4)
        move = np.zeros((own, 2))
        inside = v < own
        np.add.at(move, u, step)
        np.add.at(move, v[inside], -step[inside])
        u = np.repeat(u, 5)
        drawn = rng.integers(0, len(pool), len(u))
        places = np.where((same[drawn] >= 0)[:, None], at[np.maximum(same[drawn], 0)], pool[drawn])
        gap = at[u] - places
        q = (gap**2).sum(axis=1)
        push = np.where(same[drawn] == u, 0, 2 * b / ((0.001 + q) * (1 + a * q**b)))
        np.add.at(move, u, np.clip(push[:, None] * gap, -4, 4))
        at = at.copy()
        at[:own] += rate * np.clip(move, -4, 4)
    return at


def planar_layout(vectors: DataFrame, k: int = 10, min_dist: float = 0.3, seed: int = 42, epochs: int = 500, part: int = PART) -> DataFrame:
    """id, x, y: a manifold layout of (id, v). Fuzzy memberships of the k nearest (itself among them), a spectral start, sampled forces.

    Rows are dealt into parts of about ``part`` by their place; a task moves the rows of its part for some epochs, while the others stay where they were;
    then all meet, ``MEETINGS`` times. One part goes through all epochs at once. Rows are repelled by ``POOL`` of all, drawn by a hash.
    Positions depend on the seed and have no meaning by themselves, only neighbourhoods do. Fewer than three rows lie at the origin.
    """
    spark = vectors.sparkSession
    ship(spark)
    ids = written(vectors.select(F.col("id").cast("long").alias("id")))
    n = ids.count()
    if n < 3:
        return ids.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    near = graph.knn_vectors(vectors, min(k, n)).where("src <> dst")
    pairs = written(memberships(near, min(k, n)))
    both = written(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w")))
    at, most = written(spectral_start(both, ids, seed)), pairs.agg(F.max("w")).first()[0] or 1.0
    edges = written(both.where(F.col("w") > most / epochs).withColumn("often", F.col("w") / most).drop("w"))
    (a, b), parts = curve(min_dist), -(-n // part)
    meetings = 1 if parts == 1 else MEETINGS
    for t in range(meetings):
        pool = at.orderBy(F.xxhash64("id"), "id").limit(POOL).collect()
        drawn = {r.id: i for i, r in enumerate(pool)}
        places = np.array([(r.x, r.y) for r in pool])
        now = range(epochs * t // meetings, epochs * (t + 1) // meetings)
        along_axis = "xy"[t % 2]  # so that no border stays where it is
        cuts = at.agg(F.percentile_approx(along_axis, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
        number = sum((F.when(F.col(along_axis) > c, 1).otherwise(0) for c in cuts), F.lit(0))
        dealt = at.withColumn("part", number)
        ends = at.select(F.col("id").alias("dst"), F.col("x").alias("ex"), F.col("y").alias("ey"))
        along = edges.join(dealt.select(F.col("id").alias("src"), "part"), "src").join(ends, "dst")
        along = along.select(*[F.col(c).alias(c) for c in ("part", "src", "dst", "often", "ex", "ey")])  # columns of its own

        def run(left: pa.Table, right: pa.Table) -> pa.Table:  # it is sent within the round
            own = np.sort(left["id"].to_numpy())
            by = np.argsort(left["id"].to_numpy())
            here = np.column_stack([left["x"].to_numpy(), left["y"].to_numpy()])[by]
            right = right.sort_by([("src", "ascending"), ("dst", "ascending")])
            src, dst = right["src"].to_numpy(), right["dst"].to_numpy()
            j = np.searchsorted(own, dst)
            out = (j == len(own)) | (own[np.minimum(j, len(own) - 1)] != dst)
            far, first, inverse = np.unique(dst[out], return_index=True, return_inverse=True)
            j[out] = len(own) + inverse
            there = np.column_stack([right["ex"].to_numpy()[out][first], right["ey"].to_numpy()[out][first]]).reshape(-1, 2)
            same = np.full(len(places), -1)
            for i, u in enumerate(own.tolist()):
                if u in drawn:
                    same[drawn[u]] = i
            rng = np.random.default_rng([seed, t, int(left["part"][0].as_py())])
            made = forces(np.vstack([here, there]), np.searchsorted(own, src), j, right["often"].to_numpy(), len(own), places, same, a, b, now, epochs, rng)[: len(own)]
            return pa.table({"id": own, "x": made[:, 0], "y": made[:, 1]})

        at = written(dealt.groupBy("part").cogroup(along.groupBy("part")).applyInArrow(run, "id long, x double, y double"))
    return at
