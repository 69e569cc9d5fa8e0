"""Spatially structured components without n-by-n matrices: rows stay distributed; the driver makes matrices of the kept directions.

``rows``: (id, v) with v an array of p numbers; ``edges``: (src, dst, w). L = I / n + A / sum |A| is only ever applied.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrel.functions.imhof import imhof_cdf
from spectrel.functions.student import t_quantile
from spectrel.operators import blocks
from spectrel.operators.blocks import BlockedGraph
from spectrel.runtime import settled, ship

#: Up to so many columns their products with each other are gathered (32 MB); beyond, only products with a few columns at a time.
WIDE = 2048
#: Of the size of an eigenvalue of the permutation null.
NULL_TOLERANCE = 1e-7


def permuted(k: np.ndarray, n: int, *key: int, inverse: bool = False) -> np.ndarray:
    """A keyed bijection of 0 to n - 1 applied to ``k``, or its inverse: a Feistel network on the next power of four, walked until inside.

    Any task can permute any row by itself, so no replicate needs a shuffle or a table of n numbers.
    """
    half = np.uint64((max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.random.default_rng(list(key)).integers(0, 2**63, 8, dtype=np.uint64)

    def mix(x: np.ndarray, salt: np.uint64) -> np.ndarray:
        x = (x + salt) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(31)) & mask

    out = np.asarray(k).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for salt in keys[::-1] if inverse else keys:
            left, right = (right ^ mix(left, salt), left) if inverse else (right, left ^ mix(right, salt))
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def largest(apply: Callable[[np.ndarray], np.ndarray], r: int, count: int, seed: int, tol: float = NULL_TOLERANCE) -> np.ndarray:
    """The largest real part of the eigenvalues of ``count`` r-by-r matrices, which ``apply`` multiplies with the columns of an r-by-count matrix.

    Arnoldi's process from a drawn start, all matrices in step, with full orthogonalisation. A matrix is done when the residual of the Ritz pair
    and its change since the step before are within ``tol`` of its size; after r steps it is exact.
    """
    rng = np.random.default_rng([seed, r, count])
    basis = np.zeros((r + 1, r, count))
    basis[0] = rng.normal(size=(r, count))
    basis[0] /= np.sqrt((basis[0] ** 2).sum(axis=0))
    h = np.zeros((count, r + 1, r))
    value, done = np.full(count, np.inf), np.zeros(count, bool)
    for m in range(r):
        new = apply(basis[m])
        size = np.sqrt((new**2).sum(axis=0))
        for _ in range(2):  # twice is enough
            for j in range(m + 1):
                part = (basis[j] * new).sum(axis=0)
                h[:, j, m] += part
                new = new - basis[j] * part
        norm = np.sqrt((new**2).sum(axis=0))
        h[:, m + 1, m] = norm
        basis[m + 1] = np.divide(new, norm, out=np.zeros_like(new), where=norm > 1e-14 * np.maximum(size, 1e-300))
        for i in np.flatnonzero(~done):
            found, vectors = np.linalg.eig(h[i, : m + 1, : m + 1])
            top = int(found.real.argmax())
            old, value[i] = value[i], found[top].real
            near = tol * max(abs(found[top]), 1e-300)
            done[i] = norm[i] <= 1e-14 * max(size[i], 1e-300) or m + 1 >= min(r, 8) and norm[i] * abs(vectors[-1, top]) <= near and abs(value[i] - old) <= near
        if done.all():
            break
    return value


def leading(apply: Callable[[np.ndarray], np.ndarray], p: int, trace: float, keep: float, block: int = 32, tol: float = 1e-10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, as many as have the share ``keep`` of the trace, and their vectors, of a p-by-p matrix that has no negative ones.

    ``apply`` multiplies it with a few columns; the matrix itself is never made. Block Lanczos with full orthogonalisation, until the pairs that are
    asked for have residuals within ``tol`` of the largest value, or the space is exhausted, where they are exact. Held: twice p times the
    size of the space, which is a little more than the number of pairs.
    """
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((p, 0)), np.zeros((p, 0))
    new = np.linalg.qr(rng.normal(size=(p, min(block, p))))[0]
    while True:
        basis, images = np.hstack([basis, new]), np.hstack([images, apply(new)])
        h = basis.T @ images
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        rest = images[:, -new.shape[1] :]
        for _ in range(2):  # twice is enough
            rest = rest - basis @ (basis.T @ rest)
        u, size, _ = np.linalg.svd(rest, full_matrices=False)
        new = u[:, size > 1e-13 * max(values[0], 1e-300)][:, : p - basis.shape[1]]
        share = np.cumsum(values) / trace
        r = int(np.searchsorted(share, keep)) + 1
        if r <= len(values) and new.shape[1]:
            pairs = vectors[:, :r]
            off = np.sqrt(((images @ pairs - basis @ pairs * values[:r]) ** 2).sum(axis=0))
            if (off <= tol * values[0]).all():
                return values[:r], basis @ pairs
        if not new.shape[1]:
            r = min(r, len(values))
            return values[:r], basis @ vectors[:, :r]


def apply_l(rows: DataFrame, edges: DataFrame | BlockedGraph) -> DataFrame:
    """(id, v, lv): each row with its row of L V, by one product of blocks."""
    graph = edges if isinstance(edges, BlockedGraph) else BlockedGraph(edges, rows.select("id"))
    return blocks.unpack(graph.product(graph.pack(rows)), v="m", lv="lm")


class Spaco:
    """Whitening, spectral filter, projection and test. ``keep`` is the share of variance, ``cut`` the smallest eigenvalue.

    Edges are stored once as packs of a blocked graph and rows as blocks; ``order`` places nodes whose edges are near each other in one block.
    """

    def __init__(self, rows: DataFrame, edges: DataFrame, keep: float = 0.95, cut: float | None = None, order: Column | None = None):
        ship(rows.sparkSession)
        self._back = None
        self.graph = BlockedGraph(edges, rows, order)
        self.edges, self.n = self.graph.edges, self.graph.n
        given = settled(self.graph.pack(rows))
        ones = lambda m: m.sum(axis=0)[None]
        mean = blocks.summed(given, ["m"], ones)[0] / self.n
        deviation = np.sqrt(blocks.summed(given, ["m"], lambda m: ((m - mean) ** 2).sum(axis=0)[None])[0] / self.n)
        # What a constant column's mean lacks in precision is no deviation.
        self.columns = np.flatnonzero(deviation > 1e-14 * np.abs(mean))
        if not len(self.columns):
            raise ValueError("no column varies")
        columns, mean, deviation = self.columns, mean[self.columns], deviation[self.columns]
        self.packed = blocks.mapped(given, lambda m: (m[:, columns] - mean) / deviation)
        self.features = blocks.unpack(self.packed)
        if len(columns) <= WIDE:
            values, vectors = np.linalg.eigh(blocks.summed(self.packed, ["m"], lambda m: m.T @ m) / (self.n - 1))
            values, vectors = values[::-1], vectors[:, ::-1]
            r = int(np.searchsorted(np.cumsum(values) / values.sum(), keep)) + 1
            values, vectors = values[:r], vectors[:, :r]
        else:
            trace = len(columns) * self.n / (self.n - 1)  # of standardised columns
            values, vectors = leading(lambda q: blocks.summed(self.packed, ["m"], lambda m: m.T @ (m @ q)) / (self.n - 1), len(columns), trace, keep)
        self.whitener = whitener = vectors / np.sqrt(values)
        self.white_packed = settled(self.graph.product(blocks.mapped(self.packed, lambda m: m @ whitener)))
        self.white = blocks.unpack(self.white_packed, v="m", lv="lm")
        self.form = blocks.summed(self.white_packed, ["m", "lm"], lambda a, b: a.T @ b)
        lam, self.all_vectors = np.linalg.eigh(self.form)
        self.all_values, self.all_vectors = lam[::-1], self.all_vectors[:, ::-1]
        self.set_cut(float(np.median(self.all_values)) if cut is None else cut)

    def set_cut(self, cut: float) -> None:
        k = int((self.all_values >= cut).sum())
        self.values, self.loadings = self.all_values[:k], self.all_vectors[:, :k] / np.sqrt(np.maximum(self.all_values[:k], 1e-300))

    def null_values(self, replicates: int, seed: int = 0, max_bytes: int = 256 << 20, block: int = 50) -> np.ndarray:
        """Largest eigenvalues after the rows of the whitened table are permuted, to ``NULL_TOLERANCE`` of their size.

        They take products of the permuted forms with vectors alone, no form is made. Table and edges are sent to the tasks if both fit in
        ``max_bytes`` (on the driver they are held packed and once as arrays). Beyond that nothing is gathered: the vectors of ``block`` replicates go through the table and the graph
        together, their entries dealt to where the permutation of each replicate puts them. The permutations, and so the values, are the same either way.
        """
        r, m = self.whitener.shape[1], self.graph.n_edges
        if 8 * (self.n * r + 3 * m) <= max_bytes:
            return self._null_sent(replicates, seed)
        return np.sort(np.concatenate([self._null_dealt(range(i, min(i + block, replicates)), seed) for i in range(0, replicates, block)]))

    def _null_sent(self, replicates: int, seed: int) -> np.ndarray:
        # Packed rows: a block or a pack each, so nothing larger than the numbers themselves is made of them.
        got = sorted(self.white_packed.select("block", "n", "m").collect(), key=lambda r: r.block)
        w = np.concatenate([blocks.floats(r.m, r.n) for r in got])
        rows, packs = self.graph.rows, self.graph.packs.collect()
        joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        a, b = joined([np.frombuffer(p.i, "<i8") for p in packs], np.int64), joined([np.int64(p.block) * rows + np.frombuffer(p.j, "<i4") for p in packs], np.int64)
        x = joined([np.frombuffer(p.w, "<f8") for p in packs], float) / (self.graph.total or 1.0)
        n, spark = self.n, self.white.sparkSession
        sent = spark.sparkContext.broadcast((w, a, b, x))

        def run(batches):
            import pandas as pd

            w, a, b, x = sent.value
            for pdf in batches:
                out = []
                for i in pdf["id"]:
                    at = permuted(np.arange(n), n, seed, int(i))

                    def apply(z):
                        u = (w @ z[:, 0])[at]
                        y = np.zeros(n)
                        y[at] = u / n + np.bincount(a, x * u[b], n)
                        return (w.T @ y)[:, None]

                    out.append(float(largest(apply, w.shape[1], 1, seed)[0]))
                yield pd.DataFrame({"value": out})

        return np.array(sorted(row.value for row in spark.range(replicates).mapInPandas(run, "value double").collect()))

    def _moved(self, given: DataFrame, numbers: range, seed: int, inverse: bool) -> DataFrame:
        """Blocks of one column a replicate, each entry where the replicate's permutation, or its inverse, puts its row."""
        n, rows, first = self.n, self.graph.rows, numbers.start

        def deal(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    m = blocks.floats(row["m"], row["n"])
                    own = row["block"] * rows + np.arange(row["n"])
                    to = np.stack([permuted(own, n, seed, k, inverse=inverse) for k in numbers], axis=1)
                    by = np.argsort(to // rows, axis=None, kind="stable")
                    flat, k, value = to.ravel()[by], np.broadcast_to(np.arange(len(numbers)), to.shape).ravel()[by], m.ravel()[by]
                    cut = np.flatnonzero(np.diff(flat // rows, prepend=-1))
                    for i, j in zip(cut, np.append(cut[1:], len(flat)), strict=True):
                        yield pa.RecordBatch.from_pylist([{"block": int(flat[i] // rows), "at": blocks.packed(flat[i:j] % rows, "<i4"), "k": blocks.packed(k[i:j], "<i4"), "m": blocks.packed(value[i:j])}], schema=pa.schema([("block", pa.int32()), ("at", pa.binary()), ("k", pa.binary()), ("m", pa.binary())]))

        def gather(batches):
            held = None
            for batch in batches:
                for row in batch.to_pylist():
                    if held is None or held[0] != row["block"]:
                        if held:
                            yield done(*held)
                        held = row["block"], np.zeros((min(rows, n - row["block"] * rows), len(numbers)))
                    held[1][np.frombuffer(row["at"], "<i4"), np.frombuffer(row["k"], "<i4")] = np.frombuffer(row["m"], "<f8")
            if held:
                yield done(*held)

        def done(block: int, m: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"block": block, "n": len(m), "ids": b"", "m": blocks.packed(m)}], schema=pa.schema([("block", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("m", pa.binary())]))

        dealt = given.select("block", "n", "m").mapInArrow(deal, "block int, at binary, k binary, m binary")
        return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(gather, blocks.SCHEMA)

    def _null_dealt(self, numbers: range, seed: int) -> np.ndarray:
        white = self.white_packed.select("block", "n", "ids", "m")

        def apply(z: np.ndarray) -> np.ndarray:
            at_nodes = self._moved(blocks.mapped(white, lambda m: m @ z), numbers, seed, inverse=True)
            product = self.graph.product(at_nodes).select("block", "n", F.col("lm").alias("m"))
            back = self._moved(product, numbers, seed, inverse=False).select("block", F.col("m").alias("y"))
            return blocks.summed(white.join(back, "block"), ["m", "y"], lambda m, y: m.T @ y)

        return largest(apply, self.whitener.shape[1], len(numbers), seed)

    def adaptive_cut(self, batch: int = 50, replicates: int = 100, rounds: int = 1000, seed: int = 0) -> float:
        """The cut from a confidence interval of the null's mean; batches are added while more than one eigenvalue lies in it."""
        found = self.null_values(replicates, seed)
        for k in range(rounds + 1):
            half = t_quantile(0.975, len(found) - 1) * found.std() / np.sqrt(len(found))
            lo, hi = found.mean() - half, found.mean() + half
            inside = self.all_values[(self.all_values >= lo) & (self.all_values <= hi)]
            if len(inside) < 2:
                return float(inside[0]) if len(inside) else float(hi)
            if k < rounds:
                found = np.concatenate([found, self.null_values(batch, seed + k + 1)])
        return float(hi)

    def projection(self) -> DataFrame:
        """(id, v): the component scores V_k."""
        return self.project(self.loadings)

    def project(self, m: np.ndarray) -> DataFrame:
        """(id, v): the whitened rows times m."""
        return blocks.unpack(blocks.mapped(self.white_packed, lambda x: x @ m))

    def against(self, product: DataFrame) -> np.ndarray:
        """W' L X of the whitened rows W, for blocks with their product (lm)."""
        both = self.white_packed.select("block", "n", F.col("m").alias("w")).join(product.select("block", "lm"), "block")
        return blocks.summed(both, ["w", "lm"], lambda a, b: a.T @ b)

    def projected(self) -> DataFrame:
        """(id, v): the standardised columns that vary, projected onto the components: V_k (V_k' (L F)), by one k-by-p matrix."""
        return self.project(self.loadings @ self.loadings.T @ self.against(self.graph.product(self.packed)))

    def orthonormal(self, tol: float = float(np.sqrt(np.finfo(float).eps))) -> np.ndarray:
        """Loadings whose scores are L-orthonormal: Gram-Schmidt over the kept components in their order, from their L-Gram alone.

        Near-null components are skipped; none left, or a negative form (no norm), is an error. The scores V_k are L-orthonormal
        already if the edges are symmetric, but not if they are directed.
        """
        g = self.loadings.T @ self.form @ self.loadings
        basis: list[np.ndarray] = []
        for v in np.eye(len(g)):
            for q in basis:
                v = v - (q @ g @ v) * q
            square = float(v @ g @ v)
            if square < -(tol**2):
                raise ValueError("a component has a negative form under L, so it has no L-norm")
            if square >= tol**2:
                basis.append(v / np.sqrt(square))
        if not basis:
            raise ValueError("all components are null or near-null under L")
        return self.loadings @ np.stack(basis, axis=1)

    def sigma(self) -> np.ndarray:
        """Eigenvalues of S' L L S for S, the L-orthonormal scores of the kept components."""
        if self._back is None:  # (L' W)' (L W), of which every S is made
            back = self.graph.product(self.white_packed.select("block", "n", "ids", "m"), transpose=True).select("block", F.col("lm").alias("back"))
            self._back = blocks.summed(self.white_packed.select("block", "n", "lm").join(back, "block"), ["back", "lm"], lambda a, b: a.T @ b)
        basis = self.orthonormal()
        return np.linalg.eigvalsh(basis.T @ self._back @ basis)

    def test(self, rows: DataFrame | None = None, acc: float = 1e-6) -> DataFrame:
        """feature, stat, cdf, p_value for every column, with one product for all; probabilities to ``acc``, made in tasks.

        The standardised columns that vary are tested, or the columns of ``rows`` (id, v) as they are, neither centred nor scaled.
        A column whose form x' L x is 0 has no statistic: null, and so are its probabilities.
        """
        spark = self.features.sparkSession
        lx = settled(self.graph.product(self.packed if rows is None else self.graph.pack(rows)))
        xlx = blocks.summed(lx, ["m", "lm"], lambda a, b: (a * b).sum(axis=0)[None])[0]
        vlx = self.loadings.T @ self.against(lx)
        names = self.columns if rows is None else range(len(xlx))
        found = [(int(c), float(top / below) if below else None) for c, top, below in zip(names, (vlx**2).sum(axis=0), xlx, strict=True)]
        weights = self.sigma()

        def run(batches):
            for pdf in batches:
                pdf["cdf"] = [None if np.isnan(x) else imhof_cdf(x, weights, acc=acc) for x in pdf["stat"].astype(float)]
                pdf["p_value"] = 1 - pdf["cdf"].astype(float)
                yield pdf

        stats = spark.createDataFrame(found, "feature int, stat double").repartition(spark.sparkContext.defaultParallelism)
        return settled(stats.mapInPandas(run, "feature int, stat double, cdf double, p_value double"))


def significant(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """The tested features below the level."""
    return tests.where(F.col("p_value") < level)
