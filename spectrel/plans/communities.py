"""Communities of a weighted graph of any size: moves, refinement and folding by vertex partitions, the quality never falling.

Quality is modularity with a resolution. Nodes are dealt into parts of about ``PART`` edges; a task moves the nodes of its part, one after the
other until none gains, while all other nodes stay where the round began. A graph of one part is thus moved as a whole. With several
parts, the moves are taken together if the quality did not fall; if it did, only those of half of the parts are, and so on down to
one part, whose moves can't lower it. Refinement merges single nodes inside each community (a large one is dealt into
parts, too), and in a graph of many parts then these groups; refined groups become the nodes of a smaller graph, until nothing moves or folds. Once a graph is one part, its task
goes on by itself, by the same steps.

A level's edges are packed once, at the home of their source. In each step the homes send labels to the homes of neighbours, as arrays, and then
deal nodes with their edges into parts, so a step is one job whose bytes grow with the edges. A node's edges meet in one task. What a task
holds is a part's nodes and edges.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrel.operators import blocks, graph
from spectrel.operators.peaks import numbered
from spectrel.runtime import ship, written

PART = 500_000
#: Rounds of moves of a level at most. With several parts they end when one adds less than ``LEAST`` of the total weight or ``SHARE`` of what the best one
#: added, as moves of groups at the next level add more then.
ROUNDS, LEAST, SHARE = 8, 5e-4, 0.1
#: Packed columns: what homes send to homes, and what they deal into parts.
SENT = {"ids": "<i8", "label": "<i8", "all": "<f8", "size": "<i8", "k": "<f8", "part": "<i4"}
DEALT = {"ids": "<i8", "k": "<f8", "label": "<i8", "all": "<f8", "size": "<i8", "degree": "<i4", "dst": "<i4", "w": "<f8", "ends": "<i8", "to": "<i8", "strength": "<f8", "many": "<i8"}
PACKS = {"ids": "<i8", "degree": "<i4", "dst": "<i4", "w": "<f8", "ends": "<i8"}


def _binary(kinds: dict[str, str]) -> str:
    return ", ".join(f"{c} binary" for c in kinds)


def _rows(kinds: dict[str, str], found: list[dict], **plain: pa.Array) -> pa.Table:
    """A table with a row for each of ``found``, whose arrays are packed."""
    return pa.table(plain | {c: pa.array([blocks.packed(x[c], kind) for x in found], pa.binary()) for c, kind in kinds.items()})


def _arrays(row: dict, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(row[c], kind) for c, kind in kinds.items()}


def _summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sum of their weights."""
    by = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[by], prepend=-1))
    return key[by][first], np.add.reduceat(w[by], first) if len(first) else np.zeros(0)


class _Part:
    """Nodes of a part, by place: ``ids`` and ``k`` (strength) of its own, which come first, ``dst`` and ``w`` of their edges one after the other (``degree``).

    ``label``: of own nodes and of others that edges end in, by number among ``names``; ``all``: strength by label, ``size``: nodes by label, over
    the whole graph; ``free``: for each own node a label that nobody has.
    """

    def __init__(self, ids, k, degree, dst, w, label, names, all_, size, free, total: float, gamma: float, rng: np.random.Generator):
        self.ids, self.k, self.degree, self.dst, self.w = ids, k, degree, dst, w
        self.label, self.names, self.all, self.size, self.free = label, names, all_, size, free
        self.total, self.gamma, self.rng = total, gamma, rng
        self.src = np.repeat(np.arange(len(ids)), degree)

    @classmethod
    def read(cls, dealt: list[dict[str, np.ndarray]], total: float, gamma: float, seed: int) -> _Part:
        """From what homes dealt to the part."""
        dealt = sorted(dealt, key=lambda x: x["ids"][0])
        x = {c: np.concatenate([d[c] for d in dealt]) for c in DEALT if c != "dst"}
        start = np.cumsum([0, *(len(d["ends"]) for d in dealt)])
        dst = np.concatenate([d["dst"] + s for d, s in zip(dealt, start, strict=False)])
        n = len(x["ids"])
        every, of = np.unique(np.concatenate([x["ids"], x["ends"]]), return_inverse=True)
        place = np.full(len(every), -1)
        place[of[:n]] = np.arange(n)
        place[place < 0] = np.arange(n, len(every))
        label, all_, size = np.zeros(len(every), np.int64), np.zeros(len(every)), np.zeros(len(every), np.int64)
        for to, own, other in ((label, "label", "to"), (all_, "all", "strength"), (size, "size", "many")):
            to[place[of]] = np.concatenate([x[own], x[other]])
        names, at = np.unique(np.concatenate([label, 2 * x["ids"] + 1]), return_inverse=True)
        at, free = at[: len(every)], at[len(every) :]
        by_label = [np.zeros(len(names)), np.zeros(len(names), np.int64)]
        by_label[0][at], by_label[1][at] = all_, size
        return cls(x["ids"], x["k"], x["degree"], place[of[n:]][dst], x["w"], at, names, *by_label, free, total, gamma, np.random.default_rng(seed))

    def single(self) -> _Part:
        """The same nodes, each its own group, with the edges inside the communities of the part alone."""
        n = len(self.ids)
        on = self.label[self.dst] == self.label[self.src]
        on &= self.dst < n
        one = np.arange(n)
        degree = np.bincount(self.src[on], minlength=n)
        return _Part(self.ids, self.k, degree, self.dst[on], self.w[on], one, self.ids, self.k.copy(), np.ones(n, np.int64), one, self.total, self.gamma, self.rng)

    def folded(self, fine: np.ndarray, n: int) -> _Part:
        """``n`` groups as nodes, of a part that is the whole graph; labels are as ``renamed`` gives them."""
        label = np.zeros(n, np.int64)
        label[fine] = self.label
        a, b = fine[self.src], fine[self.dst]
        key, w = _summed((a * n + b)[a != b], self.w[a != b])
        made = _Part(np.arange(n), np.bincount(fine, self.k, n), np.bincount(key // n, minlength=n), key % n, w, label, None, None, None, None, self.total, self.gamma, self.rng)
        made.renamed()
        return made

    def renamed(self) -> int:
        """Labels are numbered in order of the least of their group, of which there are as many as is returned; for a part that is the whole graph."""
        n = len(self.ids)
        _, first, at = np.unique(self.label, return_index=True, return_inverse=True)
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        self.label = rank[at]
        self.all, self.size = np.bincount(self.label, self.k, len(first) + n), np.bincount(self.label, minlength=len(first) + n)
        self.free = len(first) + np.arange(n)
        return len(first)

    def finish(self) -> None:
        """All steps to the end, for a part that is the whole graph."""
        p, home, first = self, np.arange(len(self.ids)), True
        while True:
            moved = p.move()
            if p.renamed() == len(p.ids) or not (moved or first):
                break
            fine = p.single()
            fine.refine()
            kept, to = np.unique(fine.label, return_inverse=True)
            if len(kept) == len(p.ids):
                if not moved:
                    break
                to = p.label  # no two nodes join: fold whole communities
            home, p, first = to[home], p.folded(to, int(to.max()) + 1), False
        _, least, self.label = np.unique(p.label[home], return_index=True, return_inverse=True)
        self.names = 2 * self.ids[least]

    def gaining(self) -> np.ndarray:
        """Own nodes that a move would be good for, as all stand."""
        n, many, k = len(self.ids), len(self.all), self.k
        own, scale = self.label[:n], self.gamma * k / self.total
        stay = -scale * (self.all[own] - k)
        key, w = _summed(self.src * many + self.label[self.dst], self.w)
        u, c = key // many, key % many
        mine = own[u] == c
        g = w - scale[u] * (self.all[c] - np.where(mine, k[u], 0))
        stay[u[mine]] = g[mine]
        most, first = stay.copy(), np.flatnonzero(np.diff(u, prepend=-1))
        if len(first):
            most[u[first]] = np.maximum(most[u[first]], np.maximum.reduceat(g, first))
        return np.flatnonzero((most > stay + 1e-12) | (most < -1e-12) & (self.size[own] > 1) & (self.size[self.free] == 0))

    def move(self) -> bool:
        """Own nodes go where the quality gains most until none gains; a node that no group is good for stands alone, under a label of its own. True if any moved."""
        near, heavy, any_ = None, None, False
        while len(start := self.gaining()):
            if near is None:
                cut = np.cumsum([0, *self.degree]).tolist()
                dst, w = self.dst.tolist(), self.w.tolist()
                near, heavy = ([x[a:b] for a, b in zip(cut, cut[1:], strict=False)] for x in (dst, w))
            if not self._moved(self.rng.permutation(start).tolist(), near, heavy):
                break
            any_ = True
        return any_

    def _moved(self, start: list[int], near: list[list[int]], heavy: list[list[float]]) -> int:
        """Moves of the nodes that a queue begins with, and of those next to nodes that moved."""
        label, all_, size = self.label.tolist(), self.all.tolist(), self.size.tolist()
        k, free, n, moves = self.k.tolist(), self.free.tolist(), len(self.ids), 0
        queue, waiting = deque(start), bytearray(n)
        for u in start:
            waiting[u] = 1
        while queue:
            u = queue.popleft()
            waiting[u] = 0
            own, ku = label[u], k[u]
            scale = self.gamma * ku / self.total
            links = {own: 0.0}
            for v, w in zip(near[u], heavy[u], strict=True):
                c = label[v]
                links[c] = links.get(c, 0.0) + w
            stay = links.pop(own) - scale * (all_[own] - ku)
            best, most = own, stay
            for c, w in links.items():
                g = w - scale * all_[c]
                if g > most or g == most and c < best:
                    best, most = c, g
            if most < -1e-12 and size[own] > 1 and not size[free[u]]:
                best, most = free[u], 0.0
            if best == own or most <= stay + 1e-12:
                continue
            moves += 1
            all_[own] -= ku
            size[own] -= 1
            all_[best] += ku
            size[best] += 1
            label[u] = best
            for v in near[u]:
                if v < n and not waiting[v] and label[v] != best:
                    queue.append(v)
                    waiting[v] = 1
        self.label, self.all, self.size = np.array(label), np.array(all_), np.array(size)
        return moves

    def refine(self, layers: int = 1) -> None:
        """Single nodes join the neighbouring group that gains most, once; then so do the groups, as often as ``layers`` says. For a part as ``single`` gives it."""
        p, home = self, np.arange(len(self.ids))
        for i in range(layers):
            if i:
                p = p.folded(to, len(kept))
            p._joined()
            kept, to = np.unique(p.label, return_inverse=True)
            home = to[home]
            if len(kept) == len(p.ids):
                break
        _, least, at = np.unique(home, return_index=True, return_inverse=True)
        self.label = least[at]

    def _joined(self) -> None:
        label, all_, size, k = (x.tolist() for x in (self.label, self.all, self.size, self.k))
        dst, w, cut = self.dst.tolist(), self.w.tolist(), np.cumsum([0, *self.degree]).tolist()
        for u in self.rng.permutation(len(label)).tolist():
            if size[label[u]] == 1:
                links: dict[int, float] = {}
                for i in range(cut[u], cut[u + 1]):
                    c = label[dst[i]]
                    links[c] = links.get(c, 0.0) + w[i]
                own, scale = label[u], self.gamma * k[u] / self.total
                best, most = own, -scale * (all_[own] - k[u]) + 1e-12
                for c, x in links.items():
                    g = x - scale * all_[c]
                    if g > most or g == most and c < best:
                        best, most = c, g
                if best != own:
                    all_[own] -= k[u]
                    size[own] -= 1
                    all_[best] += k[u]
                    size[best] += 1
                    label[u] = best
        self.label = np.array(label, np.int64)


class _Level:
    """A graph of numbered nodes: ``nodes`` (id, k, label), ``edges`` (src, dst, w) both ways and without loops."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, total: float, gamma: float, part: int, homes: int | None = None):
        """``homes``: their number; about as many as parts unless given."""
        self.nodes, self.total, self.gamma = written(nodes), total, gamma
        self.homes = homes or max(1, -(-edges.count() // part))
        self.packs = written(self._packed(edges))
        self.n, many = self.packs.agg(F.coalesce(F.sum("nodes"), F.lit(0)), F.coalesce(F.sum("edges"), F.lit(0))).first()
        self.parts = max(1, -(-many // part))

    def again(self, nodes: DataFrame) -> _Level:
        """The same graph with other labels."""
        made = copy(self)
        made.nodes = written(nodes)
        return made

    def _home(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.homes)).cast("int")

    def _packed(self, edges: DataFrame) -> DataFrame:
        """A row per home: its nodes' ids and edges (``dst``: place among ``ends``), and to which homes it sends what is known of which of its nodes."""
        def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
            ids = np.sort(nodes["id"].to_numpy())
            src, dst, w, to = (edges[c].to_numpy() for c in ("src", "dst", "w", "to"))
            by = np.lexsort((dst, src))
            at, to = np.searchsorted(ids, src[by]), to[by]
            ends, dst = np.unique(dst[by], return_inverse=True)
            where, first = np.unique(to * np.int64(len(ids)) + at, return_index=True)
            cut = np.flatnonzero(np.diff(to[first], prepend=-1))
            sent = [blocks.packed(ids[x], "<i8") for x in np.split(where % max(1, len(ids)), cut[1:])] if len(cut) else []
            pack = {"ids": ids, "degree": np.bincount(at, minlength=len(ids)), "dst": dst, "w": w[by], "ends": ends}
            return _rows(PACKS, [pack], home=nodes["home"][:1], nodes=pa.array([len(ids)]), edges=pa.array([len(w)]), to=pa.array([to[first][cut].tolist()], pa.list_(pa.int32())), sent=pa.array([sent], pa.list_(pa.binary())))

        nodes = self.nodes.select(self._home("id").alias("home"), "id")
        along = edges.select(self._home("src").alias("home"), "src", "dst", "w", self._home("dst").alias("to"))
        return nodes.groupBy("home").cogroup(along.groupBy("home")).applyInArrow(run, f"home int, nodes long, edges long, to array<int>, sent array<binary>, {_binary(PACKS)}")

    def _met(self, own: DataFrame, work: Callable[[dict, dict, dict], pa.Table], schema: str) -> DataFrame:
        """What ``work`` makes at each home of its pack, of what ``own`` (id, label, all, size, k, part) says of its nodes, and of what it says of ``ends``."""
        def send(own: pa.Table, pack: pa.Table) -> pa.Table:
            own = own.sort_by("id")
            x = {"ids" if c == "id" else c: own[c].to_numpy() for c in own.column_names if c != "home"}
            found, to = [x], [own["home"][0].as_py(), *pack["to"][0].as_py()]
            for ids in pack["sent"][0]:
                at = np.searchsorted(x["ids"], np.frombuffer(ids.as_buffer(), "<i8"))
                found.append({c: x[c][at] if c in ("ids", "label", "all", "size") else x[c][:0] for c in x})
            return _rows(SENT, found, home=pa.array(to, pa.int32()), own=pa.array([True] + [False] * (len(found) - 1)))

        def meet(pack: pa.Table, sent: pa.Table) -> pa.Table:
            mine = _arrays(next(blocks.each(pack.to_batches())), PACKS)
            ends = {c: np.zeros(len(mine["ends"]), SENT[c]) for c in ("label", "all", "size")}
            for row in blocks.each(sent.to_batches()):
                x = _arrays(row, SENT)
                if row["own"]:
                    own = x
                at = np.searchsorted(mine["ends"], x["ids"])
                on = np.flatnonzero(at < len(mine["ends"]))
                on = on[mine["ends"][at[on]] == x["ids"][on]]
                for c, y in ends.items():
                    y[at[on]] = x[c][on]
            return work(mine, own, ends)

        own = own.select(self._home("id").alias("home"), F.col("id"), *[F.col(c) for c in SENT if c != "ids"])
        sent = own.groupBy("home").cogroup(self.packs.select("home", "to", "sent").groupBy("home")).applyInArrow(send, f"home int, own boolean, {_binary(SENT)}")
        return self.packs.select("home", *PACKS).groupBy("home").cogroup(sent.groupBy("home")).applyInArrow(meet, schema)

    def _labelled(self, nodes: DataFrame, seed: int, t: int) -> DataFrame:
        """Nodes with the strength and size of their label, and their part. Labels become twice the least id of their group. Groups stay together
        in a part, as far as their sizes let them."""
        of = nodes.groupBy("label").agg(F.sum("k").alias("all"), F.count(F.lit(1)).alias("size"), (2 * F.min("id")).alias("name"))
        own = nodes.join(of, "label").select("id", "k", F.col("name").alias("label"), "all", "size")
        spread = F.floor(F.col("size") * self.parts / self.n).cast("long") + 1
        return own.withColumn("part", F.pmod(F.xxhash64("label", F.pmod(F.xxhash64("id", F.lit(t)), spread), F.lit(seed + t)), F.lit(self.parts)).cast("int"))

    def _by_part(self, nodes: DataFrame, work: str, seed: int, t: int) -> DataFrame:
        """``nodes`` (id, k, label) with the columns part, q, which adds up to their quality, and new: the label after the work of their parts."""
        total, gamma, inner = self.total, self.gamma, work == "refine"
        layers = 1 + int(math.log(self.parts, 3))  # a layer makes about a third of the nodes, so levels are few however large the graph

        def deal(pack: dict, own: dict, ends: dict) -> pa.Table:
            src = np.repeat(np.arange(len(own["ids"])), pack["degree"])
            dst, w = pack["dst"], pack["w"]
            inside = own["label"][src] == ends["label"][dst]
            q = w[inside].sum() - gamma / total * (own["all"] ** 2 / own["size"]).sum()  # each label's square, shared out among its nodes
            if inner:
                src, dst, w = src[inside], dst[inside], w[inside]
            degree, found = np.bincount(src, minlength=len(own["ids"])), []
            by = np.argsort(own["part"][src], kind="stable")
            part, number = np.unique(own["part"], return_inverse=True)
            cut = np.searchsorted(number[src][by], np.arange(len(part) + 1))
            for i in range(len(part)):
                at, on = np.flatnonzero(number == i), by[cut[i] : cut[i + 1]]
                end, to = np.unique(dst[on], return_inverse=True)
                found.append({c: own[c][at] for c in ("ids", "k", "label", "all", "size")} | {"degree": degree[at], "dst": to, "w": w[on], "ends": pack["ends"][end], "to": ends["label"][end], "strength": ends["all"][end], "many": ends["size"][end]})
            return _rows(DEALT, found, part=pa.array(part, pa.int32()), q=pa.array([q] + [0.0] * (len(part) - 1)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [(row["part"], row["q"], _arrays(row, DEALT)) for row in blocks.each(batches)]
            if not rows:
                return
            p = _Part.read([x for *_, x in rows], total, gamma, seed + t)
            n, was = len(p.ids), p.names[p.label[: len(p.ids)]]
            q = np.zeros(n)
            q[0] = sum(x for _, x, _ in rows)
            if inner:
                p = p.single()
                p.refine(layers)
            elif work != "measure":
                getattr(p, work)()
            yield pa.RecordBatch.from_arrays([pa.array(p.ids), pa.array(p.k), pa.array(was), pa.array(np.full(n, rows[0][0], np.int32)), pa.array(q), pa.array(p.names[p.label[:n]])], names=["id", "k", "label", "part", "q", "new"])

        dealt = self._met(self._labelled(nodes, seed, t), deal, f"part int, q double, {_binary(DEALT)}")
        return dealt.repartitionById(self.parts, "part").mapInArrow(run, "id long, k double, label long, part int, q double, new long")

    def quality(self, nodes: DataFrame) -> float:
        """Of nodes, which a round of moves has measured as it began."""
        made = nodes if "q" in nodes.columns else self._by_part(nodes, "measure", 0, 0)
        return float(made.agg(F.sum("q")).first()[0] or 0.0)

    def moved(self, seed: int) -> tuple[DataFrame, bool]:
        """Nodes after rounds of moves, and whether any moved. Labels are then twice the least id of a group, so odd ones are free.

        A round is one table, which has the quality that it began with; so a round whose moves lowered it is known by the next.
        """
        nodes, last, before, best, among, t = self.nodes, None, -math.inf, 0.0, 1, 0
        while True:
            made = written(self._by_part(nodes, "move" if t < ROUNDS else "measure", seed, t))
            after = self.quality(made)
            if among > 1 and after < before - 1e-9:
                among = -(-among // 2)
                some = F.col("part") < among if among > 1 else F.col("part") == last.where("new <> label").agg(F.min("part")).first()[0]
                nodes = last.select("id", "k", F.when(some, F.col("new")).otherwise(F.col("label")).alias("label"))
                continue
            best = max(best, after - before) if t else 0.0
            if t == ROUNDS or t and after - before < max(LEAST * self.total, SHARE * best) or not t and made.where("new <> label").isEmpty():
                return made.select("id", "k", "label"), t > 0
            nodes, last, before, among, t = made.select("id", "k", F.col("new").alias("label")), made, after, self.parts, t + 1

    def finished(self, seed: int) -> DataFrame:
        """Nodes with their labels at the end; for a graph of one part."""
        return written(self._by_part(self.nodes, "finish", seed, 0).select("id", "k", F.col("new").alias("label")))

    def refined(self, nodes: DataFrame, seed: int) -> DataFrame:
        """id, k, label, fine: groups inside the communities."""
        return written(self._by_part(nodes, "refine", seed, 0).select("id", "k", "label", F.col("new").alias("fine")))

    def folded(self, fine: DataFrame, part: int) -> _Level:
        """The groups of ``fine`` as nodes; each keeps the community it is in."""
        def fold(pack: dict, own: dict, ends: dict) -> pa.Table:
            a, b = np.repeat(own["label"], pack["degree"]), ends["label"][pack["dst"]]
            name, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            a, b = at[: len(a)], at[len(a) :]
            key, w = _summed((a * len(name) + b)[a != b], pack["w"][a != b])
            return pa.table({"src": name[key // max(1, len(name))], "dst": name[key % max(1, len(name))], "w": w})

        none = [F.lit(0.0).alias("all"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("part")]
        edges = self._met(fine.select("id", F.col("fine").alias("label"), "k", *none), fold, "src long, dst long, w double").groupBy("src", "dst").agg(F.sum("w").alias("w"))
        nodes = fine.groupBy(F.col("fine").alias("id")).agg(F.sum("k").alias("k"), F.first("label").alias("label"))
        named = nodes.groupBy("label").agg((2 * F.min("id")).alias("name"))
        return _Level(nodes.join(named, "label").select("id", "k", F.col("name").alias("label")), edges, self.total, self.gamma, part, self.parts)


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 42, passes: int = 3, part: int = PART) -> DataFrame:
    """id, label of an undirected graph (a, b, w): communities numbered from 0 by size, then smallest id.

    A local optimum; among negative weights the best can be well above it. ``passes``: each starts from single nodes in the groups of the
    one before, so that groups can split, and the last ends when the groups stay. ``part``: edges, both ways, of a part. Parallel edges
    add up, loops count. If weights add up to no more than 0 there is nothing to group by, and each node is its own group.
    """
    spark = edges.sparkSession
    ship(spark)
    given = written(graph.undirected(edges.select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst"), F.col("w").cast("double").alias("w"))))
    ids = written(numbered(given.select(F.explode(F.array("a", "b")).alias("name")).distinct(), [F.col("name")]).select("name", F.col("rn").cast("long").alias("id")))
    end = lambda c: ids.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    plain = given.join(end("a"), "a").join(end("b"), "b").select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "w")
    both = written(plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))  # a loop counts twice
    strength = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    total = both.agg(F.sum("w")).first()[0] or 0.0
    label, whole = ids.select("id", (2 * F.col("id")).alias("label")), None
    for t in range(passes if total > 0 else 0):
        own = strength.join(label, "id")
        level = whole = whole.again(own) if whole else _Level(own, both.where("src <> dst"), total, resolution, part)
        home, before, depth = ids.select("id", F.col("id").alias("at")), label, 0
        while True:
            if level.parts == 1:
                nodes = level.finished(seed + 100 * t)
                break
            nodes, moved = level.moved(seed + 100 * t)
            groups = nodes.select("label").distinct().count()
            if groups == level.n or depth and not moved:
                break
            fine = level.refined(nodes, seed + 100 * t)
            if fine.select("fine").distinct().count() == level.n:
                if not moved:
                    break
                fine = fine.withColumn("fine", F.expr("label div 2"))  # no two nodes join: fold whole communities
            home = written(home.join(fine.select(F.col("id").alias("at"), "fine"), "at").select("id", F.col("fine").alias("at")))
            level, depth = level.folded(fine, part), depth + 1
        named = home.join(nodes.select(F.col("id").alias("at"), F.col("label").alias("_l")), "at")
        label = written(named.join(named.groupBy("_l").agg((2 * F.min("id")).alias("label")), "_l").select("id", "label"))
        if label.join(before.select("id", F.col("label").alias("old")), "id").where("label <> old").isEmpty():
            break
    ranked = label.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    numbers = numbered(ranked, [F.desc("n"), F.col("first")]).select("label", F.col("rn").cast("int").alias("number"))
    return written(label.join(numbers, "label").join(ids, "id").select(F.col("name").alias("id"), F.col("number").alias("label")))
