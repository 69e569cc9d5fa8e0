"""Reply trees, formatted as conversations. DataFrame functions only.

Messages form trees by ``parent_id``. Root-to-leaf paths are enumerated by iterative self-joins on (conversation, node): the
links are doubled (ancestor 1, 2, 4, ... steps up) until none are left, each carrying the sum of the scores on its way, so that
after log2(depth) joins of narrow rows every message has its number of ancestors and the sum of the scores from its root. Leaves
are ranked by that sum (ties: smaller leaf id first); only the ``top_k`` chosen ones are then joined to the links from the longest
step down. As every distance has one binary expansion, each ancestor of a chosen leaf is met exactly once. So rows are
those of the messages and of the chosen paths, however bushy or deep a tree is. A join key is a message; the leaves of a
conversation are cut to ``top_k`` in each task before they meet, and a path meets in one task, as it becomes one row.

A turn reads ``<|role|>``, line end, text, line end, ``<|end|>``, line end. Inside roles and texts the characters of
control strings are escaped (``&`` ``<`` ``[`` ``|``), which is undone by ``unescape``. The loss mask is a list of
(start, end) code point spans of the output: the texts of the trained role, each once, in order.

Defined cases: null text and null role are empty; a null score counts 0; a null conversation id is a conversation of its
own; a parent that doesn't exist makes its reply a root; rows that repeat a (conversation, node) are reduced to one, that
with the smallest parent, role, text and score in this order, null first (``chain`` numbers turns, so tables of turns may
repeat rows); a row without a node id is no message; links that form a ring raise ValueError; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrel.llm.base import need, store

END = "<|end|>\n"


def escape(c: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in (("|", "&#124;"), ("[", "&#91;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def chain(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of turns as trees of one branch: node_id numbers the turns of a conversation, parent_id is the one before."""
    rows = need(df, conv_id, turn, role, text).toDF("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("node_id", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _named(df: DataFrame, node: str = "node_id", **columns: str) -> DataFrame:
    """Columns _c and _n to join by, and the others under new names."""
    return df.select(F.col("conv_id").alias("_c"), F.col(node).alias("_n"), *[F.col(old).alias(new) for new, old in columns.items()])


def _same(conv_id: str, node: str) -> Column:
    return F.col(conv_id).eqNullSafe(F.col("_c")) & (F.col(node) == F.col("_n"))


def single(nodes: DataFrame) -> DataFrame:
    """One row per (conversation, node)."""
    rest = ["parent_id", "role", "text", "score"]
    one = nodes.where("node_id is not null").groupBy("conv_id", "node_id").agg(F.min(F.struct(*rest)).alias("_one"))
    return one.select("conv_id", "node_id", *[F.col(f"_one.{c}").alias(c) for c in rest])


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tops, steps). tops: conv_id, node_id, depth (number of ancestors), total (scores from the root to the node), leaf; steps[k]:
    conv_id, node_id, to: the ancestor 2^k steps up, of the nodes that have one."""
    ids = nodes.select("conv_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    linked = ids.join(_named(nodes), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("parent_id") == F.col("_n")), "left")
    first = store(linked.select("conv_id", "node_id", F.col("_n").alias("to"), F.lit(0).cast("long").alias("depth"), F.col("score").alias("total")), "chat-step")
    # ``total`` has the scores from the node up to, but without, ``to``; without ``to`` all is known.
    parents = _named(first.where("to is not null"), "to").distinct()
    leaves = first.join(parents, _same("conv_id", "node_id"), "left_anti").select("conv_id", "node_id")
    steps: list[DataFrame] = []
    done, n = first, first.count()
    while not done.where("to is not null").isEmpty():
        open_ = done.where("to is not null")
        if 1 << len(steps) > n:
            raise ValueError("the replies form a ring")
        steps.append(open_.select("conv_id", "node_id", "to"))
        ahead = _named(done, next="to", more="total", up="depth")
        found = open_.join(ahead, _same("conv_id", "to"))
        size = 1 << (len(steps) - 1)
        doubled = found.select("conv_id", "node_id", F.col("next").alias("to"), (F.lit(size) + F.col("up")).alias("depth"), (F.col("total") + F.col("more")).alias("total"))
        done = store(doubled.unionByName(done.where("to is null")), "chat-step")
    tops = done.drop("to").join(_named(leaves, leaf="node_id"), _same("conv_id", "node_id"), "left")
    return tops.select("conv_id", "node_id", "depth", "total", F.col("leaf").isNotNull().alias("leaf")), steps


def paths(chosen: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """conv_id, leaf_id, node_id, up (steps from the leaf): the chosen leaves (conv_id, leaf_id) and all their ancestors."""
    found = chosen.select("conv_id", "leaf_id", F.col("leaf_id").alias("at"), F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(steps))):
        more = found.join(_named(steps[k], to="to"), _same("conv_id", "at"))
        more = more.select("conv_id", "leaf_id", F.col("to").alias("at"), (F.col("up") + (1 << k)).alias("up"))
        found = store(found.unionByName(more), "chat-paths")
    return found.withColumnRenamed("at", "node_id")


def format_trees(nodes: DataFrame, top_k: int = 1, loss_role: str = "assistant", no_repeats: bool = False) -> DataFrame:
    """conv_id, leaf_id, branch_rank, branch_score, formatted, loss_spans: the ``top_k`` best branches of each tree.

    ``nodes``: conv_id, node_id, parent_id, role, text, score. ``no_repeats``: the caller knows that no (conversation, node) repeats, as
    ``chain`` makes them, so that texts need not meet for that.
    """
    nodes = need(nodes, "conv_id", "node_id", "parent_id", "role", "text", "score")
    nodes = store(nodes.where("node_id is not null") if no_repeats else single(nodes), "chat-nodes")
    tops, steps = climb(nodes)
    rank = Window.partitionBy("conv_id").orderBy(F.desc("total"), "node_id")
    chosen = tops.where("leaf").withColumn("branch_rank", F.row_number().over(rank)).where(F.col("branch_rank") <= top_k)
    chosen = store(chosen.select("conv_id", F.col("node_id").alias("leaf_id"), F.col("total").alias("branch_score"), "branch_rank", "depth"), "chat-chosen")
    found = paths(chosen, steps)
    said = _named(nodes, role="role", text="text")
    ranks = chosen.select(F.col("conv_id").alias("_bc"), F.col("leaf_id").alias("_bl"), "branch_score", "branch_rank", "depth")
    rows = found.join(ranks, F.col("conv_id").eqNullSafe(F.col("_bc")) & (F.col("leaf_id") == F.col("_bl"))).join(said, _same("conv_id", "node_id"))
    rows = rows.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("conv_id", "leaf_id", "branch_rank", "branch_score", (F.col("depth") - F.col("up")).alias("pos"), "role", escape(F.col("role")).alias("_role"), escape(F.col("text")).alias("_text"))
    rows = rows.withColumn("piece", F.concat(F.lit("<|"), "_role", F.lit("|>\n"), "_text", F.lit("\n" + END)))
    before = Window.partitionBy("conv_id", "leaf_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("_role") + 5
    rows = rows.withColumn("start", start.cast("long")).withColumn("end", (F.col("start") + F.length("_text")).cast("long"))
    span = F.when(F.col("role") == loss_role, F.struct("start", "end"))
    turns = F.array_sort(F.collect_list(F.struct("pos", "piece", span.alias("span"))))
    out = rows.groupBy("conv_id", "leaf_id").agg(F.first("branch_rank").alias("branch_rank"), F.first("branch_score").alias("branch_score"), turns.alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return out.select("conv_id", "leaf_id", "branch_rank", "branch_score", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (array of role, text) and ``loss_text``, both read from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda p: p != "")
    # Four bytes a code point, so that a span is found without a scan of what stands before it.
    out = formatted.withColumn("_pieces", pieces).withColumn("_wide", F.encode("formatted", "UTF-32"))
    out = out.withColumn("turns", F.transform("_pieces", lambda p: F.struct(F.substring_index(p, "|>", 1).alias("head"), p.alias("piece"))))
    out = out.withColumn(
        "turns",
        F.transform("turns", lambda t: F.struct(unescape(F.substring(t["head"], 3, 2147483647)).alias("role"), unescape(t["piece"].substr(F.length(t["head"]) + F.lit(4), F.length(t["piece"]) - F.length(t["head"]) - F.lit(4))).alias("text"))),
    )
    masked = F.transform("loss_spans", lambda s: F.when(F.length("_wide") >= s["end"] * 4, F.decode(F.col("_wide").substr((s["start"] * 4 + 1).cast("int"), ((s["end"] - s["start"]) * 4).cast("int")), "UTF-32")))
    return out.withColumn("loss_text", unescape(F.array_join(masked, ""))).drop("_pieces", "_wide")
