"""Conversation structure repair by a fold over turns. DataFrame functions only.

A well-formed conversation has role initials ``(s?(ua)+)?``: perhaps a system turn, then user and assistant in turn. Each turn's first
fault counts: blank (no character but ``[\\x20\\x09-\\x0D]``), duplicate (role and text seen in an earlier turn), truncated (the last such
character is none of ``.!?``). Windows find the duplicates; then the sorted turns of a conversation are folded by ``aggregate()``, which
carries four (cost, audit) structs, the cheapest edits so far by where they end: nothing yet, after a system turn, inside a pair, after a
pair. ``least`` picks among them by cost, then by the audit in ASCII. Edits and their costs: K keep 0, R set the role to user or assistant
2, D delete 3 (required for blank and duplicate turns), I insert an empty user or assistant turn 2; a truncated turn that stays adds 1.
Two audits of equal cost at one turn never are prefixes of each other (the rest would be insertions, which cost), so the least prefix
leads to the least audit.

A conversation's rows take one shuffle, by conversation, and meet in one task, as its repaired text is one value. Inside it Spark sorts
and may spill.

Defined cases: turns are taken in order of turn (null first), role, text; null roles and texts count as given by ``nulls``; a null
conversation id is a conversation of its own; an empty role has no initial; a row that is not ``present`` counts for nothing, but its
conversation is returned; a conversation without present rows has zeros, no turns and an empty audit; ``gaps`` ignores null turns; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrel.llm.base import need

BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1
STATE = "struct<cost:int,audit:string>"
NOWHERE = f"cast(null as {STATE})"


def _then(state: Column, cost: Column | int, letter: Column | str) -> Column:
    cost, letter = (x if isinstance(x, Column) else F.lit(x) for x in (cost, letter))
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).cast("int").alias("cost"), F.concat(state["audit"], letter).alias("audit")))


def _inserted(s: Column) -> tuple[Column, Column]:
    """The states inside a pair and after one, once turns may have been inserted."""
    user = F.least(s["inside"], *[_then(s[c], INSERT, "I") for c in ("nothing", "system", "after")])
    return user, F.least(s["after"], _then(user, INSERT, "I"))


def _step(s: Column, x: Column) -> Column:
    """The four states after one more turn: struct of initial, gone (it must be deleted) and cut (it is truncated)."""
    user, answer = _inserted(s)
    stays = lambda state, c: F.when(~x["gone"], _then(state, F.when(x["cut"], CUT).otherwise(0) + F.when(x["initial"] == c, 0).otherwise(RENAME), F.when(x["initial"] == c, "K").otherwise("R")))
    return F.struct(
        _then(s["nothing"], DELETE, "D").alias("nothing"),
        F.least(_then(s["system"], DELETE, "D"), F.when(x["initial"] == "s", stays(s["nothing"], "s"))).alias("system"),
        F.least(_then(user, DELETE, "D"), stays(F.least(s["nothing"], s["system"], answer), "u")).alias("inside"),
        F.least(_then(answer, DELETE, "D"), stays(user, "a")).alias("after"),
    )


def cheapest(turns: Column) -> Column:
    """The cheapest (cost, audit) for an array of (initial, gone, cut)."""
    zero = F.expr(f"struct(cast(struct(0 as cost, '' as audit) as {STATE}) as nothing, {NOWHERE} as system, {NOWHERE} as inside, {NOWHERE} as after)")
    return F.aggregate(turns, zero, _step, lambda s: F.least(s["nothing"], _inserted(s)[1]))


def edited(turns: Column, audit: Column) -> Column:
    """Array of (role, text): the turns as ``audit`` says. Each turn's letter follows the insertions before it."""
    parts = F.regexp_extract_all(audit, F.lit("I*[KRD]"), F.lit(0))
    left = F.length(audit) - F.length(F.rtrim(audit, F.lit("I")))
    made = lambda n: F.array_repeat(F.struct(F.lit("I").alias("letter"), F.lit("").alias("role"), F.lit("").alias("text")), n)
    own = lambda x, p: F.when(p.endswith("D"), F.slice(made(F.lit(1)), 1, 0)).otherwise(F.array(F.struct(F.right(p, F.lit(1)).alias("letter"), x["role"].alias("role"), x["text"].alias("text"))))
    each = F.zip_with(turns, parts, lambda x, p: F.concat(made(F.length(p) - 1), own(x, p)))
    return F.concat(F.flatten(each), made(left))


def _roles(made: str, first: str) -> Column:
    """Kept turns keep their role; the others alternate from where a leading system turn leaves off."""
    other = lambda i: F.when(F.pmod(i - F.col(first), F.lit(2)) == 0, "user").otherwise("assistant")
    return F.transform(made, lambda x, i: F.struct(F.when(x["letter"] == "K", x["role"]).otherwise(other(i)).alias("role"), x["text"].alias("text")))


def repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None, nulls: str = " ") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired (array of role, text): a row per conversation.

    ``gaps``: turn numbers between the least and the largest that no row has; ``illegal``: neighbours whose initials are none of ``LEGAL``.
    """
    rows = need(df, conv_id, turn, role, text, *([present] if present else []))
    rows = rows if present else rows.withColumn("present", F.lit(True))
    rows = rows.toDF("conv_id", "turn", "role", "text", "present").withColumns({c: F.coalesce(c, F.lit(nulls)) for c in ("role", "text")}).withColumn("present", F.coalesce("present", F.lit(False)))
    seen = Window.partitionBy("conv_id", "present", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    said = F.rtrim("text", F.lit(BLANKS))
    blank, cut = said == "", ~F.right(said, F.lit(1)).isin(".", "!", "?")
    # The windows sort inside the partitions that the last grouping needs too, so texts move once.
    rows = rows.repartition("conv_id").withColumn("_again", F.row_number().over(seen) > 1)
    fault = F.when(blank, "blank").when(F.col("_again"), "duplicate").when(cut, "truncated").otherwise("")
    one = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text", "_again", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))
    found = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("present"), one))).alias("turns"))
    light = F.transform("turns", lambda x: F.struct(x["initial"].alias("initial"), x["fault"].isin("blank", "duplicate").alias("gone"), (x["fault"] == "truncated").alias("cut")))
    count = lambda name: F.size(F.filter("turns", lambda x: x["fault"] == name)).cast("long").alias(name)
    pairs = F.transform("turns", lambda x, i: F.when(i > 0, ~F.concat(F.get(F.col("turns"), i - 1)["initial"], x["initial"]).isin(*LEGAL)))
    numbers = F.array_distinct(F.filter(F.transform("turns", lambda x: x["turn"]), lambda t: t.isNotNull()))
    found = found.withColumn("_best", cheapest(light)).withColumn("_numbers", numbers)
    found = found.withColumn("_made", edited(F.col("turns"), F.col("_best.audit")))
    lead = F.get("_made", F.lit(0))
    found = found.withColumn("_first", F.when((lead["letter"] == "K") & (F.left(lead["role"], F.lit(1)) == "s"), 1).otherwise(0))
    gaps = F.coalesce(F.array_max("_numbers") - F.array_min("_numbers") + 1 - F.size("_numbers"), F.lit(0)).cast("long")
    return found.select(
        "conv_id", gaps.alias("gaps"), count("blank"), count("duplicate"), count("truncated"), F.size(F.filter(pairs, lambda p: p)).cast("long").alias("illegal"),
        F.col("_best.cost").cast("long").alias("cost"), F.col("_best.audit").alias("audit"), _roles("_made", "_first").alias("repaired"),
    )


def damage(df: DataFrame) -> DataFrame:
    """Adds ``present`` and damages rows by crc32 of ``conv_id:turn`` modulo 20: 0 takes the row out, 1 empties its text, 2 removes its
    ``.!?``, 3 repeats it, 4 makes its role user. A null counts as one space, but a null turn or conversation id stays null."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    rows = need(df, "conv_id", "turn", "role", "text").withColumn("_k", k)
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), (F.col("_k") != 0).alias("present"), "_k")
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_k") == 3, 2).otherwise(1)))).drop("_k", "_copy")
