"""Personal data by bootstrapped contextual extraction. DataFrame functions only.

Seeds are what the rules below find. A slot is a longest run of words that hold a digit or ``@`` (words of phone punctuation alone may
stand between); no rule matches across slots, so rules are tried on slots alone. Each slot without its outer punctuation is an instance,
and its neighbours make three lexical patterns: the two words before it, the word on either side, and the word before it (A-Z
lower-cased). Patterns and instances form a graph of distinct pairs:

* a pattern's confidence in a kind is the instances' scores for the kind above chance, ``(sum - share * n) / ((1 - share) * (n + 1))``, with
  n its distinct instances and share the kind's among all distinct instances. Patterns count from ``accept`` on if they have ``support``
  instances whose score is 1 or at least ``final``;
* an instance of one kind has the score 1 for it; one that matches no rule has 1 - product(1 - confidence) over its patterns that count,
  for its best kind, of those whose make it has (``MAKES``, so that no year becomes a phone number).

Scores are exchanged for ``rounds`` rounds, and slots whose instance then has a score of ``final`` or more are added as spans. Patterns that can't reach
``support`` are left out beforehand, which changes nothing.

Texts are read once; what is stored and shuffled are the slots. Pairs are made distinct and added up before the shuffle, and joins are
salted on the larger side, so that a frequent pattern or instance costs no task more. A text's spans meet in one task, as they become one value.

Rules (leftmost, not overlapping within a kind; possessive and bound to the start of a run, so linear in the text): email, ip with
parts up to 255, card of 13 to 19 digits that pass Luhn, phone of 9 to 15 digits; what fails is dropped without a retry.

Defined cases: null and empty texts have no slot and no span; a null or repeated doc_id keeps a row each; equal rows count as often as they occur,
but the graph has each pair once; instances and patterns beyond ``LONGEST`` characters are told apart by their SHA-256; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrel.llm.base import discard, need, store

KINDS = ("email", "ip", "card", "phone")
_B, _N = r"\x20\x09-\x0D", r"[^\x20\x09-\x0D]"
_WORD = rf"[^{_B}0-9@]*+[0-9@]{_N}*+"
SLOT = rf"(?<!{_N}){_WORD}(?:[{_B}]++(?:[().-]++[{_B}]++)*+{_WORD})*+"
_LOCAL = "A-Za-z0-9._%+-"
RULES = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What an instance of no rule must be made of to count as a kind, beside its number of digits (fixed values).
MAKES = {"email": (r"\A[^@\x20]+@[^@\x20]+\z", 0, 64), "ip": (r"\A[0-9A-Fa-f]*([.:][0-9A-Fa-f]*){3,}\z", 2, 32), "card": (r"\A[0-9][0-9\x20-]*\z", 12, 19), "phone": (r"\A[+(]?[0-9][0-9().\x20-]*\z", 6, 15)}
LONGEST = 96
SALT = 16
STEPS = [1 << k for k in range(31)]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def passes(kind: str, found: Column) -> Column:
    """Whether a match of the rule is of the kind."""
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return ~F.exists(F.split(found, r"\."), lambda p: (F.length(part(p)) > 3) | (F.coalesce(F.left(part(p), F.lit(3)).try_cast("int"), F.lit(0)) > 255))
    if kind == "card":
        return F.length(_digits(found)).between(13, 19) & F.call_function("luhn_check", _digits(found))
    return F.length(_digits(found)).between(9, 15) if kind == "phone" else F.lit(True)


def running(lengths: Column) -> Column:
    """Running sums of an array, in as many rounds as its size has binary digits."""
    ahead = lambda p, step: F.transform(p, lambda x, i: x + F.coalesce(F.get(p, i - step), F.lit(0)))
    return F.aggregate(F.filter(F.array(*map(F.lit, STEPS)), lambda k: k < F.size(lengths)), lengths, ahead)


def _matched(df: DataFrame, text: str, rule: str, gaps: str, hits: str, ends: str) -> DataFrame:
    """Adds what stands between matches, the matches, and where these end."""
    df = df.withColumns({gaps: F.split(text, rule, -1), hits: F.regexp_extract_all(text, F.lit(rule), F.lit(0))})
    return df.withColumn(ends, running(F.zip_with(F.slice(F.col(gaps), 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))))


def slots(df: DataFrame) -> DataFrame:
    """doc_id, row, text, start, before, after: a row for each slot (``text`` is the slot's), or one of nulls for a text without. Narrow."""
    df = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    df = _matched(df, "text", SLOT, "_gaps", "_hits", "_ends")
    each = F.transform("_hits", lambda h, i: F.struct((F.get("_ends", i) - F.length(h)).alias("start"), h.alias("text"), F.get("_gaps", i).alias("before"), F.get("_gaps", i + 1).alias("after")))
    return df.select("doc_id", "row", F.inline_outer(each))


def _rule_spans(df: DataFrame) -> DataFrame:
    """Adds ``base``: kind (its place), start, end of what the rules find in the slot."""
    def spans(k: int) -> Column:
        end = lambda i: F.col("start") + F.get(f"_e{k}", i)
        one = F.transform(f"_h{k}", lambda h, i: F.when(passes(KINDS[k], h), F.struct(F.lit(k).alias("kind"), (end(i) - F.length(h)).alias("start"), end(i).alias("end"))))
        return F.filter(one, lambda s: s.isNotNull())

    for k, kind in enumerate(KINDS):
        df = _matched(df, "text", RULES[kind], f"_g{k}", f"_h{k}", f"_e{k}")
    return df.withColumn("base", F.concat(*map(spans, range(len(KINDS)))))


def of_kind(spans: str, k: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == k)


def _lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _short(c: Column) -> Column:
    return F.when(F.length(c) <= LONGEST, c).otherwise(F.sha2(c, 256))


def with_contexts(found: DataFrame) -> DataFrame:
    """doc_id, row, base, start, end, instance, mask (bits of the kinds it has by rule), makes (bits it could have), patterns."""
    inner = F.regexp_replace("text", r"\A[^A-Za-z0-9+(@]++", "")
    lead = F.length("text") - F.length(inner)
    found = _rule_spans(found).withColumns({"_lead": lead, "_in": F.regexp_replace(inner, r"(?<![^A-Za-z0-9)])[^A-Za-z0-9)]++\z", "")})
    n = F.length(_digits(F.col("_in")))
    bit = lambda k, on: F.when(on, 1 << k).otherwise(0)
    mask = sum((bit(k, F.size(of_kind("base", k)) > 0) for k in range(len(KINDS))), F.lit(0))
    makes = sum((bit(k, F.col("_in").rlike(MAKES[kind][0]) & n.between(*MAKES[kind][1:])) for k, kind in enumerate(KINDS)), F.lit(0))
    words = lambda c: F.filter(F.split(_lowered(F.col(c)), rf"[{_B}]+"), lambda w: w != "")
    found = found.withColumns({"_l": words("before"), "_r": words("after")})
    at = lambda c, i, edge: F.coalesce(F.get(c, i), F.lit(edge))
    l1, l2, r1 = at("_l", F.size("_l") - 1, "^"), at("_l", F.size("_l") - 2, "^"), at("_r", F.lit(0), "$")
    patterns = F.array(*[F.concat(F.lit(name), _short(p)) for name, p in (("2 ", F.concat_ws(" ", l2, l1)), ("1 1 ", F.concat_ws(" ", l1, r1)), ("1 ", l1))])
    start = (F.col("start") + F.col("_lead")).cast("long")
    return found.select("doc_id", "row", "base", start.alias("start"), (start + F.length("_in")).alias("end"), _short(F.col("_in")).alias("instance"), mask.alias("mask"), makes.alias("makes"), patterns.alias("patterns"))


def _met(large: DataFrame, small: DataFrame, key: list[str], by: str) -> DataFrame:
    """An inner join whose larger side is dealt by ``SALT`` too, so that a frequent key is spread; the smaller one is repeated for it."""
    left = large.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
    return left.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [*key, "_salt"]).drop("_salt")


def discovered(found: DataFrame, rounds: int = 3, support: int = 5, accept: float = 0.6, final: float = 0.75) -> DataFrame:
    """instance, kind (its place), score: what the contexts tell of instances of no rule. ``found``: as of ``with_contexts``, stored."""
    n_kinds = len(KINDS)
    seeds = [F.col("mask") == (1 << k) for k in range(n_kinds)]
    slots_ = found.where("instance <> ''").select("instance", "mask", "makes", "patterns").where(F.col("mask").isin(0, *[1 << k for k in range(n_kinds)]))
    pairs = store(slots_.withColumn("pattern", F.explode("patterns")).groupBy("pattern", "instance").agg(F.max("mask").alias("mask"), F.max("makes").alias("makes")), "pii-pairs")
    every = pairs.groupBy("instance").agg(F.max("mask").alias("mask")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(s).alias(f"n{k}") for k, s in enumerate(seeds)]).first()
    share = [every[f"n{k}"] / every.n if every.n else 0.0 for k in range(n_kinds)]
    could = lambda k: (F.col("mask") == 0) & (F.col("makes").bitwiseAND(1 << k) > 0)
    counts = [f(*a).alias(f"{name}{k}") for k in range(n_kinds) for name, f, a in (("s", F.count_if, [seeds[k]]), ("c", F.count_if, [seeds[k] | could(k)]))]
    graph = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("mask = 0 and makes > 0")).alias("open"), *counts)
    able = F.greatest(*[F.when(F.col(f"s{k}") < F.col(f"c{k}"), F.col(f"c{k}")).otherwise(0) for k in range(n_kinds)]) >= support
    graph = store(graph.where((F.col("open") > 0) & able).select("pattern", "n", *[f"s{k}" for k in range(n_kinds)]), "pii-patterns")
    loose = store(_met(pairs.where("mask = 0 and makes > 0").select("pattern", "instance", "makes"), graph.select("pattern"), ["pattern"], "instance"), "pii-loose")
    scored, made = None, []
    for _ in range(rounds):
        if scored is None:
            sums = graph.select("*", *[F.lit(0.0).alias(f"t{k}") for k in range(n_kinds)], *[F.lit(0).alias(f"u{k}") for k in range(n_kinds)])
        else:
            own = _met(loose, scored, ["instance"], "pattern")
            more = own.groupBy("pattern").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score"))).alias(f"t{k}") for k in range(n_kinds)], *[F.count_if((F.col("kind") == k) & (F.col("score") >= final)).alias(f"u{k}") for k in range(n_kinds)])
            sums = graph.join(more, "pattern", "left").na.fill(0)
        trust = [F.round((F.col(f"s{k}") + F.col(f"t{k}") - share[k] * F.col("n")) / ((1 - share[k]) * (F.col("n") + 1)), 9) if share[k] < 1 else F.lit(0.0) for k in range(n_kinds)]
        sure = [F.when((t >= accept) & (F.col(f"s{k}") + F.col(f"u{k}") >= support), t) for k, t in enumerate(trust)]
        each = F.filter(F.array(*[F.when(t.isNotNull(), F.struct(F.lit(k).alias("kind"), t.alias("trust"))) for k, t in enumerate(sure)]), lambda x: x.isNotNull())
        known = sums.select("pattern", F.inline(each))
        votes = _met(loose, known, ["pattern"], "instance").where(F.col("makes").bitwiseAND(F.expr("shiftleft(1, kind)")) > 0)
        heard = votes.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("trust", F.lit(0.999999)))))).alias("score"))
        best = heard.groupBy("instance").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("kind")).alias("k"))).alias("best"))
        scored = store(best.select("instance", (-F.col("best.k")).alias("kind"), F.col("best.score").alias("score")), "pii-scores")
        made.append(scored)
    discard(pairs, graph, loose, *made[:-1])
    return made[-1].where(F.col("score") >= final)


def _joined(spans: str | Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, base, spans (arrays of kind, start, end in code points, end exclusive, sorted): a row per row of ``df``."""
    found = store(with_contexts(slots(need(df, doc_id, text).toDF("doc_id", "text"))), "pii-slots")
    new = discovered(found, **options)
    span = F.struct(F.col("kind"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    added = _met(found.where("mask = 0 and makes > 0").select("row", "instance", "start", "end"), new.select("instance", "kind"), ["instance"], "row")
    added = added.groupBy("row").agg(F.collect_list(span).alias("added"))
    base = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.flatten(F.collect_list("base"))).alias("base"))
    none = F.slice(F.col("base"), 1, 0)
    return base.join(added, "row", "left").select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the rules), base_sha256, spans (all, as text)."""
    n = [F.size(of_kind("base", k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *n, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
