"""Quality rules: base counts and robust multivariate outliers. DataFrame functions only.

A document's statistics (``STATS``: marks, capitals and short words a word, log mean word length) are taken about the
medians of its group and multiplied by the root of its number of words (``WEIGHT_WORDS`` at most), as the spread of a share falls
with that root. These vectors, as whole numbers, are compared with a minimum-covariance-determinant estimate of the group, and
rejected by Mahalanobis distance. Groups are language and source; a group of fewer than ``min_group`` documents takes the
language's estimate, and a language of fewer that of all. Documents that fail the base rule teach the estimates nothing.

The estimate is that of fast MCD. Each group has ``STARTS`` starts: the medians with an equal spread, mean and covariance of all,
and mean and covariance of six rows each that are drawn by a hash of their values. Every start takes concentration steps
(distances of the group's rows, mean and covariance of the nearest half) until it comes to rest, ``max_steps`` at most. The
smallest determinant wins, and is reweighted once: mean and covariance of the rows within the 0.975 quantile. Covariances get the
consistency factor of the normal distribution. ``RIDGE`` is added to each standard deviation's square, one hundredth of the
variance that a share of one in ten has, so that a group of copies has a distance too.

Distances are dealt into bins of 1/256 in the log of 1 + d2, and the bin in which the half ends counts in part. So a step
aggregates bins before the shuffle, and a hot group costs a task no more than any other: rows are neither sorted nor moved by
group. Sums are sums of whole numbers, so results do not depend on the order of rows.

Equality of three-word windows inside a document is that of 64-bit hashes.

Defined cases: null and empty texts have no words and fail the base rule; a null language or source is a group value of
its own; repeated rows count each and get equal verdicts; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrel.llm.base import discard, need, store

#: Words are runs of other characters.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CAPITALS = r"[A-ZÀ-ÖØ-Þ]"
#: In thousandths. Short words have three characters at most.
STATS = {
    "s1": "n_marks * 1.0 / n_words",
    "s2": "n_capitals * 1.0 / n_words",
    "s3": "ln(word_chars * 1.0 / n_words)",
    "s4": "n_short * 1.0 / n_words",
}
P = len(STATS)
VALUES = [f"z{i}" for i in range(1, P + 1)]
PAIRS = [(i, j) for i in range(1, P + 1) for j in range(1, i + 1)]
FACTOR = [f"l{i}{j}" for i, j in PAIRS]
ESTIMATE = [*[f"m{i}" for i in range(1, P + 1)], *FACTOR]
WEIGHT_WORDS, MOST = 2500, 16000
RIDGE = 30.0
STARTS, DRAWN = 5, 6
#: A start has come to rest when the log of its determinant changes by no more.
STILL = 0.005
#: Of the starts without a covariance of many rows, added to each variance.
START_SPREAD, DRAWN_SPREAD = 400.0, 100.0
BINS = 256
#: alpha / F(chi2 with p + 2 degrees <= the alpha quantile of chi2 with p degrees), p = 4, for alpha 1/2 and 0.975.
CONSISTENCY, WITHIN_CONSISTENCY = 2.109, 1.0645
#: Of the squared distance: the 0.975 and 0.9999 quantiles of chi2 with four degrees.
WITHIN, CUTOFF = 11.143, 23.51
#: Estimates of a few hundred bytes that may be sent to every task.
SENT_ROWS = 50_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def base_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """doc_id, the columns of ``keep``, n_words, word_chars, n_symbols, n_marks, n_capitals, n_short, n_dup_lines, n_repeat_words. Narrow."""
    df = need(df, doc_id, text, *keep).withColumn(text, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_w", words(F.col(text))).withColumn("_n", F.size("_w"))
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    window = F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    df = df.withColumn("_h", F.when(F.col("_n") >= 3, window).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(some, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, k: F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_d", F.array_sort(F.filter(F.transform("_s", lambda x, k: F.when(same(x, k), x["i"])), lambda i: i.isNotNull())))
    # A window's words count up to the start of the next marked window, three at most.
    gaps = F.transform("_d", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_d", k + 1) - i, F.lit(3))))
    long = lambda c: c.cast("long")
    without = lambda chars: F.length(F.translate(F.col(text), chars, ""))
    counts = F.struct(
        F.col(doc_id).alias(doc_id), *[F.col(c).alias(c) for c in keep], long(F.col("_n")).alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        long(F.length(text) - without(SYMBOLS)).alias("n_symbols"),
        long(F.length(text) - without(MARKS)).alias("n_marks"),
        long(F.length(text) - F.length(F.regexp_replace(text, CAPITALS, ""))).alias("n_capitals"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, x: a + F.when(F.length(x) <= 3, 1).otherwise(0)).alias("n_short"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
    )
    # The generator keeps later filters from being pushed into the expressions above, where they would be made again for each word.
    return df.select(F.inline(F.array(counts)))


def _with(df: DataFrame, steps) -> DataFrame:
    """Adds the columns in one projection; each may use those before it."""
    return df.selectExpr("*", *[f"{sql} as {name}" for name, sql in steps])


def cholesky() -> list[tuple[str, str]]:
    """The lower factor l of c, one entry after the other, and the log of c's determinant."""
    out = []
    for j in range(1, P + 1):
        inner = "".join(f" - l{j}{k} * l{j}{k}" for k in range(1, j))
        out.append((f"l{j}{j}", f"sqrt(c{j}{j}{inner})"))
        for i in range(j + 1, P + 1):
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
            out.append((f"l{i}{j}", f"(c{i}{j}{inner}) / l{j}{j}"))
    return [*out, ("logdet", " + ".join(f"2 * ln(l{i}{i})" for i in range(1, P + 1)))]


def distance() -> list[tuple[str, str]]:
    """Forward substitution: y = l^-1 (z - m); then d2."""
    out = [(f"y{i}", f"(z{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(1, i)) + f") / l{i}{i}") for i in range(1, P + 1)]
    return [*out, ("d2", " + ".join(f"y{i} * y{i}" for i in range(1, P + 1)))]


def moments(factor: float, spread: float = RIDGE) -> list[tuple[str, str]]:
    """Mean and covariance from n and the sums t1.., t11.."""
    out = [(f"m{i}", f"t{i} / n") for i in range(1, P + 1)]
    return [*out, *[(f"c{i}{j}", f"{factor}D * (t{i}{j} / n - m{i} * m{j})" + (f" + {spread**2}D" if i == j else "")) for i, j in PAIRS]]


def sums(weight: str = "1") -> dict[str, str]:
    """Sums of the values and their products, as SQL over z1.."""
    one = {f"t{i}": f"z{i}" for i in range(1, P + 1)} | {f"t{i}{j}": f"z{i} * z{j}" for i, j in PAIRS}
    return {name: f"sum({e})" if weight == "1" else f"sum(case when {weight} then {e} end)" for name, e in one.items()}


GROUP = ["level", "g_lang", "g_source"]


def _sent(small: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast a stored table of estimates if it has ``SENT_ROWS`` at most; a larger one is joined by a shuffle, whose hot keys are split."""
    return F.broadcast(small) if (small.count() if rows is None else rows) <= SENT_ROWS else small


def memberships(stats: DataFrame, min_group: int) -> DataFrame:
    """k_lang, k_source, holds (the group whose estimate they take), teaches (the groups whose estimates they take part in).

    A language teaches its own group only if one of its sources is too small, and that of all only if some language is.
    """
    group = lambda level, lang="", source="": F.struct(F.lit(level).alias("level"), (F.col(lang) if lang else F.lit("")).alias("g_lang"), (F.col(source) if source else F.lit("")).alias("g_source"))
    counts = store(stats.groupBy("k_lang", "k_source").agg(F.count_if(~F.col("base_failed")).alias("n2")), "rules-counts")
    langs = counts.groupBy("k_lang").agg(F.sum("n2").alias("n1"), F.min("n2").alias("least"))
    some_small = not langs.where(F.col("n1") < min_group).isEmpty()
    wide = counts.join(langs, "k_lang")
    own, lang, every = group(2, "k_lang", "k_source"), group(1, "k_lang"), group(0)
    holds = F.when(F.col("n2") >= min_group, own).when(F.col("n1") >= min_group, lang).otherwise(every)
    teaches = F.filter(F.array(F.when(F.col("n2") >= min_group, own), F.when((F.col("least") < min_group) & (F.col("n1") >= min_group), lang), F.when(F.lit(some_small), every)), lambda g: g.isNotNull())
    out = store(wide.select("k_lang", "k_source", holds.alias("holds"), teaches.alias("teaches")).coalesce(1 + counts.count() // SENT_ROWS), "rules-groups")
    discard(counts)
    return out


def values() -> list[tuple[str, str]]:
    """z1.. from s1.., n_words and the group's medians a1.."""
    root = f"sqrt(cast(least(n_words, {WEIGHT_WORDS}) as double))"
    return [(f"z{i}", f"cast(greatest(-{MOST}.0D, least({MOST}.0D, floor({root} * (s{i} - a{i}) + 0.5D))) as bigint)") for i in range(1, P + 1)]


def _starts(rows: DataFrame) -> DataFrame:
    """GROUP, start, n_docs and the estimates to start from."""
    # Products of 2^14 by 2^45 at most, so nothing overflows.
    mixed = lambda k: f"pmod(pmod(z1 * 17046029254387L + z2 * 11817834972767L + z3 * 26858216577363L + z4 * 23546855649369L + {k} * 18658112351221L, 2147483647L) * {48271 + 2 * k}L + {k}, 2147483647L)"
    draws = [F.expr(f"min(struct({mixed(k)} as h, {', '.join(VALUES)}))").alias(f"p{k}") for k in range((STARTS - 2) * DRAWN)]
    found = rows.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n_docs"), *[F.expr(e).cast("double").alias(t) for t, e in sums().items()], *draws)
    middle = [("m" + str(i), "0D") for i in range(1, P + 1)] + [(f"c{i}{j}", f"{START_SPREAD**2 if i == j else 0.0}D") for i, j in PAIRS]
    whole = moments(1.0)
    plans = [[("n", "cast(n_docs as double)")] + middle, [("n", "cast(n_docs as double)")] + whole]
    for s in range(STARTS - 2):
        picks = [f"p{k}" for k in range(s * DRAWN, (s + 1) * DRAWN)]
        drawn = [(f"t{i}", "cast(" + " + ".join(f"{p}.z{i}" for p in picks) + " as double)") for i in range(1, P + 1)]
        drawn += [(f"t{i}{j}", "cast(" + " + ".join(f"{p}.z{i} * {p}.z{j}" for p in picks) + " as double)") for i, j in PAIRS]
        plans.append([("n", f"{DRAWN}.0D"), *drawn, *moments(1.0, DRAWN_SPREAD)])
    found, out = store(found.coalesce(8), "rules-sums"), None
    for s, steps in enumerate(plans):
        one = _with(found.withColumn("start", F.lit(s)), [*steps, *cholesky()]).select(*GROUP, "start", "n_docs", *ESTIMATE, "logdet")
        out = one if out is None else out.unionByName(one)
    return out


def _step(rows: DataFrame, found: DataFrame, n_found: int) -> DataFrame:
    """A concentration step of the estimates of ``found``; ``moved`` tells whether one is not at rest."""
    key = [*GROUP, "start"]
    placed = _with(rows.join(_sent(found, n_found), GROUP), distance()).withColumn("bin", F.expr(f"cast(floor(ln(1.0D + d2) * {BINS}) as int)"))
    # Ends in one value for each bin: nothing but partial sums is shuffled.
    bins = placed.groupBy(*key, "n_docs", "bin").agg(F.count(F.lit(1)).alias("k"), *[F.expr(e).alias(t) for t, e in sums().items()])
    before = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).withColumn("half", F.expr(f"least(n_docs, floor((n_docs + {P + 1}) / 2))"))
    inner, edge = "before + k <= half", "before < half and before + k > half"
    share = F.expr(f"coalesce(max(case when {edge} then (half - before) / cast(k as double) end), 0D)").alias("share")
    parts = [F.expr(f"cast(coalesce(sum(case when {inner} then {t} end), 0) as double)").alias(f"in_{t}") for t in sums()] + [F.expr(f"cast(coalesce(max(case when {edge} then {t} end), 0) as double)").alias(f"at_{t}") for t in sums()]
    total = bins.groupBy(*key, "n_docs").agg(F.max("half").cast("double").alias("n"), share, *parts)
    total = _with(total, [(t, f"in_{t} + share * at_{t}") for t in sums()])
    new = _with(total, [*moments(CONSISTENCY), *cholesky()]).select(*key, "n_docs", *ESTIMATE, "logdet")
    old = found.select(*key, F.col("logdet").alias("old_logdet"))
    return new.join(old, key).select(*key, "n_docs", *ESTIMATE, "logdet", F.expr(f"abs(logdet - old_logdet) > {STILL}D").alias("moved"))


def estimate(stats: DataFrame, member: DataFrame, max_steps: int = 20, starts: int = STARTS, reweight: bool = True) -> DataFrame:
    """GROUP, a.. (medians), m.., l..: the estimate of each group. ``stats``: k_lang, k_source, n_words, s1.."""
    rows = stats.join(_sent(member.select("k_lang", "k_source", "teaches")), ["k_lang", "k_source"]).select(F.explode("teaches").alias("g"), "n_words", *STATS).select("g.*", "n_words", *STATS)
    medians = store(rows.groupBy(GROUP).agg(*[F.percentile(s, F.lit(0.5)).alias(f"a{i}") for i, s in enumerate(STATS, 1)]).coalesce(8), "rules-medians")
    rows = store(_with(rows.join(_sent(medians), GROUP), values()).select(*GROUP, *VALUES), "rules-rows")
    start = _starts(rows).where(F.col("start") < starts)
    steps = [store(start.withColumn("moved", F.lit(True)).coalesce(8), "rules-step")]
    while len(steps) <= max_steps and (n_moving := (moving := steps[-1].where("moved")).count()):
        steps.append(store(_step(rows, moving.drop("moved"), n_moving).coalesce(8), "rules-step"))
    found = steps[-1].drop("moved")
    for step in steps[:-1]:
        found = found.unionByName(step.where("not moved").drop("moved"))
    first = Window.partitionBy(GROUP).orderBy("logdet", "start")
    found = found.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "logdet")
    if reweight:
        best = store(found.coalesce(8), "rules-best")
        near = _with(rows.join(_sent(best), GROUP), distance()).where(F.col("d2") <= WITHIN)
        found = near.groupBy(GROUP).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.expr(e).cast("double").alias(t) for t, e in sums().items()])
        found = _with(found, [*moments(WITHIN_CONSISTENCY), *cholesky()])
    out = store(found.join(medians, GROUP).select(*GROUP, *[f"a{i}" for i in range(1, P + 1)], *ESTIMATE).coalesce(8), "rules-estimate")
    discard(rows, medians, *steps)
    return out


def with_stats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", *keep: str) -> DataFrame:
    """Base counts, base_failed, the group's names k_lang and k_source, and the statistics in thousandths. Narrow."""
    df = df.withColumn("k_lang", F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("null"))).withColumn("k_source", F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null")))
    stats = base_counts(df, doc_id, text, "k_lang", "k_source", *keep)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return _with(stats.withColumn("base_failed", failed), [(s, f"case when n_words > 0 then cast(floor(1000.0D * ({e}) + 0.5D) as bigint) else 0 end") for s, e in STATS.items()])


def groups(stats: DataFrame, min_group: int, **options) -> DataFrame:
    """The estimate that holds for each language and source. A row per group."""
    member = memberships(stats, min_group)
    found = estimate(stats.where("not base_failed"), member, **options)
    joined = member.select("k_lang", "k_source", "holds.*").join(found, GROUP)
    out = store(joined.select("k_lang", "k_source", *[f"a{i}" for i in range(1, P + 1)], *ESTIMATE).coalesce(8), "rules-groups")
    discard(member, found)
    return out


def verdict(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds d2 (null without words, or if no document of the group passes the base rule) and kept."""
    joined = _with(stats.join(_sent(estimates), ["k_lang", "k_source"], "left"), [*values(), *distance()])
    d2 = F.when(F.col("n_words") > 0, F.col("d2"))
    return joined.withColumn("d2", d2).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(False)))


def judge(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", min_group: int = 200, **options) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept: a row per document."""
    df = need(df, doc_id, text, lang, source).toDF("doc_id", "text", "lang", "source")
    stats = store(with_stats(df), "rules-stats")
    return verdict(stats, groups(stats, min_group, **options)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept")


def keep(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_group: int = 200, **options) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns. The statistics are made again beside the texts, so texts need no join by id."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    stats = store(with_stats(rows.withColumn("doc_id", F.lit(0))).select("k_lang", "k_source", "n_words", "base_failed", *STATS), "rules-stats")
    found = groups(stats, min_group, **options)
    discard(stats)
    return verdict(with_stats(rows.withColumn("doc_id", F.lit(0)), "doc_id", "text", "lang", "source", "row"), found).where("kept").select("row.*")
