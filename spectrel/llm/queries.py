"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.llm import bpe, chat, fingerprint, jaccard, langid, lm, packing, pii, pii_sql, quality, repair, repair_sql, rules, rules_sql, token_counts
from spectrel.llm.base import fold, fresh_path, need, table


CACHE_AT = "spark.spectrel.tokenCounts.cache"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(need(table(spark, sf_dir, "documents"), "doc_id", "text"), path, pattern).select("doc_id", "ids")
    both = bpe.decode(ids, path, pattern)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, max_len=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache lasts where the session names a folder for it in ``CACHE_AT``; else it is a new one, so that every text is counted."""
    cache = spark.conf.get(CACHE_AT, None) or fresh_path(spark, "token-counts")
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    turns = need(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    read = chat.read_back(chat.format_trees(chat.chain(turns.unionByName(extra)), top_k=1, no_repeats=True))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, length(replace(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;')) as coded from t
), g as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss, sum(coded + 14) as chars
  from e group by conv_id
)
select conv_id, cast(n_turns as bigint) as n_turns, sha256(said) as turns_sha256, cast(length(loss) as bigint) as loss_chars,
  sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars
from g
"""


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).drop("d2")


OP6_SQL = rules_sql.op6()


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = quality.fit(docs, quality.grades_of(table(spark, sf_dir, "labels")), n_grades=3)
    return quality.predict(docs, model, select_grade=2).select("doc_id", "expected_grade", "tail_probability", "kept")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    held_out = fold("doc_id", 3) == 1
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model, "doc_id", held_out.alias("held_out"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = fingerprint.with_next(fingerprint.fingerprint(docs), keys=docs, size=F.octet_length("text") + 2000)
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), chars - half), F.col("next_text").substr(F.lit(1), half))
    rows = rows.select("doc_id", chars.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    near = ("fingerprint", "edited_fingerprint", "near_edited"), ("fingerprint", "next_fingerprint", "near_next")
    rows = fingerprint.fingerprint(rows, "edited", "edited_fingerprint", *near).withColumn("edited_sha256", F.sha2("edited", 256))
    return rows.select("doc_id", "n_chars", "edited_sha256", F.hex("fingerprint").alias("fingerprint"), F.hex("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = jaccard.join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return classes.select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
with recursive w as materialized (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as materialized (
  select distinct doc_id, sh from (
    select doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as sh from w where len(w) >= 3
    union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 2)
), n as materialized (select doc_id, count(*) as n from s group by doc_id),
rare as materialized (
  -- The shingles of a set by rarity: similar sets share one among the first n - ceil(0.9 n) + 1.
  select doc_id, sh from (
    select s.doc_id, s.sh, n.n, row_number() over (partition by s.doc_id order by f.f, s.sh) as r
    from s join n using (doc_id) join (select sh, count(*) as f from s group by sh) f using (sh)) where r <= n - cast(ceil(0.9 * n) as bigint) + 1
), c as materialized (select distinct a.doc_id as a, b.doc_id as b from rare a join rare b on a.sh = b.sh and a.doc_id < b.doc_id),
p as materialized (
  select a, b from (select c.a, c.b, count(*) as k from c join s x on x.doc_id = c.a join s y on y.doc_id = c.b and x.sh = y.sh group by c.a, c.b)
  join n u on u.doc_id = a join n v on v.doc_id = b where 100 * k >= 90 * (u.n + v.n - k)
), e as materialized (select a, b from p union all select b, a from p),
t(doc_id, m) as (select doc_id, doc_id from documents union select t.doc_id, e.b from t join e on e.a = t.m)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, min(t.m) as component_id
from documents d left join n on n.doc_id = d.doc_id join t on t.doc_id = d.doc_id group by all
"""


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(need(table(spark, sf_dir, "documents"), "doc_id", "text"), fold("doc_id", 7) == 2)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the rules, as the digest is; ``spans`` has the spans of the contexts too."""
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.repair(repair.damage(table(spark, sf_dir, "conversations")), present="present")
    said = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_packing, op3_token_counts, op4_quality, op5_language, op6_rules, op7_chat, op8_lm, op9_fingerprints, op10_jaccard, op11_pii, op12_repair)}
SQL = {"op6_rules": OP6_SQL, "op7_chat": OP7_SQL, "op10_jaccard": OP10_SQL, "op11_pii": pii_sql.op11(), "op12_repair": repair_sql.op12()}
