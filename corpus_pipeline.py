"""The corpus pipeline: classifier, rules, near duplicates, packing. Each stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.llm import jaccard, packing, quality, rules
from spectrel.llm.base import discard, store, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade (well-formed and not toxic) is one half or more.

    Null and empty texts are judged by the thresholds alone; without ratings all stay; repeated rows share their verdict.
    """
    docs = docs.select(COLUMNS)
    model = quality.fit(docs, quality.grades_of(table(spark, sf_dir, "labels")), n_grades=3)
    return quality.predict(docs, model, select_grade=2).where("kept").select(COLUMNS)


def keep_regular(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no robust outlier of their language and source.

    Null and empty texts fail the base rule. The verdict rides along with its row, so repeated ids need no join.
    """
    return rules.keep(docs.select(COLUMNS))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingles at a similarity of 0.8: the one with the smallest id, null last.

    Documents without words stay. Only rows that agree in both id and text count as one document: where an id is null or
    repeated, the join gets row numbers of a stored copy instead of ids, so rows with other texts are told apart.
    """
    docs = docs.select(COLUMNS)
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        classes, _ = jaccard.join(docs, n=5, num=80, den=100)
        stay = classes.where("doc_id = component_id").select(F.col("doc_id").alias("_stay"))
        return docs.join(stay, F.col("doc_id") == F.col("_stay"), "left_semi")
    docs = store(docs.withColumn("_row", F.monotonically_increasing_id()), "distinct-rows")
    classes, _ = jaccard.join(docs, n=5, num=80, den=100, doc_id="_row")
    # Texts without words alone are needed beside the ids, so that no other text is shuffled.
    blank = F.when(~F.col("text").rlike(r"[^\x09-\x0d ]"), F.col("text")).alias("_blank")
    classes = classes.select(F.col("doc_id").alias("_row"), "component_id", (F.col("n_shingles") > 0).alias("_words"))
    found = docs.select("_row", "doc_id", blank).join(classes, "_row")
    alone = [F.when(~F.col("_words"), F.col(c)) for c in ("doc_id", "_blank")]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"]
    stay = found.groupBy(F.when(F.col("_words"), F.col("component_id")), *alone).agg(first.alias("_stay")).select("_stay")
    return docs.join(stay, F.col("_row") == F.col("_stay"), "left_semi").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths of what is left. A null text is one piece, the end token."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, max_len=2048)


STAGES = [("quality_classifier", keep_good), ("quality_rules", keep_regular), ("jaccard_join", keep_distinct), ("packing", pack)]
#: The classifier and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
        discard(*held)  # what this stage was made of
        held = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
