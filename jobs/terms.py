"""Streaming job: a catalogue of how often features are found in the samples of each source, kept up as samples arrive.

    python -m jobs.terms --documents DIR --output DIR --checkpoint DIR [--config FILE]

A text is a sample and its words (runs of other characters than blanks, A-Z lower-cased) are its features. For each source and feature,
the catalogue has the number of samples that have it, of its occurrences, the share of samples that have it and the share that have not;
features of fewer than ``least`` samples are left out, as noise. A run takes the files that are new since the checkpoint, at most ``files`` in one
batch, and ends.

``output`` gets three Parquet tables. A batch writes what it counted to its own partitions of ``counts`` and ``samples`` (by source and
batch), then makes the ``catalogue`` of the sources it met anew from these, and overwrites their partitions. So a batch that is run
again, after a failure, leaves the same rows, and a run without new files changes nothing. Output and checkpoint belong together. The
partition ``part`` is ``s_`` and the source, or ``none`` where that is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.base import LOG, command_line, defaults_of, own_folder
from spectrel.operators import peaks

BLANKS = r"[\x20\x09-\x0D]+"
SPREAD = 8
#: The three tables.
SAMPLES = "n long, part string, batch long"
COUNTS = "source string, feature string, n_samples long, n_found long, part string, batch long"
CATALOGUE = "source string, feature string, n_samples long, n_found long, occupancy double, sparsity double, part string"


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, source, feature, n_samples, n_found) and (part, n). Equal words of a text are neighbours once sorted, so the first of each is known without a shuffle."""
    docs = docs.select("source", F.coalesce(F.concat(F.lit("s_"), "source"), F.lit("none")).alias("part"), F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("text"))
    docs = docs.withColumn("mzs", F.array_sort(F.filter(F.split("text", BLANKS), lambda w: w != "")))
    first = F.transform("mzs", lambda w, i: F.when((i > 0) & (F.get("mzs", i - 1) == w), 0).otherwise(1))
    words = peaks.explode(docs.select("part", "source", "mzs", first.alias("intensities"))).where("mz is not null")
    found = words.groupBy("part", "source", F.col("mz").alias("feature")).agg(F.sum("intensity").alias("n_samples"), F.count(F.lit(1)).alias("n_found"))
    return found, docs.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def _put(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite the partitions that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def catalogue(spark: SparkSession, output: str, least: int, batch: int) -> DataFrame:
    """Of the sources that ``batch`` met, from all batches."""
    samples = spark.read.schema(SAMPLES).parquet(f"{output}/samples")
    met = samples.where(F.col("batch") == batch).select("part")
    n = samples.join(met, "part", "left_semi").groupBy("part").agg(F.sum("n").alias("n"))
    found = spark.read.schema(COUNTS).parquet(f"{output}/counts").join(met, "part", "left_semi")
    found = found.groupBy("part", "source", "feature").agg(F.sum("n_samples").alias("n_samples"), F.sum("n_found").alias("n_found")).where(F.col("n_samples") >= least)
    share = F.col("n_samples") / F.col("n")
    return found.join(n, "part").select("part", "source", "feature", "n_samples", "n_found", share.alias("occupancy"), (1 - share).alias("sparsity"))


def take(docs: DataFrame, batch: int, output: str, least: int) -> int:
    """One batch: its counts, then the catalogue of the sources it met. Gives its number of samples."""
    spark = docs.sparkSession
    words, samples = counted(docs)
    spread = F.pmod(F.xxhash64("feature"), F.lit(SPREAD))
    _put(words.withColumn("batch", F.lit(batch)).repartition("part", spread), f"{output}/counts", "part", "batch")
    _put(samples.withColumn("batch", F.lit(batch)).coalesce(1), f"{output}/samples", "part", "batch")
    new = spark.read.schema(SAMPLES).parquet(f"{output}/samples").where(F.col("batch") == batch).agg(F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    LOG.info("batch %d: read %d samples of %d sources", batch, new.n, new.parts)
    _put(catalogue(spark, output, least, batch).repartition("part", spread), f"{output}/catalogue", "part")
    LOG.info("batch %d: the catalogue has %d rows", batch, spark.read.schema(CATALOGUE).parquet(f"{output}/catalogue").count())
    return new.n


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> int:
    """Take what is new of a Parquet file, a folder of them or a glob; the number of samples that were read."""
    config, documents = config or defaults_of("terms"), documents.rstrip("/")
    schema = spark.read.parquet(documents).select("text", "source").schema
    # A stream of files takes a plain path for a folder; a glob, which may name a file too, is the same path with its last letter as a set.
    at = documents if any(c in documents for c in "*?[{") else f"{documents[:-1]}[{documents[-1]}]"
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files"]).parquet(at)
    taken: list[int] = []
    started = new.writeStream.foreachBatch(lambda docs, batch: taken.append(take(docs, batch, output, config["least"])))
    started.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    LOG.info("read %d new samples of %s in %d batches", sum(taken), documents, len(taken))
    return sum(taken)


def result(spark: SparkSession, output: str) -> DataFrame:
    rows = spark.read.schema(CATALOGUE).parquet(f"{output}/catalogue")
    return rows.select("source", "feature", "n_samples", "n_found", F.round("occupancy", 9).alias("occupancy"), F.round("sparsity", 9).alias("sparsity"))


def job2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = own_folder(spark, "terms")
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output", f"{folder}/checkpoint")
    return result(spark, f"{folder}/output")


SQL = r"""
with d as (select row_number() over () as row, source, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
n as (select source, count(*) as n from d group by source),
f as (select row, source, feature, count(*) as k from (select row, source, unnest(w) as feature from d) group by all),
c as (select source, feature, count(*) as n_samples, sum(k) as n_found from f group by all having count(*) >= 2)
select c.source, feature, n_samples, cast(n_found as bigint) as n_found, round(n_samples / n, 9) as occupancy, round(1 - n_samples / n, 9) as sparsity
from c join n on n.source is not distinct from c.source
"""

if __name__ == "__main__":
    command_line(__doc__, "terms", {"documents": "folder of Parquet files", "output": "folder of the tables", "checkpoint": "folder of the stream's checkpoint"}, run)
