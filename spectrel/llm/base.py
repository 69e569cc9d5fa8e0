"""What the training-data operators share: the shared folder, tables, folds and column checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.runtime import shared_folder, ship

#: Rows in one Arrow batch. Texts can be long, so that batches are kept far below Spark's default of 10,000 rows.
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on ``local[*]`` a temporary one where that is unset."""
    return shared_folder(spark).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/spectrel/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete the tables of ``store`` from which nothing will be read any more: what was made of them is written already."""
    for df in stored:
        spark, path = df.sparkSession, df._stored_at
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in whatever store Spark reads it from."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, and see that the workers have this package. The batch size is the session's and stays lowered,
    as plans read it when they run; results do not depend on it."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; a missing one is an error that names it."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def texts_of(column: Iterable) -> list[str]:
    """Python strings of an Arrow column, null as the empty string."""
    return [x or "" for x in column.to_pylist()]
