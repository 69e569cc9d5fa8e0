"""Getting the package to the executors, and Arrow batch sizes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers once per application, as one archive."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="spectrel-"), "spectrel_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Unset, it is a temporary folder on ``local[*]`` and an error elsewhere, as executors don't share theirs."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), f"spectrel-{os.getpid()}")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def settled(df):
    """Materialise in the shared checkpoint folder: rows keep their partitions, lineage is cut, lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df):
    """As ``settled``, by a Parquet table in the shared folder. For rounds that build on each other: what Spark knows of a checkpoint's
    columns goes on from plan to plan and makes these slower to optimise, whereas a table starts anew, with its true size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/spectrel/{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
