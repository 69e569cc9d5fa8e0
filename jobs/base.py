"""What the jobs share: their command line, configuration, log and folders."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from spectrel.runtime import shared_folder

LOG = logging.getLogger("spectrel.jobs")


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults, with what the JSON file at ``path`` says instead; a name that the job does not know is an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def defaults_of(job: str) -> dict:
    """The settings that are shipped beside the job."""
    return json.loads(Path(__file__).with_name(f"{job}.json").read_text())


def own_folder(spark: SparkSession, job: str) -> str:
    """A new folder in ``spark.checkpoint.dir`` that no other call uses."""
    return f"{shared_folder(spark).rstrip('/')}/spectrel/jobs/{job}-{uuid.uuid4().hex}"


def command_line(text: str, job: str, paths: dict[str, str], run: Callable[..., object]) -> None:
    """Parse the paths, start a session, run the job, stop the session."""
    parser = argparse.ArgumentParser(description=text.partition("\n")[0])
    for name, said in paths.items():
        parser.add_argument(f"--{name}", required=True, help=said)
    parser.add_argument("--config", help=f"JSON of settings that differ from jobs/{job}.json")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(f"spectrel-{job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        config = settings(spark, given.pop("config"), defaults_of(job))
        run(spark, **given, config=config)
    finally:
        spark.stop()
