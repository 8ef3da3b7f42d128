"""What the jobs share: their command line, their settings, folders of registered runs, logs."""

from __future__ import annotations

import argparse
import logging
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from raretide.sources import configs

LOG = logging.getLogger("jobs")


def settings(spark: SparkSession, path: str, schema: str) -> dict:
    """The one JSON object in the file at path, read by Spark; fields outside the schema end the job, null ones are left out."""
    text = spark.read.text(path, wholetext=True)
    row = configs.strict(configs.records(text, "value", schema)).select("record.*").first()
    return {k: v for k, v in row.asDict().items() if v is not None}


def main(run: Callable, schema: str, paths: tuple[str, ...], describe: str) -> None:
    """The command line: one option for each path, and --config. Starts the session and stops it."""
    parser = argparse.ArgumentParser(description=describe)
    for name in (*paths, "config"):
        parser.add_argument(f"--{name.replace('_', '-')}", required=True)
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, **{p: args[p] for p in paths}, **settings(spark, args["config"], schema))
    finally:
        spark.stop()


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that the session names; under /tmp only where none is named, in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file:///tmp/jobs-{spark.sparkContext.applicationId}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
