"""The folder that all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Used only where a session in local mode names no shared folder, as in tests.
LOCAL_FOLDER = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_FOLDER).rstrip("/")
