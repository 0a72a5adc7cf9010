"""Paths in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder serves a session on one machine; on a cluster,
    whose machines don't share it, that is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/barframe-{name}-{uuid.uuid4().hex}"
