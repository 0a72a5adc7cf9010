"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Where the session names no such folder, a temporary one is set for a session on one machine; on
    a cluster, whose machines don't share it, that is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="barframe-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage, so what was computed survives the loss of the executors that computed it.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    schema = df.schema
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of what is written now
    return spark.read.schema(schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
