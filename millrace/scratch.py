"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode, where it is unset, a temporary one.

    A cluster without that setting is refused: executors could not see each other's files.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "millrace-scratch")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: later plans start from the table, whatever executors are lost.

    With ``folder`` (a path from ``new_path``) the table lies below it, and goes when the caller removes that folder.
    """
    spark = df.sparkSession
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
