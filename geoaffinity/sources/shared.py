"""Folders that the driver and all executors share, for tables an analysis writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder's path below the one that spark.checkpoint.dir names; removed when the session ends.

    Where nothing is named, which only a local master may do, it lies below a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    named = named or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="geoaffinity-")
    path = f"{named.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    file_system(spark, path).deleteOnExit(hadoop_path(spark, path))
    return path


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written, with what it holds."""
    file_system(spark, path).delete(hadoop_path(spark, path), True)
