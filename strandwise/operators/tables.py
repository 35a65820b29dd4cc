"""Intermediate tables, and folders in the file system that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the one that the cluster shares (spark.checkpoint.dir); a local session may leave that unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = folder or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the shared folder."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _path(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        at, files = _path(spark, path)
        files.delete(at, True)


def removed(*tables: DataFrame) -> None:
    """Delete the files of tables that written() made and that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, sorted({file.rsplit("/", 1)[0] for file in df.inputFiles()}))
