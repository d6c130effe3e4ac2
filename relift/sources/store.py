"""The folder that driver and executors share, for what is read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir``, or the session's checkpoint folder; None if neither is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = None if found.isEmpty() else found.get()
    return at.rstrip("/") if at else None


def file_system(spark: SparkSession, path: str):
    """(the path's file system, the path) as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    files, at = file_system(spark, path)
    files.delete(at, True)


def new_path(spark: SparkSession, what: str) -> str | None:
    """A path in the shared folder that nothing has yet."""
    folder = shared_folder(spark)
    return f"{folder}/relift-{what}-{uuid.uuid4().hex}" if folder else None


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
