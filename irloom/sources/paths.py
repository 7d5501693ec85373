"""Folders of the shared file system, through Spark's own Hadoop configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none where it is missing."""
    fs, at = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, folder: str) -> None:
    fs, at = _at(spark, folder)
    fs.delete(at, True)
