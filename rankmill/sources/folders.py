"""Folders of the shared store, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished folders directly below ``path``: those that hold Spark's success mark."""
    system, at = _place(spark, path)
    if not system.exists(at):
        return []
    held = [s.getPath() for s in system.listStatus(at) if s.isDirectory()]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(p.getName() for p in held if system.exists(hadoop(p, "_SUCCESS")))


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _place(spark, path)
    return system.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    system, at = _place(spark, path)
    return system.getFileStatus(at).isDirectory()


def drop_folder(spark: SparkSession, path: str) -> None:
    system, at = _place(spark, path)
    system.delete(at, True)
