"""Folders of written tables, through the file system that Spark uses for them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _open(spark, path)
    return system.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, in order; none if there is no such folder."""
    system, place = _open(spark, path)
    if not system.exists(place):
        return []
    return sorted(entry.getPath().getName() for entry in system.listStatus(place))


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a folder."""
    system, place = _open(spark, path)
    return system.getContentSummary(place).getLength() if system.exists(place) else 0


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all that lies below it."""
    system, place = _open(spark, path)
    system.delete(place, True)


def rename(spark: SparkSession, path: str, name: str) -> None:
    """Give a folder its final name."""
    system, place = _open(spark, path)
    if not system.rename(place, spark._jvm.org.apache.hadoop.fs.Path(name)):
        raise OSError(f"{path} could not be renamed to {name}")


def complete(spark: SparkSession, path: str) -> bool:
    """A table whose writing job has ended."""
    return exists(spark, f"{path}/_SUCCESS")
