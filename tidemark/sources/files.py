"""Small files and folders of the shared store, through the file system that Spark itself uses for a path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def exists(spark: SparkSession, path: str) -> bool:
    place, system, _ = _at(spark, path)
    return system.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where it doesn't exist."""
    place, system, _ = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    place, system, jvm = _at(spark, path)
    stream = system.open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there whole or not at all; one that exists already is an error."""
    place, system, jvm = _at(spark, path)
    if system.exists(place):
        raise FileExistsError(path)
    hidden = jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{place.getName()}.tmp")
    stream = system.create(hidden, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not system.rename(hidden, place):
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    place, system, _ = _at(spark, path)
    system.delete(place, True)
