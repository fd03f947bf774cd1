"""Folders that all executors share, for artifacts that queries write and read back."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

_made: dict[str, SparkSession] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir`` (where unset, the warehouse); it goes when the session's Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_forget)
    _made[path] = spark
    return path


def _forget() -> None:
    for path, spark in _made.items():
        if spark.sparkContext._jsc is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made.clear()


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = filesystem(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, at = filesystem(spark, path)
        fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, in order of name; nothing where there is no folder."""
    fs, at = filesystem(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def folder_bytes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of the data files in each folder below a path."""
    fs, at = filesystem(spark, path)
    found: dict[str, int] = {}
    if fs.exists(at):
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().startswith("part-"):
                parent = f.getPath().getParent().getName()
                found[parent] = found.get(parent, 0) + f.getLen()
    return found


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place and renamed into it."""
    fs, at = filesystem(spark, path)
    beside = at.suffix("._new")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = filesystem(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
