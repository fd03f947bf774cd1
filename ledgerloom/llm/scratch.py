"""Intermediate tables in the folder that all executors share.

``stage`` writes a DataFrame there and reads it back, so that later steps neither recompute it nor
depend on the executors that made it.  The folder is ``spark.checkpoint.dir``; where that is unset
(tests), the session's warehouse serves.  What a session wrote goes when its Python ends.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Staged(NamedTuple):
    df: DataFrame
    path: str


_roots: dict[str, SparkSession] = {}
_tables: list[str] = []
#: What has been staged by each build that is under way, the innermost last.
_frames: list[list[tuple[str, str | None]]] = []


def _root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    root = f"{base.rstrip('/')}/corpus-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots[root] = spark
        atexit.register(_forget, root)
    return root


def _forget(root: str) -> None:
    spark = _roots.pop(root, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        while _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
        remove(spark, root)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables once nothing lazy reads them any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, name: str) -> Staged:
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    _note(path)
    df.write.parquet(path)
    return Staged(spark.read.schema(df.schema).parquet(path), path)


def _note(path: str, table: str | None = None) -> None:
    if _frames:
        _frames[-1].append((path, table))


def only(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build() describes, written; what was staged on the way to it goes as soon as it is."""
    _frames.append([])
    try:
        df = build()
    except BaseException:
        _clear(spark, _frames.pop())
        raise
    mine = _frames.pop()
    try:
        return stage(df, name).df
    finally:
        _clear(spark, mine)


def _clear(spark: SparkSession, staged: list[tuple[str, str | None]]) -> None:
    for path, table in staged:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            _tables.remove(table)
        remove(spark, path)


def stage_by(df: DataFrame, name: str, column: str, parts: int, dealt: bool = False) -> DataFrame:
    """A table in the shared folder that is dealt by a column once and for all: grouping by it later moves no row.

    ``dealt`` tells that df is so already: it is grouped by the column into as many partitions, or neighbours of these.
    """
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    table = f"corpus_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    _note(path, table)
    _tables.append(table)
    (df if dealt else df.repartition(parts, column)).write.bucketBy(parts, column).sortBy(column).option("path", path).saveAsTable(table)
    return spark.table(table)


#: Rows of keys that are sent to all tasks; a table with more of them is shuffled.
SENT_ROWS = 200_000


def sent(keys: DataFrame, name: str) -> DataFrame:
    """Keys to be joined with: written, counted, and broadcast if they are few."""
    held = stage(keys, name).df
    return F.broadcast(held) if held.count() <= SENT_ROWS else held


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
