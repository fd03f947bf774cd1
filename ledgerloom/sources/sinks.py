"""Artifacts: canonical JSON, JSON lines and idempotent graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(columns: list[str]) -> Column:
    """Keys in order, compact, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def write_named(lines: DataFrame, folder: str, name: str) -> None:
    """A bounded table of one text column as one file of that name: written by one task, then renamed."""
    spark, tmp = lines.sparkSession, f"{folder}/_{name}"
    lines.coalesce(1).write.mode("overwrite").text(tmp)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(tmp).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(path(tmp)) if f.getPath().getName().startswith("part-"))
    fs.delete(path(f"{folder}/{name}"), False)
    fs.rename(part, path(f"{folder}/{name}"))
    fs.delete(path(tmp), True)


def write_artifact(one_row: DataFrame, path: str) -> None:
    """A summary of one row as a file of one line of canonical JSON."""
    folder, _, name = path.rpartition("/")
    write_named(one_row.select(canonical(one_row.columns).alias("value")), folder, name)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Named tables of bounded size (calibration curves, intervals, flag metrics) as files of JSON lines in order, one each."""
    for name, rows in tables.items():
        lines = rows.select(canonical(rows.columns).alias("value")).orderBy("value")
        write_named(lines, path, f"{name}.jsonl")


def write_split(rows: DataFrame, path: str, key: str = "task_id") -> None:
    """Each side of a split as JSON lines in order of key, range-partitioned so that no task sorts all."""
    for side in ("train", "val"):
        part = rows.where(F.col("split") == side).drop("split")
        part.orderBy(key).select(canonical(part.columns).alias("value")).write.mode("overwrite").text(f"{path}/{side}")


def merge_graph(current: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows by key, the last write winning: loading the same rows twice changes nothing."""
    rows = new if current is None else current.unionByName(new)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
