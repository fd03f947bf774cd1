"""A ledger as a log of batches in buckets: the first entry of a key stays, whatever comes later.

Keys are dealt to buckets by hash.  A batch looks up its keys in the live files of the buckets that it touches
and adds what is new as files of its own; a manifest, replaced whole by each commit, lists the live folders
of each bucket and the last batch.  A batch that comes again changes nothing and gets back what it added.  A bucket with
more than ``most_folders`` is merged into one; once buckets hold ``bucket_rows`` on average their number is doubled, so
what a batch of so many keys reads does not grow with the ledger.  Folders that a commit replaces go with the commit
after it, as readers may still be in them.

The manifest has an entry for each live folder, at most ``most_folders`` a bucket, and is read and written by the driver:
with a million rows a bucket, about 100 kB for each billion entries.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ledger import append_new
from ..sources.shared import folder_bytes, names, read_text, remove, write_text


class Manifest(NamedTuple):
    last: int
    buckets: int
    rows: int
    #: Bucket: its live folders with their bytes.
    live: dict[str, list[list]]
    #: Folders that the next commit removes.
    gone: list[str]
    #: Bytes of live files that the last batch looked its keys up in.
    looked_up: int


class LedgerLog:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, at: str, tie: str, buckets: int = 64, bucket_rows: int = 1_000_000, most_folders: int = 8) -> None:
        self.spark, self.path, self.schema = spark, path, StructType(schema.fields)
        self.key, self.at, self.tie = key, at, tie
        self.buckets, self.bucket_rows, self.most_folders = buckets, bucket_rows, most_folders

    def manifest(self) -> Manifest:
        found = [n for n in names(self.spark, self.path) if n.startswith("manifest-") and n.endswith(".json")]
        return Manifest(**json.loads(read_text(self.spark, f"{self.path}/{found[-1]}"))) if found else Manifest(-1, self.buckets, 0, {}, [], 0)

    def _folders(self, held: Manifest, buckets: list[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/{folder}" for b, folders in held.live.items() if buckets is None or b in buckets for folder, _ in folders]
        return self.spark.read.schema(self.schema).parquet(*paths).select(*self.schema.names) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All entries."""
        return self._folders(self.manifest())

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, buckets: int, name: str) -> dict[str, list]:
        """Writes rows by bucket, one file each; bucket: [folder, bytes]."""
        path = f"{self.path}/{name}"
        rows.select("*", self._bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return {folder.split("=")[1]: [f"{name}/{folder}", size] for folder, size in folder_bytes(self.spark, path).items() if "=" in folder}

    def _added(self, number: int) -> DataFrame:
        path = f"{self.path}/batch-{number}"
        if not any("=" in n for n in names(self.spark, path)):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(path).select(*self.schema.names)

    def append(self, number: int, entries: DataFrame) -> DataFrame:
        """Adds the first entries of keys that are new and returns them; numbers rise from batch to batch."""
        held = self.manifest()
        if number <= held.last:
            return self._added(number) if number == held.last else self.spark.createDataFrame([], self.schema)
        rows = entries.select(*self.schema.names)
        touched = [str(r["bucket"]) for r in rows.select(self._bucket(held.buckets)).distinct().collect()]
        looked_up = sum(size for b in touched for _, size in held.live.get(b, []))
        before = self._folders(held, touched)
        new = self._write(append_new(before, rows, self.key, self.at, self.tie).select(*self.schema.names), held.buckets, f"batch-{number}")
        live = {b: list(folders) for b, folders in held.live.items()}
        for b, folder in new.items():
            live.setdefault(b, []).append(folder)
        added = self._added(number)
        after = Manifest(number, held.buckets, held.rows + added.count(), live, [], looked_up)
        self._commit(self._merged(after, held), held)
        return added

    def _merged(self, after: Manifest, held: Manifest) -> Manifest:
        """The manifest with crowded buckets merged, or all of them dealt to twice as many."""
        if after.rows > self.bucket_rows * after.buckets:
            buckets = after.buckets * 2
            moved = self._write(self._folders(after), buckets, f"dealt-{after.last}")
            return after._replace(buckets=buckets, live={b: [f] for b, f in moved.items()}, gone=[f for folders in after.live.values() for f, _ in folders])
        crowded = [b for b, folders in after.live.items() if len(folders) > self.most_folders]
        if not crowded:
            return after
        moved = self._write(self._folders(after, crowded), after.buckets, f"merged-{after.last}")
        return after._replace(live=after.live | {b: [moved[b]] for b in crowded}, gone=[f for b in crowded for f, _ in after.live[b]])

    def _commit(self, after: Manifest, before: Manifest) -> None:
        write_text(self.spark, f"{self.path}/manifest-{after.last:012d}.json", json.dumps(after._asdict()))
        old = [n for n in names(self.spark, self.path) if n.startswith("manifest-")][:-2]
        remove(self.spark, *[f"{self.path}/{f}" for f in before.gone], *[f"{self.path}/{n}" for n in old])

