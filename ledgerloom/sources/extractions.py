"""Extractions kept by content: a document is extracted once for each text that it has had, whatever changes around it.

A folder holds entries (what was extracted, with the digest of the document it is of) and an index (digest, run, live,
number).  Refreshing it extracts documents whose digest the index does not have, marks those that are gone and
revives those that are back; the index is written last, in one step, so a run that is lost leaves entries that nobody
reads.  The digest is of the version, the mode, the source and the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifacts import CACHE_VERSION
from .shared import exists

INDEX = "digest string, source string, run string, live boolean, number long"


def digest(source: str = "source", text: str = "text", offline: bool = True):
    """What a document's extraction is kept under."""
    body = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.sha2(F.concat_ws("\n", F.lit(f"v{CACHE_VERSION}|offline={offline}"), F.coalesce(F.col(source).cast("string"), F.lit("")), body), 256)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each digest."""
    path = f"{folder}/index"
    rows = spark.read.schema(INDEX).parquet(path) if exists(spark, path) else spark.createDataFrame([], INDEX)
    return rows.groupBy("digest").agg(F.max_by(F.struct("source", "run", "live", "number"), "number").alias("r")).select("digest", "r.*")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """What was extracted from the documents that are there now, with their sources."""
    live = index(spark, folder).where("live").select("digest", "run", "source")
    return spark.read.parquet(f"{folder}/entries").join(live, ["digest", "run"]).drop("digest", "run")


def refresh(docs: DataFrame, folder: str, extract: Callable[[DataFrame], DataFrame], offline: bool = True) -> DataFrame:
    """Extractions of docs(source, text), of which only new texts are extracted: extract((source, text)) gives rows with a source.

    Repeated documents count once.  ``read`` gives the result again until the next refresh.
    """
    spark, run = docs.sparkSession, uuid.uuid4().hex
    wanted = docs.select("source", "text", digest(offline=offline).alias("digest")).dropDuplicates(["digest"])
    before = index(spark, folder)
    number = before.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1
    names = wanted.select("digest", "source")
    new = wanted.join(before, "digest", "left_anti")
    made = extract(new.select(F.col("digest").alias("source"), "text")).withColumnRenamed("source", "digest")
    made.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{folder}/entries")
    row = lambda rows, run, live: rows.select("digest", "source", run.alias("run"), F.lit(live).alias("live"), F.lit(number).cast("long").alias("number"))
    old = before.select("digest", "run", "live")
    back = row(names.join(old.where("NOT live"), "digest"), F.col("run"), True)
    gone = row(before.where("live").join(names, "digest", "left_anti"), F.col("run"), False)
    row(names.join(before, "digest", "left_anti"), F.lit(run), True).unionByName(back).unionByName(gone).write.mode("append").parquet(f"{folder}/index")
    return read(spark, folder)


def changes(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """Documents that a refresh extracted, revived or dropped, by what it did: change, n."""
    rows = spark.read.schema(INDEX).parquet(f"{folder}/index")
    first = rows.groupBy("digest").agg(F.min("number").alias("first"))
    what = F.when(~F.col("live"), "dropped").when(F.col("number") == F.col("first"), "extracted").otherwise("revived")
    return rows.where(F.col("number") == number).join(first, "digest").groupBy(what.alias("change")).agg(F.count(F.lit(1)).alias("n"))
