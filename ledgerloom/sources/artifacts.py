"""Artifacts on disk: tasks, benchmarks, golden sets, corpora, extractions, evaluation exports and checkpoints.

Every reader has a declared schema and returns a lazy DataFrame; what decides between files (names and
modification times) is read from the files' metadata columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import listing
from . import shared
from .pairs import EXPECTED, LEDGER, PAIR, STATEMENT, newest_until, read_pairs, read_wrapped

VERDICT = "struct<verdict:string,exception_type:string,severity:string,confidence:double,reason:string,resolution:string>"
TURNS = "array<struct<role:string,content:string>>"


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks from a folder of JSON-lines files, one such file, or one JSON document (array, object, or object with ``tasks``)."""
    if path.endswith(".json"):
        return read_wrapped(spark, path)
    rows = read_pairs(spark, path)
    return rows.where("task_id IS NOT NULL OR _corrupt_record IS NOT NULL")


def latest_tasks(spark: SparkSession, folder: str, least: int = 200, names: str = "pilot-*.json") -> DataFrame:
    """Tasks of the newest benchmark artifacts that together hold at least so many, whole files at a time."""
    nested = f"task_id:string,seed:bigint,difficulty:double,ledger:{LEDGER},statement:{STATEMENT},expected:{EXPECTED}"
    read = spark.read.schema(f"seed bigint, tasks array<struct<{nested}>>").option("multiLine", True).option("pathGlobFilter", names).json(folder)
    rows = read.select("_metadata", F.explode("tasks").alias("t")).select("_metadata", "t.*")
    return newest_until(rows, least).drop("_metadata")


def tasks_from(spark: SparkSession, places: list[str], least: int = 200, names: str = "pilot-*.json") -> DataFrame | None:
    """Tasks of the first place that has any: a file or folder of tasks, or a folder of benchmark artifacts, as its names tell; None where none has."""
    prefix, _, suffix = names.partition("*")
    for place in places:
        there = [n for n in shared.names(spark, place) if not n.startswith(("_", "."))]
        if any(n.startswith(prefix) and n.endswith(suffix) for n in there):
            return latest_tasks(spark, place, least, names)
        if there:
            return read_tasks(spark, place)
    return None


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("task_id string, label string, judge string").json(path).where("label IS NOT NULL OR judge IS NOT NULL")


def newest_golden(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the newest golden set in a folder; sets of local judges do not count."""
    rows = spark.read.schema("task_id string, label string, judge string").option("pathGlobFilter", "golden-*.jsonl").json(folder)
    named = rows.select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_modification_time").alias("_at"))
    kept = named.where(~F.contains("_name", F.lit("local-judge")))
    newest = kept.agg(F.max(F.struct("_at", "_name")).alias("_newest"))
    return kept.crossJoin(F.broadcast(newest)).where(F.col("_name") == F.col("_newest._name")).select("task_id", "label", "judge")


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """source (file name) and text of each Markdown document, whole, in order of source."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))  # names in the metadata are escaped
    return rows.select(name.alias("source"), F.col("value").alias("text")).orderBy("source")


def first_with_files(spark: SparkSession, folders: list[str], suffix: str = "") -> str | None:
    """The first folder that has a file so named: the real corpus before the sample, a cache before the canonical file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(conf)
        if fs.exists(at) and any(f.getPath().getName().endswith(suffix) for f in fs.listStatus(at)):
            return folder
    return None


CACHE_VERSION = 1


def cache_key(docs: DataFrame, offline: bool = True) -> str:
    """Sixteen hex digits that depend on every document's source and text, on the mode and on the version, not on order."""
    digests = docs.select(F.sha2(F.concat_ws("\n", "source", F.length("text").cast("string"), F.sha2("text", 256)), 256).alias("d"))
    folded = digests.agg(*listing("d")).first()
    return docs.sparkSession.range(1).select(F.left(F.sha2(F.lit(f"v{CACHE_VERSION}|offline={offline}|{tuple(folded)}"), 256), F.lit(16))).first()[0]


def cached(docs: DataFrame, folder: str, extract) -> DataFrame:
    """What extract(docs) makes, from the folder's cache if these documents were extracted there before."""
    spark, path = docs.sparkSession, f"{folder}/extracted-{cache_key(docs)}"
    if first_with_files(spark, [path], "_SUCCESS") is None:
        extract(docs).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def newest_cache(spark: SparkSession, folder: str) -> str | None:
    """The newest extraction in a folder, by modification time and then name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)
    found = [(f.getModificationTime(), f.getPath().getName()) for f in fs.listStatus(at)] if fs.exists(at) else []
    made = sorted(x for x in found if x[1].startswith("extracted-"))
    return f"{folder}/{made[-1][1]}" if made else None


def best_triples(docs: DataFrame, folder: str, canonical: str, extract) -> DataFrame:
    """Triples of the newest cache, else of the canonical extraction, else extracted anew."""
    spark = docs.sparkSession
    newest = newest_cache(spark, folder)
    if newest is None and first_with_files(spark, [canonical], "_SUCCESS"):
        newest = canonical
    return spark.read.parquet(newest) if newest else extract(docs)


def read_gold(spark: SparkSession, path: str, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples, skipped) of a JSON array of gold triples; one whose ends have no type in types(name, type) is skipped."""
    rows = spark.read.schema("head string, relation string, tail string, confidence double, source string").option("multiLine", True).json(path).where("head IS NOT NULL")
    of = lambda end: types.select(F.col("name").alias(end), F.col("type").alias(f"{end}_type"))
    typed = rows.join(of("head"), "head", "left").join(of("tail"), "tail", "left")
    known = F.col("head_type").isNotNull() & F.col("tail_type").isNotNull()
    source = F.coalesce("source", F.lit("gold-triples.json"))
    made = typed.where(known).select(
        "head", "head_type", "relation", "tail", "tail_type", F.concat(F.lit("gold triple: "), F.coalesce("source", F.lit(""))).alias("evidence"), F.coalesce("confidence", F.lit(0.9)).alias("confidence"), source.alias("source")
    )
    return made, typed.where(~known).select("head", "relation", "tail")


def read_eval_records(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of evaluation records: as they are, or with the expected verdict from the last turn of a chat record."""
    rows = spark.read.schema(f"{PAIR}, messages {TURNS}").json(path)
    said = F.from_json(F.get(F.col("messages"), F.size("messages") - 1)["content"], VERDICT)
    told = F.struct(said["verdict"].alias("verdict"), said["exception_type"].alias("exception_type"), said["severity"].alias("severity"), said["reason"].alias("explanation"), said["resolution"].alias("resolution"))
    expected = F.coalesce("expected", F.when(said["verdict"].isNotNull(), told))
    return rows.select(F.coalesce("task_id", F.lit("unknown")).alias("task_id"), F.coalesce("difficulty", F.lit(0.5)).alias("difficulty"), "ledger", "statement", expected.alias("expected"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """task_id, expected and predicted of an evaluation export, whether it lists them per task or per prediction."""
    entry = f"array<struct<task_id:string,expected:{EXPECTED},predicted:{VERDICT}>>"
    rows = spark.read.schema(f"per_task {entry}, per_prediction {entry}").option("multiLine", True).json(path)
    return rows.select(F.explode(F.coalesce("per_task", "per_prediction")).alias("r")).select("r.task_id", "r.expected", "r.predicted")


def last_records(spark: SparkSession, path: str, schema: str, key: str = "task_id") -> DataFrame:
    """Of each key the record written last: newer files before older ones, later lines before earlier ones."""
    rows = spark.read.schema(schema).json(path)
    place = F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))
    placed = rows.select(F.col(key), F.struct(*rows.columns).alias("_record"), place.alias("_place")).where(F.col(key).isNotNull())
    return placed.groupBy(key).agg(F.max_by("_record", "_place").alias("r")).select("r.*")


def pending(tasks: DataFrame, done: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks that a checkpoint does not have yet."""
    return tasks.join(done.select(key), key, "left_anti")


def append_records(rows: DataFrame, path: str) -> None:
    """Adds records to a checkpoint; what is there stays, and a task's later record wins when it is read."""
    rows.write.mode("append").json(path)
