"""Pairs of ledger and statement records: schema, files, and a view over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import next_business_day

SIDE = "message_type string, ref string, amount string, ccy string, value_date string, counterparty string, beneficiary string, fx_rate double"
LEDGER = f"struct<{SIDE.replace(' string', ':string').replace(' double', ':double')},booked_at:string>"
STATEMENT = f"struct<{SIDE.replace(' string', ':string').replace(' double', ':double')}>"
EXPECTED = "struct<verdict:string,exception_type:string,severity:string,explanation:string,resolution:string>"
PAIR = f"task_id string, seed bigint, difficulty double, ledger {LEDGER}, statement {STATEMENT}, expected {EXPECTED}"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines file or a folder of them; lines that do not parse are kept in ``_corrupt_record``."""
    return spark.read.schema(PAIR + ", _corrupt_record string").option("mode", "PERMISSIVE").option("pathGlobFilter", "*.jsonl").json(path)


def read_wrapped(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document that is an array of pairs, one pair, or an object with its pairs under ``tasks``."""
    fields = PAIR.replace("task_id string", "task_id string, tasks array<struct<" + _nested() + ">>")
    rows = spark.read.schema(fields).option("multiLine", True).json(path)
    inner = rows.where("tasks IS NOT NULL").select(F.explode("tasks").alias("t")).select("t.*")
    return rows.where("tasks IS NULL").drop("tasks").unionByName(inner)


def _nested() -> str:
    return f"task_id:string,seed:bigint,difficulty:double,ledger:{LEDGER},statement:{STATEMENT},expected:{EXPECTED}"


def newest_until(rows: DataFrame, least: int = 200) -> DataFrame:
    """Of rows read with _metadata, those of the newest files that together hold at least so many."""
    from pyspark.sql import Window as W

    named = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.col("_metadata.file_modification_time"))
    files = named.groupBy("_file", "_at").count()
    newer = F.sum("count").over(W.partitionBy(F.lit(0)).orderBy(F.col("_at").desc(), "_file").rowsBetween(W.unboundedPreceding, -1))
    kept = files.withColumn("before", F.coalesce(newer, F.lit(0))).where(F.col("before") < least).select("_file")
    return named.join(kept, "_file", "left_semi").drop("_file", "_at")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs over orders: k (the order key), task_id, ledger and statement.

    The order key mod 20 says how the statement departs from the ledger; integer arithmetic only, so
    any engine can rebuild the view.
    """
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    case = k % 20
    amount = F.round("o_totalprice", 2).cast("decimal(18,2)")
    due = next_business_day(F.col("o_orderdate").cast("date"))
    name = F.concat_ws(" ", "n_name", "c_mktsegment")
    text = lambda c: c.cast("decimal(18,2)").cast("string")
    times = lambda x: text(amount * F.lit(x).cast("decimal(5,3)"))
    ref = F.concat(F.lit("OUR-"), k.cast("string"))
    theirs = F.concat(F.lit("CP-"), k.cast("string"))
    ledger = F.struct(
        F.lit("MT103").alias("message_type"),
        ref.alias("ref"),
        text(amount).alias("amount"),
        F.lit("USD").alias("ccy"),
        F.date_format(due, "yyyy-MM-dd").alias("value_date"),
        F.col("c_name").alias("counterparty"),
        name.alias("beneficiary"),
        F.lit(None).cast("double").alias("fx_rate"),
        F.date_format(F.date_sub(due, (k % 3).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'").alias("booked_at"),
    )
    statement = F.struct(
        F.lit("camt.054").alias("message_type"),
        F.when(case == 17, ref).when(case == 3, F.concat(F.lit("  "), theirs, F.lit(" "))).otherwise(theirs).alias("ref"),
        F.when(case == 1, times("1.002"))
        .when(case == 11, times("1.020"))
        .when(case == 4, times("0.920"))
        .when(case == 12, times("0.850"))
        .when(case == 18, F.concat(text(amount), F.lit("0")))
        .otherwise(text(amount))
        .alias("amount"),
        F.when(case.isin(4, 12), "EUR").when(case == 6, "usd").otherwise("USD").alias("ccy"),
        F.date_format(F.when(case == 15, F.date_add(due, 5 - F.weekday(due))).otherwise(due), "yyyy-MM-dd").alias("value_date"),
        F.when(case == 14, "Qqwv Partners").otherwise(F.col("c_name")).alias("counterparty"),
        F.when(case == 2, F.lower(name)).when(case == 13, "Zzqx Holdings").when(case == 19, F.col("n_name")).otherwise(name).alias("beneficiary"),
        F.when(case.isin(4, 12), 0.92).alias("fx_rate"),
    )
    return rows.select(
        k.alias("k"), F.format_string("recon-%06d", k).alias("task_id"), ledger.alias("ledger"), F.when(case != 16, statement).alias("statement")
    )
