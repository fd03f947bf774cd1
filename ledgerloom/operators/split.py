"""Stratified training and validation splits with a leak guard, and chat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import written
from .ranks import ranked


def decile(difficulty: Column, bins: int = 10) -> Column:
    return F.least(F.lit(bins - 1), F.floor(difficulty * bins)).cast("int")


def stratified(rows: DataFrame, strata: list[str], key: str, fraction: float = 0.8, seed: int = 7) -> DataFrame:
    """rows with split: in each stratum the first round(n * fraction) by a seeded hash train, one at least on each side.

    A stratum may hold any share of the rows: ranks are made from counts (``ranks``), not by one sort a stratum.  The
    rows are written first, as counts and ranks both read them.
    """
    rows, _ = written(rows, "split-rows")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    wanted = F.bround(F.col("_n") * F.lit(fraction)).cast("bigint")
    wanted = F.when(F.col("_n") >= 2, F.greatest(F.lit(1), F.least(F.col("_n") - 1, wanted))).otherwise(wanted)
    side = F.when(F.col("_rank") <= wanted, "train").otherwise("val")
    return ranked(rows, strata, order, key).withColumn("split", side).drop("_rank", "_n")


def balance(rows: DataFrame, strata: list[str]) -> DataFrame:
    return rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("split") == "train").cast("bigint")).alias("n_train"))


def leaks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each column how many of its values are on both sides."""
    out = None
    for c in columns:
        both = rows.groupBy(c).agg(F.count_distinct("split").alias("sides")).agg(F.coalesce(F.sum((F.col("sides") > 1).cast("bigint")), F.lit(0).cast("bigint")).alias("shared"))
        one = both.select(F.lit(c).alias("column"), "shared")
        out = one if out is None else out.union(one)
    return out


def guarded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows, or an error where a value of a column is on both sides."""
    found = leaks(rows, columns).agg(F.sum("shared").alias("shared"))
    check = found.select(F.when(F.col("shared") > 0, F.raise_error(F.lit("training and validation share values"))).otherwise(F.lit(True)).alias("sound"))
    return rows.crossJoin(F.broadcast(check)).where("sound").drop("sound")


def chat_records(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record a conversation, its turns in order; a conversation fits in a row."""
    said = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(key).agg(said.alias("turns")).select(key, F.transform("turns", lambda t: F.struct(t["role"], t["content"])).alias("messages"))


def verdict_json(verdict: Column, kind: Column, severity: Column, resolution: Column, reason: Column) -> Column:
    """The training target: keys in order, compact, absent types as null."""
    made = F.struct(
        F.lit(1.0).alias("confidence"), kind.alias("exception_type"), reason.alias("reason"), resolution.alias("resolution"), severity.alias("severity"), verdict.alias("verdict")
    )
    return F.to_json(made, {"ignoreNullFields": "false"})
