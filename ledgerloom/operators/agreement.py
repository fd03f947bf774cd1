"""Agreement of two raters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of label pairs: everything else is made from these."""
    return rows.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa and the agreement rate; 0 without rows, 1 or 0 where chance agreement is certain."""
    held = cells(rows, a, b)
    first = held.groupBy("a").agg(F.sum("n").alias("na"))
    second = held.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = first.join(second, F.col("a").eqNullSafe(F.col("b")), "inner").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("both"))
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n"))), F.lit(0)).alias("same"))
    po = F.try_divide(F.col("same").cast("double"), F.col("n"))
    pe = F.try_divide(F.col("both").cast("double"), F.col("n") * F.col("n"))
    value = F.when(F.col("n") == 0, 0.0).when(pe >= 1.0, F.when(po >= 1.0, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return total.crossJoin(chance).select("n", F.round(F.coalesce(po, F.lit(0.0)), 4).alias("agreement"), F.round(value, 4).alias("kappa"))


def confusions(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Disagreements as 'a->b', most frequent first."""
    return cells(rows, a, b).where("a <> b").select(F.concat_ws("->", "a", "b").alias("change"), "n").orderBy(F.col("n").desc(), "change")
