"""Small native column helpers shared by the operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def rank_in(bounds: list[int], x: Column) -> Column:
    """How many of the ascending bounds lie below x, by binary search."""
    if not bounds:
        return F.lit(0)
    held, step, steps = F.lit(bounds), 1, []
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    return F.reduce(
        F.lit(steps), F.lit(0), lambda low, s: F.when(F.get(held, low + s - 1) < x, low + s).otherwise(low)
    )


def inline_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of bounded size from driver values, as a literal in the plan."""
    literal = json.dumps(rows).replace("\\", "\\\\").replace("'", "\\'")
    return spark.sql(f"SELECT inline(from_json('{literal}', 'array<struct<{schema}>>'))")


#: A run of repeats longer than this is cut before it is written out, so that no task holds or makes all of it.
RUN = 1 << 16


def repeated(rows: DataFrame, name: str, first: Column, n: Column, longest: int, cut: str = "__from") -> DataFrame:
    """Each row n times, with name counting up from first; rows with n of 0 go.

    ``longest`` is the greatest n.  Where it exceeds ``RUN``, runs are cut and their parts dealt to all tasks.
    """
    kept = rows.where(n > 0)
    if longest <= RUN:
        return kept.withColumn(name, F.explode(F.sequence(first, first + n - 1)))
    parts = kept.withColumn(cut, F.explode(F.sequence(first, first + n - 1, F.lit(RUN).cast("long"))))
    dealt = parts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), cut)
    return dealt.withColumn(name, F.explode(F.sequence(F.col(cut), F.least(F.col(cut) + RUN, first + n) - 1))).drop(cut)
