"""Predictions and the tasks they are for: joined by id, whatever is missing, repeated or too many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .score import n_of
from .taxonomy import TYPES


def attach(tasks: DataFrame, predictions: DataFrame, key: str = "task_id", order: str | None = None) -> DataFrame:
    """tasks with the columns of predictions; a task without one has nulls, which scores read as a reply that did not parse.

    Of several predictions for a task the last by ``order`` counts (without an order, the greatest as a whole).
    Predictions for no task are left out.
    """
    rest = [c for c in predictions.columns if c not in (key, order)]
    record = F.struct(*rest)
    one = F.max_by(record, F.struct(order, record)) if order else F.max(record)
    told = predictions.where(F.col(key).isNotNull()).groupBy(key).agg(one.alias("_told"))
    return tasks.join(told, key, "left").select(*tasks.columns, *[F.col(f"_told.{c}").alias(c) for c in rest])


def coverage(tasks: DataFrame, predictions: DataFrame, key: str = "task_id") -> DataFrame:
    """How many tasks have a prediction, how many have none, and how many predicted ids are no task's."""
    t = tasks.select(key).distinct().withColumn("_task", F.lit(True))
    p = predictions.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_told", F.lit(True))
    both = t.join(p, key, "full_outer")
    return both.agg(n_of(F.col("_task") & F.col("_told")).alias("predicted"), n_of(F.col("_told").isNull()).alias("missing"), n_of(F.col("_task").isNull()).alias("surplus"))


def label(verdict: Column, kind: Column) -> Column:
    """Fixed: the one category of a verdict that judges are compared by: its type, MATCH without one, or that it did not parse."""
    return F.when(verdict.isNull(), "UNPARSEABLE").otherwise(F.coalesce(F.when(kind.isin(*TYPES), kind), F.lit("MATCH")))
