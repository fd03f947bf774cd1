"""Calibration of confidences and the threshold below which a verdict is sent to review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import score
from .taxonomy import HEAVY, weight_of


def ece_curve(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Rows with a prediction by confidence bin; empty bins are left out."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins))).cast("int")
    marked = rows.where("p_verdict IS NOT NULL").select(at.alias("bin"), "confidence", score.correct().cast("double").alias("right"))
    return marked.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("conf"), F.avg("right").alias("acc")).select(
        "bin",
        F.round(F.col("bin") / bins, 3).alias("conf_min"),
        F.round((F.col("bin") + 1) / bins, 3).alias("conf_max"),
        F.round("conf", 4).alias("conf_mean"),
        F.round("acc", 4).alias("accuracy"),
        "n",
    )


def ece(rows: DataFrame, bins: int = 10) -> DataFrame:
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins))).cast("int")
    marked = rows.where("p_verdict IS NOT NULL").select(at.alias("bin"), "confidence", score.correct().cast("double").alias("right"))
    by = marked.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("conf"), F.avg("right").alias("acc"))
    return by.agg(F.sum("n").alias("n"), F.round(F.coalesce(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), F.lit(0.0)), 4).alias("ece"))


def threshold_sweep(rows: DataFrame, steps: int = 20, per_escalation: float = 1.0, per_miss: float = 5.0) -> DataFrame:
    """Cost at each threshold 0, 1/steps, ... 1.

    Rows are first counted by how they would fare, at the lowest threshold that overrides them; the
    thresholds are then joined to those few counts, not to the rows.
    """
    heavy = score.is_exception() & (weight_of(F.col("kind")) >= HEAVY)
    fate = rows.select(
        F.when(F.col("p_verdict").isNull(), -1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce(F.col("p_verdict").isNull() | (F.col("p_verdict") == "ESCALATE"), F.lit(False)).alias("escalated"),
        (heavy & ~score.caught_by_weight()).alias("missed"),
        (heavy & F.col("p_verdict").isNull()).alias("lost"),
    )
    taus = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.round(i / steps, 3))
    counted = fate.groupBy("confidence", "escalated", "missed", "lost").agg(F.count(F.lit(1)).alias("rows")).withColumn("tau", F.explode(taus))
    over = (F.col("confidence") >= 0) & (F.col("confidence") < F.col("tau"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("rows")).otherwise(0)), F.lit(0)).cast("bigint")
    by = counted.groupBy("tau").agg(
        total(F.col("escalated") | over).alias("escalations"), total(F.col("lost") | (F.col("missed") & ~over & (F.col("confidence") >= 0))).alias("missed_high")
    )
    return by.withColumn("total_cost", per_escalation * F.col("escalations") + per_miss * F.col("missed_high"))


def best_threshold(rows: DataFrame, **options) -> DataFrame:
    """The lowest of the thresholds that cost least."""
    return threshold_sweep(rows, **options).agg(F.min(F.struct("total_cost", "tau", "escalations", "missed_high")).alias("b")).select(
        F.col("b.tau").alias("tau"), F.col("b.total_cost").alias("total_cost"), F.col("b.escalations").alias("escalations"), F.col("b.missed_high").alias("missed_high")
    )
