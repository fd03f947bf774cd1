"""Drift of a distribution against a baseline: population stability index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 1e-6


def shares(actual: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """key, pa, pb from two count tables (key, n), each share kept within [1e-6, 1]."""
    a, b = actual.select(key, F.col("n").alias("na")), baseline.select(key, F.col("n").alias("nb"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    totals = both.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    clamp = lambda n, t: F.least(F.greatest(F.try_divide(n.cast("double"), t), F.lit(LEAST)), F.lit(1.0))
    return both.crossJoin(totals).select(key, "na", "nb", "ta", "tb", clamp(F.col("na"), F.col("ta")).alias("pa"), clamp(F.col("nb"), F.col("tb")).alias("pb"))


def psi_terms(actual: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    return shares(actual, baseline, key).select(key, "na", "nb", F.round((F.col("pa") - F.col("pb")) * F.log(F.col("pa") / F.col("pb")), 6).alias("term"))


def drift(actual: DataFrame, baseline: DataFrame, key: str, threshold: float = 0.1) -> DataFrame:
    """psi and whether it fires: 0 where both are empty, infinite (and silent) where one is."""
    s = shares(actual, baseline, key).agg(
        F.coalesce(F.max("ta"), F.lit(0)).alias("current_sum"), F.coalesce(F.max("tb"), F.lit(0)).alias("baseline_sum"), F.count(F.lit(1)).alias("keys"),
        F.sum((F.col("pa") - F.col("pb")) * F.log(F.col("pa") / F.col("pb"))).alias("sum"),
    )
    empty = (F.col("current_sum") <= 0) | (F.col("baseline_sum") <= 0)
    value = F.when(F.col("keys") == 0, 0.0).when(empty, float("inf")).otherwise(F.col("sum"))
    return s.select(F.round(value, 6).alias("psi"), ((value < float("inf")) & (value > threshold)).alias("fired"), F.lit(threshold).alias("threshold"), "current_sum", "baseline_sum")


def windowed(events: DataFrame, baseline: DataFrame, key: str, size: str = "168 hours", step: str = "1 hour", ts: str = "ts", late: str | None = "10 minutes", threshold: float = 0.1) -> DataFrame:
    """start, end, psi, fired and n of each sliding window against a fixed baseline(key, n); for streams and tables alike.

    Events are counted by step first, so only counts go to the size / step windows that each belongs to.  On a stream
    (append mode) a window comes out once, when the watermark has passed its end; a table has no end, so its last windows
    are those that begin before its newest step ends.  A null key is a key of its own.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if late and events.isStreaming else timed
    counted = timed.groupBy(F.window(ts, step).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    seen = F.collect_list(F.struct(F.col(key).alias("k"), F.col("n")))
    spread = counted.select(F.window_time("w").alias("t"), key, "n").groupBy(F.window("t", size, step).alias("w")).agg(seen.alias("a"))
    told = baseline.agg(seen.alias("b"))
    rows = spread.crossJoin(F.broadcast(told)).select("w", "a", "b", F.array_distinct(F.concat(F.transform("a", lambda e: e["k"]), F.transform("b", lambda e: e["k"]))).alias("keys"))
    total = lambda held, k: F.aggregate(F.filter(held, lambda e: e["k"].eqNullSafe(k)), F.lit(0).cast("long"), lambda x, e: x + e["n"])
    whole = lambda held: F.aggregate(held, F.lit(0).cast("long"), lambda x, e: x + e["n"])
    rows = rows.select("w", F.transform("keys", lambda k: F.struct(total(F.col("a"), k).alias("na"), total(F.col("b"), k).alias("nb"))).alias("n"), whole(F.col("a")).alias("ta"), whole(F.col("b")).alias("tb"))
    share = lambda n, t: F.least(F.greatest(n.cast("double") / t, F.lit(LEAST)), F.lit(1.0))
    terms = F.transform("n", lambda e: (share(e["na"], F.col("ta")) - share(e["nb"], F.col("tb"))) * F.log(share(e["na"], F.col("ta")) / share(e["nb"], F.col("tb"))))
    psi = F.when(F.col("tb") <= 0, float("inf")).otherwise(F.aggregate(F.array_sort(terms), F.lit(0.0), lambda x, t: x + t))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.round(psi, 6).alias("psi"), ((psi < float("inf")) & (psi > threshold)).alias("fired"), F.col("ta").alias("n"))
