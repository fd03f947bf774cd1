"""Event-time statistics, the same function for a stream and for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time with a zone, which watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def _late(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    return events.withWatermark(ts, late) if late and events.isStreaming else events


def tumbling(events: DataFrame, size: str = "1 hour", ts: str = "ts", by: str = "event_type", late: str | None = "10 minutes") -> DataFrame:
    rows = _late(timed(events, ts), ts, late).groupBy(F.window(ts, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sliding(events: DataFrame, size: str = "168 hours", step: str = "24 hours", ts: str = "ts", by: str = "event_type", late: str | None = "10 minutes") -> DataFrame:
    rows = _late(timed(events, ts), ts, late).groupBy(F.window(ts, size, step).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", by: str = "user_id", late: str | None = "1 hour") -> DataFrame:
    rows = _late(timed(events, ts), ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once: within the watermark on a stream, overall on a table."""
    rows = timed(events, ts)
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])
