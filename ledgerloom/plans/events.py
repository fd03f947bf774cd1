"""Queries over the event table: drift, the ledger and its reviews, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, ledger
from ..operators.taxonomy import TYPES
from ..sources.shared import folder
from ..streaming import reviews as review_stream
from ..streaming import windows
from .registry import query, table

_KINDS = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
#: Entries made of events: several for a task, from several sources.
_ENTRIES = (
    f"WITH entries AS (SELECT user_id AS task_id, event_id, ts AS created_at, CASE event_id % 7 WHEN 0 THEN 'system' WHEN 1 THEN 'human' ELSE 'model' END AS source,"
    f" CASE WHEN event_id % 3 = 0 THEN 'MATCH' ELSE 'EXCEPTION' END AS verdict, CASE WHEN event_id % 3 <> 0 AND event_id % 11 <> 0 THEN {_KINDS}[event_id % 9 + 1] END AS kind FROM events) "
)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kinds = F.array(*map(F.lit, TYPES))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"),
        "event_id",
        F.col("ts").alias("created_at"),
        F.when(i % 7 == 0, "system").when(i % 7 == 1, "human").otherwise("model").alias("source"),
        F.when(i % 3 == 0, "MATCH").otherwise("EXCEPTION").alias("verdict"),
        F.when((i % 3 != 0) & (i % 11 != 0), F.get(kinds, (i % 9).cast("int"))).alias("kind"),
    )


@query(_ENTRIES + "SELECT task_id, event_id, created_at, source, verdict, kind FROM entries QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY created_at, event_id) = 1")
def ledger_first_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.first_write(entries(spark, sf_dir), "task_id", "created_at", "event_id")


@query(
    _ENTRIES + "SELECT task_id, event_id, created_at, source, verdict, kind FROM entries"
    " QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY CASE source WHEN 'human' THEN 0 WHEN 'model' THEN 1 ELSE 2 END, created_at DESC, event_id DESC) = 1"
)
def ledger_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.current(entries(spark, sf_dir), "task_id", "created_at", "event_id")


@query(_ENTRIES + "SELECT coalesce(kind, 'NONE') AS exception_type, count(*) AS n FROM entries WHERE source <> 'system' AND verdict = 'EXCEPTION' AND created_at >= (SELECT max(ts) FROM events) - INTERVAL 168 HOUR GROUP BY ALL")
def ledger_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions of the last 168 hours before the newest event."""
    rows = entries(spark, sf_dir)
    return ledger.stats(rows, rows.agg(F.max("created_at")).first()[0])


_REVIEWS = (
    "WITH acts AS (SELECT user_id AS task_id, ts AS tm, event_id AS n, CASE WHEN user_id % 7 <> 0 AND event_id % 5 = 0 THEN 'resolve' WHEN user_id % 7 <> 0 AND event_id % 5 = 1 THEN 'timeout' ELSE 'open' END AS act FROM events),"
    " opened AS (SELECT task_id, tm AS o_tm, n AS o_n FROM acts WHERE act = 'open' QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY tm, n) = 1),"
    " after AS (SELECT a.task_id, act, row_number() OVER (PARTITION BY a.task_id ORDER BY tm, n) AS nth, count(*) OVER (PARTITION BY a.task_id) AS ends FROM acts a JOIN opened USING (task_id) WHERE act <> 'open' AND (tm > o_tm OR (tm = o_tm AND n > o_n))),"
    " reviews AS (SELECT o.task_id, o_tm AS opened_at, CASE act WHEN 'resolve' THEN 'resolved' WHEN 'timeout' THEN 'timed_out' ELSE 'pending' END AS status, CAST(greatest(coalesce(ends, 0) - 1, 0) AS BIGINT) AS refused"
    " FROM opened o LEFT JOIN (SELECT * FROM after WHERE nth = 1) e ON o.task_id = e.task_id) "
)


def review_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings, and for most tasks (those with an id that seven does not divide) endings too."""
    i = F.col("event_id")
    ends = F.col("user_id") % 7 != 0
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"), F.col("ts").alias("at"), i.alias("n"), F.when(ends & (i % 5 == 0), "resolve").when(ends & (i % 5 == 1), "timeout").otherwise("open").alias("action")
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.fold_reviews(review_acts(spark, sf_dir), "task_id", "at", "n")


@query(_REVIEWS + "SELECT * FROM reviews")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir)


@query(_REVIEWS + "SELECT * FROM reviews WHERE status = 'pending' ORDER BY opened_at, task_id LIMIT 100")
def pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.pending(reviews(spark, sf_dir), "task_id")


@query(
    _REVIEWS + ", w AS (SELECT a.*, o_tm + INTERVAL 24 HOUR AS due FROM acts a JOIN opened USING (task_id) WHERE act <> 'open' AND (tm > o_tm OR (tm = o_tm AND n > o_n))),"
    " e AS (SELECT task_id, count(*) AS ends, min({'tm': tm, 'n': n, 'act': act}) FILTER (tm <= due) AS e FROM w GROUP BY task_id),"
    " d AS (SELECT o.task_id, o_tm, e, coalesce(ends, 0) AS ends, e IS NULL AND o_tm + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) AS late FROM opened o LEFT JOIN e USING (task_id))"
    " SELECT task_id, o_tm AS opened_at, CASE WHEN e.act = 'resolve' THEN 'resolved' WHEN e.act = 'timeout' OR late THEN 'timed_out' ELSE 'pending' END AS status,"
    " coalesce(e.tm, CASE WHEN late THEN o_tm + INTERVAL 24 HOUR END) AS ended_at, ends - CASE WHEN e IS NULL THEN 0 ELSE 1 END AS refused FROM d"
)
def review_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each review at the newest event when nobody's ending in 24 hours is an ending too."""
    acts = review_acts(spark, sf_dir)
    return ledger.deadlines(acts, acts.agg(F.max("at")).first()[0], "task_id", "at", "n")


#: Parts, by time, in which a table is replayed as a stream.
SLICES = 3
#: Acts of a bucket of reviews in the stream's state.
BUCKET_ACTS = 50_000


def streamed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to the reviews of the events, replayed as a stream that is stopped and started again after each part."""
    acts, path = review_acts(spark, sf_dir), folder(spark, "reviews")
    spans = acts.agg(F.min("at").alias("a"), F.max("at").alias("b"))
    part = F.least(F.floor(SLICES * (F.unix_micros("ts_") - F.col("a_")) / F.greatest(F.col("b_") - F.col("a_"), F.lit(1))), F.lit(SLICES - 1))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    timed = acts.crossJoin(F.broadcast(spans.select(micros("a").alias("a_"), micros("b").alias("b_")))).withColumn("ts_", F.col("at").cast("timestamp"))
    timed.select(*acts.columns, part.cast("int").alias("part")).write.partitionBy("part").parquet(f"{path}/parts")
    buckets = max(review_stream.BUCKETS, acts.count() // BUCKET_ACTS)
    with review_stream.rocks(spark):
        for i in range(SLICES):
            stream = spark.readStream.schema(acts.schema).parquet(f"{path}/parts/part={{{','.join(map(str, range(i + 1)))}}}")
            told = review_stream.timeouts(stream, "task_id", buckets=buckets)
            keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/told/batch={number}")
            told.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{path}/told")


@query(_REVIEWS + "SELECT task_id, opened_at + INTERVAL 24 HOUR AS due_at FROM reviews WHERE status = 'pending' AND opened_at <= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def streamed_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews whose timer went off on the stream and that nobody has ended since."""
    told = streamed_reviews(spark, sf_dir)
    ended = told.where("status = 'refused'").select("task_id").distinct()
    return told.where("by = 'timer'").join(ended, "task_id", "left_anti").select("task_id", F.col("at").cast("timestamp_ntz").alias("due_at"))


_HALVES = "WITH a AS (SELECT event_type, count(*) AS na FROM events WHERE event_id % 10 >= 3 GROUP BY ALL), b AS (SELECT event_type, count(*) AS nb FROM events WHERE event_id % 10 < 3 GROUP BY ALL)," + (
    " f AS (SELECT event_type, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM a FULL JOIN b USING (event_type)), s AS (SELECT *, sum(na) OVER () AS ta, sum(nb) OVER () AS tb FROM f),"
    " p AS (SELECT *, least(greatest(na::DOUBLE / ta, 1e-6), 1.0) AS pa, least(greatest(nb::DOUBLE / tb, 1e-6), 1.0) AS pb FROM s) "
)


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    count = lambda c: events.where(c).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return count("event_id % 10 >= 3"), count("event_id % 10 < 3")


@query(_HALVES + "SELECT event_type, na, nb, round((pa - pb) * ln(pa / pb), 6) AS term FROM p")
def psi_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.psi_terms(*halves(spark, sf_dir), "event_type")


@query(_HALVES + "SELECT round(sum((pa - pb) * ln(pa / pb)), 6) AS psi, sum((pa - pb) * ln(pa / pb)) > 0.1 AS fired, 0.1::DOUBLE AS threshold, CAST(max(ta) AS BIGINT) AS current_sum, CAST(max(tb) AS BIGINT) AS baseline_sum FROM p")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift(*halves(spark, sf_dir), "event_type")


_DAY_DRIFT = (
    "WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS t, event_type, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT t - i * INTERVAL 1 HOUR AS start, event_type, CAST(sum(n) AS BIGINT) AS na FROM h, range(24) r(i) GROUP BY ALL),"
    " b AS (SELECT event_type, count(*) AS nb FROM events WHERE event_id % 10 < 3 GROUP BY ALL), every AS (SELECT * FROM (SELECT DISTINCT start FROM w), (SELECT event_type FROM b UNION SELECT event_type FROM w)),"
    " f AS (SELECT start, event_type, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM every LEFT JOIN w USING (start, event_type) LEFT JOIN b USING (event_type)), s AS (SELECT *, sum(na) OVER (PARTITION BY start) AS ta, (SELECT sum(nb) FROM b) AS tb FROM f),"
    " p AS (SELECT *, least(greatest(na::DOUBLE / ta, 1e-6), 1.0) AS pa, least(greatest(nb::DOUBLE / tb, 1e-6), 1.0) AS pb FROM s)"
    " SELECT start, start + INTERVAL 24 HOUR AS end, round(sum((pa - pb) * ln(pa / pb)), 6) AS psi, sum((pa - pb) * ln(pa / pb)) > 0.1 AS fired, CAST(max(ta) AS BIGINT) AS n FROM p GROUP BY start"
)


def typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 10 < 3").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(_DAY_DRIFT)
def hourly_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of each day that begins on the hour."""
    return _plain(drift.windowed(table(spark, sf_dir, "events").select("ts", "event_type"), typical(spark, sf_dir), "event_type", size="24 hours"))


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(windows.tumbling(table(spark, sf_dir, "events")))


@query(
    "WITH d AS (SELECT time_bucket(INTERVAL 1 DAY, ts) - i * INTERVAL 1 DAY AS start, event_type FROM events, range(7) r(i)) SELECT start, start + INTERVAL 7 DAY AS end, event_type, count(*) AS n FROM d GROUP BY ALL"
)
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(windows.sliding(table(spark, sf_dir, "events")))


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events),"
    " s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM s GROUP BY user_id, session"
)
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(windows.sessions(table(spark, sf_dir, "events")))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with some of them twice, each counted once."""
    events = table(spark, sf_dir, "events")
    twice = events.unionByName(events.where("event_id % 3 = 0"))
    return windows.distinct_events(twice).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
