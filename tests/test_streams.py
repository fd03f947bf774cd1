"""Streams with state: replayed, out of order, stopped and started again, against the same over a table."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators import drift, ledger
from ledgerloom.plans import events as plans
from ledgerloom.streaming import pipeline, reviews
from ledgerloom.streaming.ledger_log import LedgerLog

T0 = dt.datetime(2026, 1, 1)
H = dt.timedelta(hours=1)
ACTS = "k string, at timestamp_ntz, n long, action string"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def drained(spark, path, name, late="0 seconds"):
    """One run over what a folder holds by now."""
    stream = spark.readStream.schema(ACTS).parquet(f"{path}/in")
    with reviews.rocks(spark):
        out = reviews.timeouts(stream, "k", late=late).writeStream.outputMode("update")
        out = out.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/{name}/batch={i}"))
        out.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/{name}")


def put(spark, path, acts):
    spark.createDataFrame(acts, ACTS).coalesce(1).write.mode("append").parquet(f"{path}/in")


def test_advance_takes_acts_in_order_of_time():
    wait = 100
    review, left, told = reviews.advance(None, [(50, 2, "resolve"), (10, 1, "open"), (300, 3, "open")], 200, wait)
    assert (review, left, told) == ((10, 1, "resolved"), [(300, 3, "open")], [("resolved", 50, "act")])
    review, left, told = reviews.advance(None, [(10, 1, "open"), (110, 2, "resolve")], 120, wait)
    assert told == [("resolved", 110, "act")]
    review, left, told = reviews.advance(None, [(10, 1, "open"), (111, 2, "resolve"), (5, 0, "resolve")], 120, wait)
    assert told == [("timed_out", 110, "timer"), ("refused", 111, "act")]
    assert reviews.advance((10, 1, "pending"), [], 109, wait)[2] == [] and reviews.advance((10, 1, "pending"), [], 110, wait)[2] == [("timed_out", 110, "timer")]


def test_timers_fire_once_across_restarts_and_disorder(spark, tmp_path):
    """Many keys, acts in disorder within two hours, a restart after each of six slices."""
    rng = random.Random(8)
    acts = [(f"k{rng.randrange(40)}", T0 + rng.randrange(0, 5 * 24 * 60) * dt.timedelta(minutes=1), n, rng.choice(["open", "open", "resolve", "timeout"]) if n % 3 else "open") for n in range(260)]
    acts.append(("late", T0 + 130 * H, 999, "open"))
    arrival = sorted(acts, key=lambda a: a[1] + rng.random() * 1.9 * H)
    told = None
    for i in range(6):
        put(spark, tmp_path, arrival[i * len(arrival) // 6 : (i + 1) * len(arrival) // 6])
        told = drained(spark, str(tmp_path), "out", late="2 hours")
    newest = T0 + 130 * H
    seen = newest - 2 * H
    table = ledger.deadlines(spark.createDataFrame([a for a in acts if a[1] <= seen], ACTS), seen, "k", "at", "n")
    want = rows_of(table.where("status <> 'pending'").select("k", F.col("opened_at").cast("timestamp"), "status", F.col("ended_at").cast("timestamp")))
    ends = told.where("status <> 'refused'")
    assert rows_of(ends.select("k", "opened_at", "status", "at")) == want and len(want) > 30
    refused = {r["k"]: r["refused"] for r in table.where("refused > 0").collect()}
    assert {r["k"]: r["count"] for r in told.where("status = 'refused'").groupBy("k").count().collect()} == refused


def test_reviews_share_buckets_and_stay_apart(spark, tmp_path):
    """Sixty keys in three buckets, one of them null, in three slices: each ends as the table has it."""
    rng = random.Random(3)
    acts = [(f"k{k}" if k else None, T0 + rng.randrange(90 * 60) * dt.timedelta(minutes=1), n, rng.choice(["open", "resolve", "timeout"])) for n, k in enumerate(rng.randrange(60) for _ in range(400))]
    acts = sorted(acts, key=lambda a: a[1]) + [("late", T0 + 100 * H, 999, "open")]
    for i in range(3):
        put(spark, tmp_path, acts[i * len(acts) // 3 : (i + 1) * len(acts) // 3])
        with reviews.rocks(spark):
            out = reviews.timeouts(spark.readStream.schema(ACTS).parquet(f"{tmp_path}/in"), "k", buckets=3).writeStream.outputMode("update")
            out = out.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}"))
            out.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.parquet(f"{tmp_path}/out")
    seen = T0 + 100 * H
    table = ledger.deadlines(spark.createDataFrame(acts, ACTS), seen, "k", "at", "n")
    want = sorted((r["k"] or "", r["status"], r["ended_at"]) for r in table.where("k IS NOT NULL AND status <> 'pending'").collect())
    got = sorted((r["k"] or "", r["status"], r["at"]) for r in told.where("k IS NOT NULL AND status <> 'refused'").select("k", "status", F.col("at").cast("timestamp_ntz").alias("at")).collect())
    assert got == want and len(want) > 40
    assert {r["k"]: r["count"] for r in told.where("k IS NOT NULL AND status = 'refused'").groupBy("k").count().collect()} == {r["k"]: r["refused"] for r in table.where("k IS NOT NULL AND refused > 0").collect()}
    assert told.where("k IS NULL AND status <> 'refused'").count() == 1  # the table's join on keys never ends a null key's review


def test_replayed_events_give_the_timeouts_of_the_table(spark, sf_dir):
    got = plans.streamed_timeouts(spark, sf_dir)
    from ledgerloom.plans.payments import review_timeouts

    assert rows_of(got) == rows_of(review_timeouts(spark, sf_dir)) and got.columns == ["task_id", "due_at"]


def test_streamed_drift_is_the_tables_and_alerts_once(spark, tmp_path):
    """Three slices with a restart after each; events in disorder within the delay."""
    rng = random.Random(5)
    events = [(T0 + i * dt.timedelta(minutes=7) + rng.random() * 9 * dt.timedelta(minutes=1), rng.choice("abc") if i % 200 < 140 else rng.choice(["d", None])) for i in range(600)]
    schema = "ts timestamp_ntz, kind string"
    base = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10), ("gone", 3)], "kind string, n long")
    over = lambda rows: drift.windowed(rows, base, "kind", size="6 hours", late="10 minutes")
    for i in range(3):
        spark.createDataFrame(events[i * 200 : (i + 1) * 200], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = over(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).where("fired")
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/alerts").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    alerts = spark.read.parquet(f"{tmp_path}/alerts")
    closed = max(t for t, _ in events) - dt.timedelta(minutes=10)
    table = over(spark.createDataFrame(events, schema)).where("fired").where(F.col("end") <= F.lit(closed))
    assert rows_of(alerts) == rows_of(table) and alerts.count() == alerts.select("start").distinct().count() > 10
    assert over(spark.createDataFrame([], schema)).count() == 0
    none = drift.windowed(spark.createDataFrame(events[:5], schema), base.limit(0), "kind", size="6 hours")
    assert {(r["psi"], r["fired"]) for r in none.collect()} == {(float("inf"), False)}


ENTRY = "task string, at long, n long, v string"


def test_a_ledger_of_many_batches_equals_the_first_writes_and_reads_as_little_at_the_end(spark, tmp_path):
    """Batches of 8 tasks, half of which the ledger has; some come again; buckets are merged and doubled."""
    log = LedgerLog(spark, f"{tmp_path}/log", StructType.fromDDL(ENTRY), "task", "at", "n", buckets=4, bucket_rows=20, most_folders=3)
    rng, every, looked_up, first = random.Random(2), [], [], {}
    for number in range(50):
        fresh = [f"t{number}-{i}" for i in range(4)]
        old = [rng.choice(every)[0] if every else "t" for _ in range(3)]
        rows = [(task, rng.randrange(1000), number * 10 + i, f"v{number}") for i, task in enumerate(fresh + old + [fresh[0]])]
        every += rows
        new = {}
        for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
            new.setdefault(r[0], r)
        new = {k: r for k, r in new.items() if k not in first}
        first |= new
        batch = spark.createDataFrame(rows, ENTRY).coalesce(1)
        assert rows_of(log.append(number, batch)) == sorted(new.values())
        if number % 20 == 7:
            before = log.manifest()
            assert rows_of(log.append(number, batch)) == sorted(new.values()) and log.append(number - 3, batch).count() == 0
            assert log.manifest() == before
        looked_up.append(log.manifest().looked_up)
    held = log.manifest()
    assert rows_of(log.read()) == sorted(first.values()) and held.rows == len(first) and held.buckets > 8
    assert all(len(folders) <= 4 for folders in held.live.values())
    assert sum(looked_up[-15:]) < 2 * sum(looked_up[10:25])


def pair(i, **changed):
    from tests.test_verify import LEDGER, STATEMENT

    return {"task_id": f"t{i}", "ledger": LEDGER, "statement": STATEMENT, "event_id": f"e{i}", "created_at": "2026-01-01T00:00:00Z", **changed}


def test_a_letter_mended_at_the_second_try_enters_the_ledger_once(spark, tmp_path):
    source, target, now = tmp_path / "in", f"{tmp_path}/out", dt.datetime(2026, 1, 2)
    source.mkdir()
    lines = [json.dumps(pair(1)), json.dumps(pair(2))[:-1] + ",", json.dumps(pair(3, difficulty=9.0)), "{hopeless"]
    (source / "a.json").write_text("\n".join(lines) + "\n")
    run = lambda hours: pipeline.run(spark, str(source), target, f"{tmp_path}/cp", attempts=3, backoff_s=3600, now=now + hours * H).awaitTermination()
    tasks = lambda: {r["task_id"]: (r["verdict"], r["source"]) for r in pipeline.ledger(spark, target).read().collect()}
    mend = lambda letters: letters.withColumn("payload", F.regexp_replace("payload", ",$", "}"))
    run(0)
    assert set(tasks()) == {"t1"} and spark.read.parquet(f"{target}/waiting").count() == 3 and spark.read.parquet(f"{target}/dead").count() == 0
    assert pipeline.requeue(spark, target, now + 0.5 * H, mend) == 0
    assert pipeline.requeue(spark, target, now + H, mend) == 3 and pipeline.requeue(spark, target, now + H, mend) == 0
    run(1)
    assert set(tasks()) == {"t1", "t2"} and tasks()["t2"][1] == "model"
    assert pipeline.requeue(spark, target, now + 2 * H, mend) == 0  # the second wait is two hours
    assert pipeline.requeue(spark, target, now + 3 * H, mend) == 2
    run(3)
    assert tasks() == {"t1": tasks()["t1"], "t2": tasks()["t2"], "t3": ("ESCALATE", "system")}
    assert sorted((r["task_id"] or "", r["attempt"]) for r in spark.read.parquet(f"{target}/dead").collect()) == [("", 3), ("t3", 3)]
    assert pipeline.requeue(spark, target, now + 99 * H, mend) == 0
    run(4)
    assert pipeline.ledger(spark, target).read().count() == 3 and spark.read.parquet(f"{target}/verdicts").count() + spark.read.parquet(f"{target}/escalations").count() >= 2
