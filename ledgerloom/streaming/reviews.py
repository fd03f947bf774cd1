"""Reviews as keyed state with event-time timers: opened once, ended once, timed out when nobody ends them in time.

What arrives is kept in a review's state until the watermark has passed it, so acts are taken in the order of
their time whatever the order of arrival within the watermark's delay.  Opening sets a timer; an act that ends
the review first clears it; otherwise it fires and the review has timed out, and a later ending is refused.  State and
timers live in the RocksDB state store and are restored from the checkpoint, so a restart neither loses a timer nor
fires one twice.  Timers go off to the millisecond, which is what watermarks have.

A bucket of keys is one state, as calls to the state store cost more than the acts: what waits, pending reviews and ended ones
are lists, of which ended ones are only added to, and one timer stands at the next act or deadline of any key.

``operators.ledger.deadlines`` is the same over a table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Status of a review after an act that ends it.
ENDINGS = {"resolve": "resolved", "timeout": "timed_out"}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(review: tuple | None, waiting: list[tuple], until: int, wait: int) -> tuple[tuple | None, list[tuple], list[tuple]]:
    """The review and what still waits once all up to a time has happened, and (status, at, by) of what did.

    ``review`` is (opened at, n, status) or None; ``waiting`` holds acts (at, n, action); times are microseconds.
    An act at the very time of the deadline comes before it.
    """
    told: list[tuple] = []

    def expire(before: int) -> None:
        nonlocal review
        if review and review[2] == "pending" and review[0] + wait < before:
            review = (*review[:2], "timed_out")
            told.append(("timed_out", review[0] + wait, "timer"))

    due = sorted(a for a in waiting if a[0] <= until)
    for at, n, action in due:
        expire(at)
        if action == "open":
            review = review or (at, n, "pending")
        elif review is None:
            continue
        elif review[2] == "pending":
            review = (*review[:2], ENDINGS[action])
            told.append((review[2], at, "act"))
        else:
            told.append(("refused", at, "act"))
    expire(until + 1)
    return review, [a for a in waiting if a[0] > until], told


class Timeouts(StatefulProcessor):
    """The reviews of a bucket of keys; see the module's text."""

    def __init__(self, key: str, kind: str, hours: float) -> None:
        self.key, self.kind, self.wait = key, kind, int(hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        review = f"key {self.kind}, opened long, n long, status string"
        self.pending, self.ended = handle.getListState("pending", review), handle.getListState("ended", review)
        self.waiting = handle.getListState("waiting", f"key {self.kind}, at long, n long, action string")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            times = batch["us"].tolist()
            names = [None] * len(times) if key[0] == NULLS else batch[self.key].tolist()
            self.waiting.appendList(list(zip(names, times, batch["n"].tolist(), batch["action"].tolist())))
            first = min(times) if first is None else min(first, min(times))
        if first is not None:
            self._wake(first // 1000 - 1)  # a timer fires once the watermark is past it
        return iter(())

    def _wake(self, ms: int | None) -> None:
        """The bucket's one timer stands at the earlier of where it was and the given time."""
        was = self.timer.get()[0] if self.timer.exists() else None
        if ms is not None and (was is None or ms < was):
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1) * 1000 + 999
        acts, left = defaultdict(list), []
        for name, at, n, action in self.waiting.get():
            if at <= until:
                acts[name].append((at, n, action))
            else:
                left.append((name, at, n, action))
        pending = {r[0]: tuple(r[1:]) for r in self.pending.get()}
        others = acts.keys() - pending.keys()
        ended = {r[0]: tuple(r[1:]) for r in self.ended.get() if r[0] in others} if others else {}
        out, over, kept = [], [], {}
        for name in pending.keys() | acts.keys():
            was = ended.get(name)
            review, _, told = advance(was or pending.get(name), acts.get(name, []), until, self.wait)
            out += [(name, review[0], *t) for t in told]
            if review is not None and review[2] == "pending":
                kept[name] = review
            elif review is not None and was is None:
                over.append((name, *review))
        if over:
            self.ended.appendList(over)
        for state, old, new in ((self.waiting, acts, left), (self.pending, kept != pending, [(name, *r) for name, r in kept.items()])):
            if old and new:
                state.put(new)
            elif old:
                state.clear()
        due = [a[1] // 1000 - 1 for a in left] + [(r[0] + self.wait) // 1000 - 1 for r in kept.values()]
        self._wake(min(due, default=None))
        if out:
            yield self._rows(out)

    def _rows(self, told: list[tuple]) -> pd.DataFrame:
        name, opened, status, at, by = zip(*told)
        when = lambda us: pd.Series(pd.to_datetime(us, unit="us", utc=True)).astype("datetime64[us, UTC]")
        text = lambda values: pd.Series(values, dtype=object)
        return pd.DataFrame({self.key: text(name), "opened_at": when(opened), "status": text(status), "at": when(at), "by": text(by)})

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


#: Buckets that keys are dealt to, fixed for the life of a checkpoint; a bucket's reviews are read and written together.
BUCKETS = 256
#: The bucket of null keys alone: among them whole numbers would come to pandas as floats.
NULLS = -1


def timeouts(acts: DataFrame, key: str, at: str = "at", n: str = "n", hours: float = 24, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """What happens to reviews of a stream acts(key, at, n, action): key, opened_at, status, at, by.

    status is resolved, timed_out or refused (an ending of a review that has ended); by tells an act from a timer.  Start it within ``rocks``, in
    update mode.
    """
    kind = acts.schema[key].dataType.simpleString()
    timed = acts.select(F.col(key), F.col(at).cast("timestamp").alias("at"), F.col(n).cast("long").alias("n"), "action").withWatermark("at", late)
    rows = timed.withColumn("us", F.unix_micros("at")).withColumn("bucket", F.when(F.col(key).isNull(), NULLS).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))))
    return rows.groupBy("bucket").transformWithStateInPandas(Timeouts(key, kind, hours), f"{key} {kind}, opened_at timestamp, status string, at timestamp, by string", "Update", "EventTime")
