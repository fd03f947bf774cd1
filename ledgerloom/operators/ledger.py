"""The audit ledger and its reviews as folds over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whose entry stands when a pair has several.
RANKS = {"human": 0, "model": 1, "system": 2}


def first_write(entries: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The first entry of each key for ever; later ones are ignored."""
    rest = [c for c in entries.columns if c not in (key, at, tie)]
    return entries.groupBy(key).agg(F.min(F.struct(at, tie, *rest)).alias("e")).select(key, "e.*")


def append_new(current: DataFrame, batch: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """What a batch adds to a ledger: the first entries of keys it does not have."""
    return first_write(batch, key, at, tie).join(current.select(key), key, "left_anti")


def current(entries: DataFrame, key: str, at: str, tie: str, source: str = "source") -> DataFrame:
    """A human's entry before a model's before the system's; of one source the last."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col(source)), F.lit(len(RANKS)))
    rest = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct((-rank).alias("r"), F.col(at), F.col(tie))).alias("e")).select(key, "e.*")


def stats(entries: DataFrame, as_of, hours: int = 168, at: str = "created_at") -> DataFrame:
    """Exceptions by type in the window before as_of, system entries left out; hours from 1 to 2160."""
    if not 1 <= hours <= 2160:
        raise ValueError("hours must be from 1 to 2160")
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    kept = entries.where((F.col("source") != "system") & (F.col("verdict") == "EXCEPTION") & (F.col(at) >= since))
    return kept.groupBy(F.coalesce("kind", F.lit("NONE")).alias("exception_type")).agg(F.count(F.lit(1)).alias("n"))


def severity_counts(entries: DataFrame, as_of, hours: int = 168, at: str = "created_at") -> DataFrame:
    """Entries with a verdict by severity in the window before as_of, matches too, system entries left out."""
    if not 1 <= hours <= 2160:
        raise ValueError("hours must be from 1 to 2160")
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    kept = entries.where((F.col("source") != "system") & F.col("verdict").isNotNull() & (F.col(at) >= since))
    return kept.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def overdue(events: DataFrame, as_of, key: str, at: str, tie: str, hours: int = 24) -> DataFrame:
    """The timeouts that are due: one for each review still pending so many hours after it was opened."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    late = fold_reviews(events, key, at, tie).where((F.col("status") == "pending") & (F.col("opened_at") <= since))
    return late.select(key, (F.col("opened_at") + F.make_dt_interval(hours=F.lit(hours))).alias("due_at"))


def fold_reviews(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """State of each review from open / resolve / timeout events.

    The first ending after the first opening decides; later ones, and endings of what was never opened, are refused.
    """
    opened = events.where("action = 'open'").groupBy(key).agg(F.min(F.struct(at, tie)).alias("o"))
    ends = events.where("action <> 'open'").join(opened, key).where(F.struct(F.col(at), F.col(tie)) > F.col("o"))
    first = ends.groupBy(key).agg(F.min(F.struct(at, tie, "action")).alias("e"), F.count(F.lit(1)).alias("ends"))
    state = F.when(F.col("e.action") == "resolve", "resolved").when(F.col("e.action") == "timeout", "timed_out").otherwise("pending")
    return opened.join(first, key, "left").select(key, F.col(f"o.{at}").alias("opened_at"), state.alias("status"), F.greatest(F.coalesce("ends", F.lit(0)) - 1, F.lit(0)).cast("bigint").alias("refused"))


def deadlines(events: DataFrame, as_of, key: str, at: str, tie: str, hours: int = 24) -> DataFrame:
    """key, opened_at, status, ended_at, refused of each review when one that nobody ends in time has timed out.

    An ending at the deadline is in time; later ones are refused, as are all but the first.
    """
    opened = events.where("action = 'open'").groupBy(key).agg(F.min(F.struct(at, tie)).alias("o"))
    wait = F.make_dt_interval(hours=F.lit(hours))
    ends = events.where("action <> 'open'").join(opened, key).where(F.struct(F.col(at), F.col(tie)) > F.col("o"))
    in_time = F.col(at) <= F.col(f"o.{at}") + wait
    first = ends.groupBy(key).agg(F.min(F.when(in_time, F.struct(at, tie, "action"))).alias("e"), F.count(F.lit(1)).alias("ends"))
    due = F.col(f"o.{at}") + wait
    over = F.col("e").isNull() & (due <= F.lit(as_of).cast("timestamp_ntz"))
    status = F.when(F.col("e.action") == "resolve", "resolved").when(F.col("e.action") == "timeout", "timed_out").when(over, "timed_out").otherwise("pending")
    refused = F.coalesce("ends", F.lit(0)) - F.col("e").isNotNull().cast("int")
    return opened.join(first, key, "left").select(key, F.col(f"o.{at}").alias("opened_at"), status.alias("status"), F.coalesce(F.col(f"e.{at}"), F.when(over, due)).alias("ended_at"), refused.cast("bigint").alias("refused"))


def pending(reviews: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """Oldest first; limit from 1 to 1000."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    return reviews.where("status = 'pending'").orderBy("opened_at", key).limit(limit)
