"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` places on a ring of 64-bit hashes; a key belongs to the first place at or
after its hash.  A shard takes no more rows than its bound: what overflows goes on clockwise to the
next place of a shard with room.  With ``slack`` 0 the bounds add up to the row count, so that loads
differ by one row at most; a larger slack moves fewer keys when shards are added.

The ring is walked on counts (one number for each of shards x vnodes arcs), never on rows: Spark
counts the keys of each arc, the bounded table of counts decides which ranks of an arc go where, and
a broadcast join of that plan, whose size depends on shards and vnodes only, gives each row its shard
and slot.  Equal rows are folded to one row with a count before the shuffle and stay a range of ranks
until they are written out, in runs of bounded length.  Ranks in an arc come from windows over parts of
it that hold about ``ARC_ROWS`` rows, so neither a crowded arc nor a key that holds a third of all rows
is sorted in one task.

Nulls: a null key is a key like any other; a null text has size ``overhead`` and the checksum of the
empty text.  Repeated rows each get a slot of their own.  An empty table gives an empty result.
Columns other than key and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import inline_table, rank_in, repeated
from .scratch import stage

#: Folded rows of an arc in one window.
ARC_ROWS = 100_000


def _ring(df: DataFrame, shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """Places in ascending order and the shard of each."""
    places = (
        df.sparkSession.range(shards * vnodes)
        .select(F.floor(F.col("id") / vnodes).cast("int").alias("shard"), (F.col("id") % vnodes).alias("nth"))
        .select("shard", F.xxhash64(F.lit("place"), "shard", "nth").alias("at"))
        .orderBy("at", "shard")
        .collect()
    )
    return [p["at"] for p in places], [p["shard"] for p in places]


def deal(counts: list[int], owner: list[int], bounds: list[int]) -> list[dict]:
    """Which ranks of each arc each shard takes, given rows by arc and the shards' bounds.

    Rounds: each arc offers what it holds to its place, in ring order; what is left over goes on to the
    next place whose shard still has room.
    """
    n, room = len(owner), list(bounds)
    filled = [0] * len(bounds)
    taken = [0] * n
    plan = []
    waiting = {a: a for a in range(n) if counts[a]}
    while waiting:
        ahead, nxt = None, [0] * n
        for i in range(2 * n - 1, -1, -1):
            if room[owner[i % n]] > 0:
                ahead = i % n
            nxt[i % n] = ahead
        for arc in sorted(waiting, key=lambda a: (waiting[a] - a) % n):
            place = nxt[waiting[arc]]
            shard = owner[place]
            size = min(room[shard], counts[arc] - taken[arc])
            if size:
                plan.append({"arc": arc, "low": taken[arc], "high": taken[arc] + size, "shard": shard, "base": filled[shard]})
                room[shard] -= size
                filled[shard] += size
                taken[arc] += size
            if taken[arc] == counts[arc]:
                del waiting[arc]
            else:
                waiting[arc] = (place + 1) % n
    return plan


def assign_shards(
    docs: DataFrame, shards: int, vnodes: int = 128, slack: float = 0.0, overhead: int = 8, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, size, text_crc32, shard and slot (gapless from 0 in each shard) of each row."""
    spark = docs.sparkSession
    places, owner = _ring(docs, shards, vnodes)
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    folded = (
        docs.select(F.col(key).alias("key"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body).alias("crc"))
        .groupBy("key", "size", "crc")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("at", F.xxhash64(F.lit("key"), "key"))
        .withColumn("arc", rank_in(places, F.col("at")) % len(places))
    )
    folded = stage(folded, "shard-keys").df
    arcs = folded.groupBy("arc").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("folded"), F.max("copies").alias("longest")).collect()
    by_arc = {r["arc"]: r["n"] for r in arcs}
    counts = [by_arc.get(a, 0) for a in range(len(places))]
    total = sum(counts)
    bounds = [int(total * (1 + slack)) // shards + (s < int(total * (1 + slack)) % shards) for s in range(shards)]
    plan = inline_table(
        spark, deal(counts, owner, bounds), "arc int, low bigint, high bigint, shard int, base bigint"
    )
    parts = inline_table(spark, [{"a": r["arc"], "parts": -(-r["folded"] // ARC_ROWS)} for r in arcs], "a int, parts bigint")
    row = ["key", "size", "crc"]
    dealt = folded.join(F.broadcast(parts), F.col("arc") == F.col("a")).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), *row), F.col("parts")))
    held = dealt.groupBy("arc", "part").agg(F.sum("copies").alias("held"))
    earlier = F.sum("held").over(W.partitionBy("arc").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = held.select("arc", "part", F.coalesce(earlier, F.lit(0).cast("long")).alias("start"))
    before = F.sum("copies").over(W.partitionBy("arc", "part").orderBy("at", *row).rowsBetween(W.unboundedPreceding, -1))
    ranked = dealt.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).join(starts, ["arc", "part"]).withColumn("first", F.col("start") + F.col("before"))
    rows, plan = ranked.alias("r"), F.broadcast(plan).alias("p")
    overlap = (F.col("r.arc") == F.col("p.arc")) & (F.col("first") < F.col("high")) & (F.col("first") + F.col("copies") > F.col("low"))
    begin, end = F.greatest("first", "low"), F.least(F.col("first") + F.col("copies"), F.col("high"))
    ranges = rows.join(plan, overlap).select(*row, "shard", (F.col("base") + begin - F.col("low")).alias("begin"), (end - begin).alias("n"))
    longest = max((r["longest"] for r in arcs), default=0)
    return repeated(ranges, "slot", F.col("begin"), F.col("n"), longest).select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", "slot")
