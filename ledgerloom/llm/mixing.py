"""Mixing sources to target weights by the cube method (balanced sampling).

A source whose target is r times its words takes each of its documents floor(r) times, and once more
with probability p = r - floor(r).  Which documents get the extra copy is drawn by the cube method:
starting from the vector of all p, the flight phase moves along directions in the null space of the
balancing constraints (number of documents, number of words) until a coordinate reaches 0 or 1, so
both totals stay exactly as they were.  The flight runs in parallel on blocks of a source's
documents; each block leaves at most two documents undecided, which are gathered into new blocks
until a source has one block left.  The landing phase then settles its last two documents by the
rounding that misses the word total least.  Documents go from long to short, so that what is left for
the landing is short.

Sizes are word counts of whole texts.  All sums over a source are partial before they are shuffled,
and a source of any size is dealt into blocks by the hash of its documents, so a hot source is only
more blocks.  Rows equal in key, source and size are folded to one unit: m of them are taken
floor(m * r) times in all, and the unit flies with the fraction left, so a row that is repeated a billion
times is one coordinate.  Draws are seeded from source, level and block: reruns agree.  The targets
are found from one row a source, sorted in one task.

Nulls: a null text has size 0; null sources are one source of their own, the last.  Repeated rows
count once each and are taken equally often, or once more.  An empty table gives an empty result.  Where all sizes are 0 nothing is taken.
Columns other than key, text and source are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import WORD, repeated
from .scratch import stage

#: Documents in one flight.
BLOCK_ROWS = 2_000
#: A coordinate this near to 0 or 1 has reached it.
NEAR = 1e-9


def fly(x: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves p through the null space of the constraints (1, x) until at most two entries are between 0 and 1."""
    p = p.copy()
    todo = iter(np.flatnonzero((p > NEAR) & (p < 1 - NEAR)).tolist())
    draws, at = rng.random(len(p)).tolist(), 0
    active: list[int] = []
    while True:
        while len(active) < 3 and (i := next(todo, None)) is not None:
            active.append(i)
        if len(active) < 3:
            break
        a, b, c = active
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for i, d in zip(active, u):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        step = up if draws[at % len(draws)] * (up + down) < down else -down
        at += 1
        for i, d in zip(active, u):
            p[i] += step * d
            if p[i] < NEAR:
                p[i] = 0.0
            elif p[i] > 1 - NEAR:
                p[i] = 1.0
        active = [i for i in active if 0 < p[i] < 1]
    return p


def land(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rounds the at most two undecided entries so that the sum of x is missed least; ties take less."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    best, out = None, p.copy()
    for choice in range(1 << len(open_)):
        taken = np.array([(choice >> k) & 1 for k in range(len(open_))], float)
        miss = (abs(float(((taken - p[open_]) * x[open_]).sum())), float(taken.sum()))
        if best is None or miss < best:
            best, out[open_] = miss, taken
    return out


def _flight(level: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "row", "key"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        seed = zlib.crc32(repr((block["source"].iloc[0], level, int(block["block"].iloc[0]))).encode())
        x = block["size"].to_numpy(float)
        p = fly(x, block["p"].to_numpy(float), np.random.default_rng(seed))
        if block["blocks"].iloc[0] == 1:
            p = land(x, p)
        return block.assign(p=p)

    return run


def targets(sizes: DataFrame) -> DataFrame:
    """source, documents (distinct ones), source_size and target of each source, from sizes(source, size, rows).

    Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ...; targets share all words by
    weight but stop at 3 times the source's words, what is over being shared again.  That is the level
    v with sum(min(3 * size, v * weight)) = all words, found by sorting sources by 3 * size / weight.
    """
    one = W.partitionBy(F.lit(0))
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    by = by.withColumn("nth", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    by = by.withColumn("weight", ((F.col("nth") - 1) % 3 + 1).cast("double")).withColumn("cap", 3.0 * F.col("source_size"))
    order = one.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(
        order.rowsBetween(0, W.unboundedFollowing)
    )
    by = by.withColumn("level", level)
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "nth", "level"))).over(one)
    by = by.withColumn("share", fits["level"])
    return by.select("source", "documents", "source_size", F.least("cap", F.col("share") * F.col("weight")).alias("target"))


def mix_folded(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size, source_size, target, rows and copies: how often the rows that share key, source and size are taken in all."""
    kind = docs.schema[key].dataType.simpleString()
    sized = docs.select(
        F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    folded = stage(sized.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes").df
    goals = stage(targets(folded), "mix-targets").df
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.withColumn("ratio", F.when(F.abs(ratio - F.round(ratio)) < NEAR, F.round(ratio)).otherwise(ratio))
    due = F.col("rows") * F.col("ratio")
    units = folded.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select(
        "key", "d.source", "size", "source_size", "target", "rows", F.floor(due + NEAR).cast("long").alias("whole"), due.alias("due"),
        F.xxhash64("key", "size").alias("row"), F.ceil(F.col("documents") / BLOCK_ROWS).cast("int").alias("blocks"),
    )
    units = units.withColumn("p", F.greatest(F.lit(0.0), F.col("due") - F.col("whole"))).drop("due")
    schema = f"key {kind}, source string, size bigint, source_size bigint, target double, rows bigint, whole bigint, row bigint, blocks int, p double, block int"
    done = units.where("p = 0 OR size = 0").select("key", "source", "size", "source_size", "target", "rows", "whole", F.lit(0.0).alias("p"))
    units = units.where("p > 0 AND size > 0")
    columns, level = done.columns, 0
    while True:
        units = units.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.col("blocks")).cast("int"))
        flown = stage(units.groupBy("source", "block").applyInPandas(_flight(level), schema), f"mix-flight-{level}").df
        between = "p > 0 AND p < 1"
        done = done.unionByName(flown.where(f"NOT ({between})").select(*columns))
        left = flown.where(between)
        if left.isEmpty():
            break
        n = left.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
        units = left.drop("block", "blocks").alias("u").join(n.alias("n"), F.col("u.source").eqNullSafe(F.col("n.source"))).select("u.*", "blocks")
        units = units.select(*[c for c in schema_columns(schema) if c != "block"])
        level += 1
    return done.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "rows", (F.col("whole") + F.col("p").cast("long")).alias("copies")
    )


def schema_columns(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size, source_size, target and copies of each row; size * copies words of it are taken."""
    folded = mix_folded(docs, key, text, source).withColumnRenamed(key, "__key").withColumnRenamed(source, "__source")
    folded = stage(folded, "mix-copies").df
    each, over = F.floor(F.col("copies") / F.col("rows")), F.col("copies") % F.col("rows")
    runs = F.inline(F.array(F.struct(over.alias("n"), (each + 1).alias("taken")), F.struct((F.col("rows") - over).alias("n"), each.alias("taken"))))
    longest = folded.agg(F.max("rows")).first()[0] or 0
    rows = repeated(folded.select("__key", "__source", "size", "source_size", "target", runs), "nth", F.lit(1).cast("long"), F.col("n").cast("long"), longest)
    return rows.select(F.col("__key").alias(key), F.col("__source").alias(source), "size", "source_size", "target", F.col("taken").cast("int").alias("copies"))
