"""Bootstrap intervals: every replicate draws as many rows as there are, with replacement.

Rows are first folded to the few distinct outcomes they can have.  How often n draws pick each outcome
is one multinomial draw over the outcomes' counts, so a replicate costs the same for a thousand rows as
for a hundred billion.  Replicate r draws from a generator seeded by (seed, r): the same in any
partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: More distinct outcomes than this are refused: the table of outcomes travels with the tasks.
OUTCOMES = 10_000
#: Replicates of a study.
REPLICATES = 10_000


def outcomes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct outcomes and how many rows have each."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def _drawn(counts: list[int], seed: int):
    total = sum(counts)
    shares = np.array(counts, float) / total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            drawn = np.stack([np.random.default_rng([seed, int(r)]).multinomial(total, shares) for r in ids])
            at, which = np.nonzero(drawn)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(which), pa.array(drawn[at, which])], ["replicate", "outcome", "w"])

    return run


def folded(rows: DataFrame, columns: list[str]) -> pa.Table:
    """The distinct outcomes and their counts, on the driver: a table of at most OUTCOMES rows."""
    table = outcomes(rows, columns).orderBy(*columns).limit(OUTCOMES + 1).toArrow()
    if table.num_rows > OUTCOMES:
        raise ValueError(f"more than {OUTCOMES} distinct outcomes: fold the columns first")
    return table


def drawn_from(spark: SparkSession, table: pa.Table, columns: list[str], replicates: int = REPLICATES, seed: int = 11) -> DataFrame:
    """replicate, the outcome columns and w, how often the replicate drew that outcome; no rows without outcomes."""
    known = spark.createDataFrame(table.append_column("outcome", pa.array(range(table.num_rows), pa.int64())))
    if not table.num_rows:
        return known.select(F.lit(0).cast("bigint").alias("replicate"), *columns, F.col("n").alias("w"))
    numbered = spark.range(replicates).select(F.col("id").alias("replicate"))
    drawn = numbered.mapInArrow(_drawn(table["n"].to_pylist(), seed), "replicate bigint, outcome bigint, w bigint")
    return drawn.join(F.broadcast(known), "outcome").select("replicate", *columns, "w")


def draws(rows: DataFrame, columns: list[str], replicates: int = REPLICATES, seed: int = 11) -> DataFrame:
    return drawn_from(rows.sparkSession, folded(rows, columns), columns, replicates, seed)


def at_rank(value: Column, rank: Column, n: Column, share: float) -> Column:
    """The value of nearest rank round(share * (n - 1)), half to even."""
    return F.max(F.when(rank == F.bround(F.lit(share) * (n - 1)).cast("bigint"), value))


def interval(values: DataFrame, value: str = "value", by: tuple[str, ...] = (), low: float = 0.025, high: float = 0.975, replicates: int | None = None) -> DataFrame:
    """Nearest-rank percentiles and the mean of replicates, for each group; replicates are a parameter, so groups are small.

    With ``replicates`` given, those that have no row of a group count as 0 there; values are then not below 0.
    """
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    held = F.count(F.lit(1)).over(group)
    n = held if replicates is None else F.lit(replicates).cast("bigint")
    at = F.row_number().over(group.orderBy(value)) - 1 + n - held
    rows = values.select(*by, F.col(value).alias("v"), at.alias("at"), n.alias("n"))
    pick = lambda p: F.round(F.coalesce(at_rank(F.col("v"), F.col("at"), F.col("n"), p), F.lit(0.0)), 4)
    return rows.groupBy(*by).agg(F.max("n").alias("replicates"), F.round(F.sum("v") / F.max("n"), 4).alias("mean"), pick(low).alias("low"), pick(high).alias("high"))


def paired(values: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean difference of two metrics on the same replicates, its interval and a two-sided p.

    The p-value is twice the share of replicates whose sign is not that of the mean; of a mean above zero,
    a difference of zero is on the other side, of any other mean it is not.
    """
    diffs = values.select(*by, (F.col(a) - F.col(b)).alias("value"))
    spans = interval(diffs, by=by)
    means = diffs.groupBy(*by).agg(F.avg("value").alias("point"))
    told = diffs.join(F.broadcast(means), list(by)) if by else diffs.crossJoin(F.broadcast(means))
    other = (F.col("value") <= 0) == (F.col("point") > 0)
    p = told.groupBy(*by).agg(F.avg(other.cast("double")).alias("other"))
    both = spans.join(p, list(by)) if by else spans.crossJoin(p)
    return both.select(
        *by, "replicates", F.col("mean").alias("mean_difference"), "low", "high", ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"),
        F.round(2 * F.least(F.col("other"), 1 - F.col("other")), 4).alias("p_value"),
    )


def metrics(drawn: DataFrame) -> DataFrame:
    """Metrics of each replicate, from draws over (kind, weight, caught, right) and a run's name: run, metric, part, value.

    Accuracy, weighted recall, recall by band of weight and exact recall by type; a part that a
    replicate did not draw has value 0.
    """
    of = F.col("w").cast("double")
    ex, weight = F.col("kind") != "MATCH", F.col("weight")
    band = F.when(weight >= 0.9, "HIGH").when(weight >= 0.5, "MEDIUM").otherwise("LOW")
    per = W.partitionBy("run", "replicate")
    rows = drawn.groupBy("run", "replicate", "kind", "weight").agg(F.sum(of).alias("n"), F.sum(of * F.col("caught")).alias("caught"), F.sum(of * F.col("right")).alias("right"))
    rows = rows.withColumns({"all": F.sum("n").over(per), "all_right": F.sum("right").over(per)})
    whole = rows.groupBy("run", "replicate").agg(
        (F.max("all_right") / F.max("all")).alias("accuracy"), F.coalesce(F.try_divide(F.sum(F.when(ex, weight * F.col("caught"))), F.sum(F.when(ex, weight * F.col("n")))), F.lit(0.0)).alias("recall")
    )
    overall = whole.select("run", "replicate", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit("all").alias("part"), F.col(c).alias("value")) for m, c in (("accuracy", "accuracy"), ("weighted_recall", "recall"))])))
    parts = {"band_recall": (band, "caught"), "type_recall": (F.col("kind"), "right")}
    for metric, (part, hit) in parts.items():
        by = rows.where(ex).groupBy("run", "replicate", part.alias("part")).agg((F.sum(hit) / F.sum("n")).alias("value"))
        overall = overall.union(by.select("run", "replicate", F.lit(metric), "part", "value"))
    return overall


def study(rows: DataFrame, replicates: int = REPLICATES, seed: int = 11) -> DataFrame:
    """run, metric, part, point and the 95 % interval of each metric, for rows(run, kind, weight, caught, right) of several runs."""
    spark, columns = rows.sparkSession, ["kind", "weight", "caught", "right"]
    table = folded(rows, ["run", *columns])
    weighed = spark.createDataFrame(table)
    drawn = weighed.limit(0).select(F.lit(0).cast("bigint").alias("replicate"), *columns, F.col("n").alias("w"), "run")
    for i, run in enumerate(sorted(set(table["run"].to_pylist()))):
        mine = table.filter(pc.equal(table["run"], run))
        drawn = drawn.union(drawn_from(spark, mine, columns, replicates, seed + i).withColumn("run", F.lit(run)))
    point = metrics(weighed.select("run", F.lit(0).alias("replicate"), *columns, F.col("n").alias("w"))).select("run", "metric", "part", F.round("value", 4).alias("point"))
    spans = interval(metrics(drawn), by=("run", "metric", "part"), replicates=replicates)
    return point.join(spans, ["run", "metric", "part"]).select("run", "metric", "part", "point", "low", "high", "replicates")
