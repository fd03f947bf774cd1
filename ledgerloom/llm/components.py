"""Connected components of a link table by alternating star contractions.

Each round links every node's larger neighbours, then its smaller ones, to the smallest node met, as
joins on aggregated minima; no round holds a node's neighbours together.  Rounds are written to the
shared folder, so that lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import remove, stage


def _are_stars(edges: DataFrame) -> bool:
    """No node has two smaller ones, and none has both smaller and larger ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    nodes = ends.groupBy("e.n").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return nodes.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node in links(a, b)."""
    spark = links.sparkSession
    both = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    held = stage(both, "links")
    while not _are_stars(held.df):
        edges = held.df
        around = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(edges.select("lo", "hi"))
        least = around.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = around.join(least, "n").where("m > n").select(F.col("m").alias("hi"), F.col("low").alias("lo")).distinct()
        first = stage(large, "star")
        down = first.df.groupBy("hi").agg(F.min("lo").alias("low"))
        small = first.df.join(down, "hi").select(
            F.explode(F.array(F.struct(F.col("hi"), F.col("low").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("low").alias("lo"))))
            .alias("e")
        ).select("e.*").where("hi <> lo").distinct()
        after = stage(small, "links")
        remove(spark, held.path, first.path)
        held = after
    tree = held.df
    roots = tree.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return tree.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
