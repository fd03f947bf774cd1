"""Groups of linked rows: connected components of a table of links, by least label and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import folder, remove


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table in the shared folder, read back: what follows neither recomputes it nor needs the executors that made it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and group (the least node that it can reach) of every node of a link.

    In each round every node takes the least label among its neighbours and its own, and then the label of that label;
    labels at least halve the way to go, so rounds grow with the logarithm of a chain's length.  Each round is a join on
    aggregated minima and is written, so no node's neighbours meet in a task and lineage stays short.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(b, a)).where("x <> y").distinct()
    edges, kept = written(both, "group-links")
    labels, path = written(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("group")), "group-labels")
    while True:
        told = edges.join(labels.select(F.col("node").alias("y"), "group"), "y").groupBy(F.col("x").alias("node")).agg(F.min("group").alias("near"))
        lower = labels.join(told, "node").select("node", "group", F.least("group", "near").alias("low"))
        # a node tells its old label what it has heard, so that whole groups move with one of them
        heard = lower.where("low < group").groupBy(F.col("group").alias("node")).agg(F.min("low").alias("heard"))
        moved, hooked = written(lower.join(heard, "node", "left").select("node", "group", F.least("low", F.coalesce("heard", "low")).alias("low")), "group-hooked")
        jumped = moved.join(moved.select(F.col("node").alias("low"), F.col("low").alias("next")), "low", "left")
        after, now = written(jumped.select("node", F.col("group").alias("was"), F.least("low", F.coalesce("next", "low")).alias("group")), "group-labels")
        remove(edges.sparkSession, path, hooked)
        path, done = now, after.where("was <> group").isEmpty()
        labels = after.select("node", "group")
        if done:
            remove(edges.sparkSession, kept)
            return labels
