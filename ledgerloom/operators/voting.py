"""Majority vote over repeated samples of a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def majority(samples: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """key, winner, votes, valid and confidence (votes among the samples that parsed).

    Equal counts go to the value met first from the second sample on; where every valid sample differs
    the first one wins.  Counts are made by key and value before anything is ranked.
    """
    valid = samples.where(F.col(value).isNotNull())
    counted = valid.groupBy(key, value).agg(
        F.count(F.lit(1)).alias("votes"), F.min(position).alias("first"), F.min(F.when(F.col(position) > 0, F.col(position))).alias("later")
    )
    by = W.partitionBy(key)
    counted = counted.withColumns({"valid": F.sum("votes").over(by), "most": F.max("votes").over(by)})
    place = F.when(F.col("most") == 1, F.col("first")).otherwise(F.coalesce("later", "first"))
    top = counted.where("votes = most").withColumn("nth", F.row_number().over(by.orderBy(place, value))).where("nth = 1")
    return top.select(key, F.col(value).alias("winner"), "votes", "valid", F.round(F.col("votes") / F.col("valid"), 4).alias("confidence"))
