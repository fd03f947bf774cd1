"""Links within crowds: many sets that share a band and are compared whole, though not all with each other.

What is alike to a crowd's centre is joined through it, and needs no comparison among itself; what is not is compared with
every member.  A crowd is dealt in blocks of bounded size, pairs of blocks meet in a task, and of the links found there
only as many leave it as join what they join.  No pair is left out: two members that are not compared are both joined to
the centre.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members in a block, and entries of their sets.
MEMBERS, ENTRIES = 1_024, 1 << 21


def _joined(likely: int, similar: float):
    """Links that join each row that asks to all that it is alike to; rows that are told are joined already."""

    def run(rows: pa.Table) -> pa.Table:
        node, first, again = np.unique(rows["node"].to_numpy(), return_index=True, return_inverse=True)
        asks, told = (np.bincount(again, weights=rows[c].to_numpy().astype(float)) > 0 for c in ("asks", "told"))
        lists = lambda c: rows[c].combine_chunks().take(pa.array(first))
        places = np.asarray(pc.list_flatten(lists("m"))).reshape(len(node), -1)
        size = pc.list_value_length(lists("s")).to_numpy(zero_copy_only=False).astype(np.int64)
        sets = np.split(np.asarray(pc.list_flatten(lists("s"))), np.cumsum(size)[:-1])
        label, links = np.arange(len(node)), []
        home = int(told.argmax())
        label[told] = home
        for u in sorted(np.flatnonzero(asks).tolist(), key=lambda i: not told[i]):
            if told[home] and label[u] == label[home] and not told[u]:
                continue
            near = np.flatnonzero(label != label[u])
            near = near[(size[near] >= similar * size[u]) & (size[u] >= similar * size[near]) & (size[near] > 0)]
            near = near[np.count_nonzero(places[near] == places[u], axis=1) >= likely]
            if not len(near):
                continue
            mine, theirs = np.sort(sets[u]), np.concatenate([sets[v] for v in near])
            found = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            common = np.add.reduceat(found.astype(np.int64), np.cumsum(size[near]) - size[near])
            near = near[common >= similar * (size[u] + size[near] - common)]
            groups, one = np.unique(label[near], return_index=True)
            links += [(u, v) for v in near[one].tolist()]
            label[np.isin(label, groups)] = label[u]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": node[a], "b": node[b]})

    return run


def crowd_links(members: DataFrame, fetched: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, str], DataFrame], likely: int, similar: float) -> DataFrame:
    """Links a, b that join all members(crowd, node, size) of a crowd that are alike, directly or by others of it.

    A crowd is named by the node that its members are thought to be like, itself one of them; size is that of a node's set.
    fetched(rows) adds to rows of nodes the places of their signatures, m, and their sets, s; members that share fewer
    than ``likely`` places are not looked up in full.  write(rows, name) keeps rows in the shared folder.
    """

    def counted(rows: DataFrame, name: str) -> DataFrame:
        n = F.greatest(F.ceil(F.count(F.lit(1)) / MEMBERS), F.ceil(F.sum("size") / ENTRIES))
        return rows.groupBy("crowd").agg(n.cast("bigint").alias(name))

    def every(n: str) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)

    def one(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(n))

    def search(rows: DataFrame, name: str) -> DataFrame:
        return write(fetched(rows).groupBy("crowd", "part", "block").applyInArrow(_joined(likely, similar), "a bigint, b bigint"), name)

    held = write(members.join(counted(members, "blocks"), "crowd"), "crowd-members")
    centre = F.col("node") == F.col("crowd")
    blocks = F.explode(F.when(centre, every("blocks")).otherwise(F.array(one("blocks"))))
    near = search(held.select("crowd", "node", F.lit(0).cast("bigint").alias("part"), blocks.alias("block"), F.lit(True).alias("asks"), centre.alias("told")), "crowd-near")
    if held.where("blocks > 1").isEmpty():
        return near
    # across blocks: those that are unlike the centre, in parts of their own, meet every block
    direct = near.select(F.col("a").alias("crowd"), F.col("b").alias("node"), F.lit(True).alias("told")).distinct()
    wide = write(held.where("blocks > 1 AND node <> crowd").join(direct, ["crowd", "node"], "left").withColumn("told", F.coalesce("told", F.lit(False))), "crowd-wide")
    both = wide.join(counted(wide.where("NOT told"), "parts"), "crowd")
    asking = both.where("NOT told").select("crowd", "node", one("parts").alias("part"), F.explode(every("blocks")).alias("block"), F.lit(True).alias("asks"), "told")
    asked = both.select("crowd", "node", F.explode(every("parts")).alias("part"), one("blocks").alias("block"), F.lit(False).alias("asks"), "told")
    return near.union(search(asking.union(asked), "crowd-far"))
