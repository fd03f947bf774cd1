"""Exact top-k by inner product: a ball tree in each shard, searched by branch and bound.

Vectors are dealt to shards, queries to blocks, both of bounded bytes; a task has one shard and one
block.  A first wave searches every query block in one shard, which gives each query a k-th score; the
second wave takes that score into all other shards, where it prunes from the root.  No vector goes to a
task twice: with one query block it moves once, with b blocks b times.

A shard's tree is built once a task and searched by all queries of the block together.  Each query first
goes down to the leaf of its best bound, which gives it a k-th score of this shard; then the tree is
walked from the root, at each node with those queries whose bound  q . centre + |q| * radius  is not below
their k-th score, and the child with the higher bounds first, so that scores found there prune the
other.  Equal bounds are still opened, so ties go to smaller ids.  The best k of each shard meet in one
aggregation by query.

Scores are exact integers.  Where the norms of a block's queries and of a shard's vectors multiply to less than
2**53, products of doubles are; beyond that components are multiplied as 64-bit integers, or as unbounded ones
where these could overflow, and pruning bounds have a margin for their rounding.  Components saturate at
2**56 either way, so a score has 38 digits at most; one that does not fit a long is null, its rank right.

A query is a row: it excludes itself only, so another row of its id is a candidate, and each query row
of a repeated id has a result of its own.  Vectors that are null, or hold a null, NaN or infinity, take
no part, neither do those of another length than the query's.  Equal vectors are split by position, so
copies cannot unbalance a tree.  Null ids are candidates, after all others of their score.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import shuffle_partitions, stage

#: Bytes of vectors, as doubles, in a shard and in a query block; vectors of a tree's leaf.
SHARD_BYTES, BLOCK_BYTES, LEAF = 32 << 20, 8 << 20, 128
#: Greatest component; products below EXACT are exact in doubles.
MOST, EXACT, _WIDE = 1 << 56, float(1 << 53), "decimal(38,0)"


class BallTree:
    """A ball tree, halved at the median along the widest axis down to leaves; node i has children 2 * i + 1 and 2 * i + 2."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.members: dict[int, np.ndarray] = {0: np.arange(len(x))}
        self.centres: dict[int, np.ndarray] = {}
        self.radii: dict[int, float] = {}
        self.leaves: set[int] = set()
        todo = [0]
        while todo:
            node = todo.pop()
            at = self.members[node]
            self.centres[node] = x[at].mean(axis=0)
            self.radii[node] = float(np.sqrt(((x[at] - self.centres[node]) ** 2).sum(axis=1).max()))
            if len(at) <= leaf:
                self.leaves.add(node)
                continue
            del self.members[node]
            axis = int(np.argmax(np.ptp(x[at], axis=0)))
            at = at[np.argpartition(x[at, axis], len(at) // 2)]
            self.members[2 * node + 1], self.members[2 * node + 2] = at[: len(at) // 2], at[len(at) // 2 :]
            todo += [2 * node + 1, 2 * node + 2]


class Search:
    """The best k of a shard for each query of a block; ``order`` ranks vectors of equal score, ``own`` is a query's place here or -1.

    x and q are integers; ``floor`` is a score that each query is known to reach, or a little less.
    """

    def __init__(self, x: np.ndarray, order: np.ndarray, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, leaf: int = LEAF) -> None:
        self.order, self.own, self.k, self.queries = order, own, k, q.astype(float)
        near = x.astype(float)
        self.tree, self.norm = BallTree(near, leaf), np.linalg.norm(self.queries, axis=1)
        greatest = float(self.norm.max(initial=0.0)) * float(np.linalg.norm(near, axis=1).max(initial=0.0))
        self.wide = greatest >= EXACT
        kind = object if greatest >= 2.0**62 else np.int64
        self.x, self.q = (x.astype(np.int64).astype(kind), q.astype(np.int64).astype(kind)) if self.wide else (near, self.queries)
        self.kth = np.nextafter(floor, -np.inf) if self.wide else floor.copy()
        self.best_s = np.full((len(q), k), -np.inf, object if self.wide else float)
        self.best_i = np.full((len(q), k), -1)
        self.opened = 0

    def bound(self, node: int, who: np.ndarray) -> np.ndarray:
        """No less than any score in a node, whatever the rounding."""
        centre = self.tree.centres[node]
        slack = self.tree.radii[node] * (1 + 1e-9) + 1e-9 * float(np.linalg.norm(centre))
        return self.queries[who] @ centre + self.norm[who] * slack + 1e-6

    def open(self, node: int, who: np.ndarray) -> None:
        """Scores a leaf's vectors for some queries and keeps each query's best k."""
        at = self.tree.members[node]
        self.opened += len(who)
        score = self.q[who] @ self.x[at].T
        mine = at[None, :] == self.own[who][:, None]
        if not self.wide:
            score[mine] = -np.inf
        hit = np.flatnonzero(((score >= self.kth[who][:, None]) & ~mine).any(axis=1))
        if not len(hit):
            return
        rows = who[hit]
        i = np.concatenate([self.best_i[rows], np.broadcast_to(at, (len(rows), len(at)))], axis=1)
        place = np.where(i >= 0, self.order[i], np.iinfo(np.int64).max)
        if self.wide:
            s = np.concatenate([self.best_s[rows], score[hit].astype(object)], axis=1)
            s[:, self.k :][mine[hit]] = -np.inf
            top = np.array([sorted(range(s.shape[1]), key=lambda c: (-s[r, c], place[r, c]))[: self.k] for r in range(len(rows))])  # noqa: B023
        else:
            s = np.concatenate([self.best_s[rows], score[hit]], axis=1)
            top = np.lexsort((place, -s), axis=1)[:, : self.k]
        self.best_s[rows], self.best_i[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        last = self.best_s[rows, -1].astype(float)
        self.kth[rows] = np.maximum(self.kth[rows], np.nextafter(last, -np.inf) if self.wide else last)

    def run(self) -> None:
        everyone = np.arange(len(self.q))
        done: dict[int, np.ndarray] = {}
        down = [(0, everyone)]
        while down:  # each query to the leaf of its best bound
            node, who = down.pop()
            if node in self.tree.leaves:
                self.open(node, who)
                done[node] = who
                continue
            left = self.bound(2 * node + 1, who) >= self.bound(2 * node + 2, who)
            down += [(child, part) for child, part in ((2 * node + 1, who[left]), (2 * node + 2, who[~left])) if len(part)]
        todo = [(0, everyone)]
        while todo:
            node, who = todo.pop()
            bound = self.bound(node, who)
            alive = bound >= self.kth[who]
            who, bound = who[alive], bound[alive]
            if not len(who):
                continue
            if node in self.tree.leaves:
                if node in done:
                    who = np.setdiff1d(who, done[node], assume_unique=True)
                if len(who):
                    self.open(node, who)
                continue
            children = (2 * node + 1, 2 * node + 2)
            high = [float(self.bound(c, who).mean()) for c in children]
            first, second = children if high[0] >= high[1] else children[::-1]
            todo += [(second, who), (first, who)]

    def found(self) -> Iterator[tuple[int, int, int]]:
        """Query, vector and score."""
        for j, i in zip(*np.nonzero((self.best_i >= 0) & (self.best_s.astype(float) > -np.inf))):
            yield int(j), int(self.best_i[j, i]), int(self.best_s[j, i])


_FOUND = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.decimal128(38, 0))])
_FOUND_ROW = f"query bigint, vec_id bigint, row bigint, score {_WIDE}"


def _searched(k: int, leaf: int):
    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if shard.num_rows and block.num_rows:
            wide = pc.list_value_length(block["v"])
            for width in wide.unique().to_pylist():
                part, held = block.filter(pc.equal(wide, width)), shard.filter(pc.equal(pc.list_value_length(shard["x"]), width))
                if not held.num_rows:
                    continue
                matrix = lambda c: np.asarray(pc.list_flatten(c.combine_chunks()), dtype=np.int64).reshape(-1, width)  # noqa: E731, B023
                rows = held["row"].to_numpy()
                order = np.empty(held.num_rows, np.int64)
                order[np.asarray(pc.sort_indices(held, [("vec_id", "ascending"), ("row", "ascending")], null_placement="at_end"))] = np.arange(held.num_rows)
                at = {int(r): i for i, r in enumerate(rows)}
                own = np.array([at.get(r, -1) for r in part["query"].to_pylist()])
                search = Search(matrix(held["x"]), order, matrix(part["v"]), own, part["floor"].to_numpy(), k, leaf)
                search.run()
                asked = part["query"].to_numpy()
                for j, i, score in search.found():
                    out[0].append(int(asked[j]))
                    out[1].append(int(rows[i]))
                    out[2].append(Decimal(score))
        ids = dict(zip(shard["row"].to_pylist(), shard["vec_id"].to_pylist())) if out[0] else {}
        return pa.table({"query": out[0], "vec_id": [ids[r] for r in out[1]], "row": out[1], "score": out[2]}, _FOUND)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query; each shard sends k at most."""
    entry = F.struct((-F.col("score")).alias("s"), F.col("vec_id").isNull().alias("none"), "vec_id", "row")
    return found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("top"))


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null where the vector can take no part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    top = F.lit(MOST)
    return F.when(whole & (F.size(vector) > 0), F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), -top), top)))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, leaf: int = LEAF
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of quantized vectors for each query row."""
    held = vectors.select(F.col(key).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), quantized(F.col(vector)).alias("v"))
    held = stage(held.where("v IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "topk-vectors").df
    n = held.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q"), F.max(F.size("v")).alias("width")).first()
    width = 8 * (n["width"] or 1)
    shards = max(-(-n["n"] * width // shard_bytes), min(shuffle_partitions(held.sparkSession), -(-n["n"] // (8 * leaf))), 1)
    blocks = max(1, -(-n["q"] * width // block_bytes))
    dealt = held.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    asked = dealt.where("asks").withColumn("block", F.pmod(F.xxhash64(F.lit("q"), "row"), F.lit(blocks)).cast("int"))
    asked = asked.select(F.col("row").alias("query"), "v", "block")
    home = F.col("block") % shards

    def wave(rows: DataFrame, queries: DataFrame) -> DataFrame:
        by = ["shard", "block"]
        return rows.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(_searched(k, leaf), _FOUND_ROW)

    rows = dealt.select("vec_id", "row", F.col("v").alias("x"), F.col("shard").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    none = F.lit(float("-inf"))
    first = stage(wave(rows.where(F.col("shard") == home), asked.withColumns({"floor": none, "shard": home})), "topk-first").df
    kth = _best(first, k).select("query", F.when(F.size("top") == k, -F.element_at("top", k)["s"]).cast("double").alias("floor"))
    others = asked.join(kth, "query", "left").select("query", "v", "block", F.coalesce("floor", none).alias("floor"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    rest = wave(rows.where(F.col("shard") != home), others.where(F.col("shard") != home))
    best = _best(first.union(rest), k)
    names = held.where("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.select("query", F.posexplode("top").alias("at", "t")).join(names, "query").select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).try_cast("bigint").alias("score")
    )
