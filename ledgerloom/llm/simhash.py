"""SimHash fingerprints linked by exact Hamming search in vantage-point shards.

Fingerprints: 64 bits, each the strict majority of that bit over the XXH64 hashes of a text's word
shingles.  Links: fingerprints that differ in at most ``radius`` bits, found among distinct
fingerprints only, so copies cost nothing.

Shards: the bits are cut into ``blocks``; two fingerprints within the radius agree in at least
blocks - radius of them, so under the Hamming distance of one such choice of blocks they lie at
distance 0 of each other and no ball of that distance needs its neighbours.  Each choice of blocks
is a table of shards, keyed by the bits it keeps.  Shards that still hold more than ``shard_rows`` fingerprints are
partitioned by vantage points: a fingerprint of the shard is drawn by hash, its median distance
splits the rest, and rows within ``radius`` of the boundary go to both sides (the triangle bound), so
that no pair is lost.  This repeats until shards are small or a split no longer shrinks them.
Tasks take bundles of shards.  In a shard, a vantage-point tree answers the range query of each
fingerprint, pruning by the same bound (shards of a leaf's size are compared directly), and only a
spanning forest of the links found leaves the task.

Nulls and texts without words have fingerprint 0, linked like any other; texts of fewer words than a
shingle are one shingle.  Null keys take no part in component ids but keep their row.  Repeated rows
share fingerprint and component.  An empty table gives an empty result.  Columns other than key and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import stage

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 14
#: Members of a vantage-point tree's leaf; rows of the shards that one task call links.
_LEAF, BUNDLE_ROWS = 64, 10_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned SimHash of a text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    ones, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + _CHUNK], ends[k + shingle - 1 :])], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["key", "fp"])

    return run


def _masks(blocks: int, radius: int) -> list[int]:
    """One mask for each choice of blocks that must agree for some pair within the radius."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = [sum(c) for c in combinations(each, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in signed]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(points: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, by range queries on a vantage-point tree over uint64 points.

    The queries of a subtree go down together: at each node only those whose distance to the vantage
    point leaves room within the radius follow a branch.
    """
    todo = [(np.arange(len(points)), np.arange(len(points)))]
    while todo:
        members, queries = todo.pop()
        if not len(members) or not len(queries):
            continue
        if len(members) <= _LEAF:
            for m in members:
                near = queries[(np.bitwise_count(points[queries] ^ points[m]) <= radius) & (queries < m)]
                if len(near):
                    yield near, np.full(len(near), m)
            continue
        vantage = points[members[0]]
        d, dq = np.bitwise_count(points[members] ^ vantage).astype(int), np.bitwise_count(points[queries] ^ vantage).astype(int)
        split = int(np.median(d))
        inner, outer = members[d <= split], members[d > split]
        if not len(outer):
            inner, outer = members[d < split], members[d == split]
            split -= 1
        if not len(inner) or not len(outer):
            half = len(members) // 2
            todo += [(members[:half], queries), (members[half:], queries)]
            continue
        todo += [(inner, queries[dq - radius <= split]), (outer, queries[dq + radius > split])]


class _Forest:
    """Union-find over positions; what is linked is told as (member, least member)."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist()):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def stars(self) -> tuple[list[int], list[int]]:
        roots = [self.root(i) for i in range(len(self.parent))]
        members = [i for i, r in enumerate(roots) if i != r]
        return members, [roots[i] for i in members]


def _spanning(radius: int):
    """Links between the fingerprints of a bundle of shards, as stars around the least of each group."""

    def run(bundle: pa.Table) -> pa.Table:
        shard, fp = bundle["shard"].to_numpy(), bundle["fp"].to_numpy()
        order = np.lexsort((fp, shard))
        shard, points = shard[order], fp[order].view(np.uint64)
        names, place = np.unique(fp, return_inverse=True)
        place, forest = place[order], _Forest(len(names))
        begins = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        sizes = np.diff(np.append(begins, len(shard)))
        size = np.repeat(sizes, sizes)
        for apart in range(1, min(_LEAF, int(sizes.max(initial=1)))):  # small shards: all at once, one distance in the order at a time
            i = np.flatnonzero((shard[apart:] == shard[:-apart]) & (size[apart:] <= _LEAF))
            i = i[np.bitwise_count(points[i] ^ points[i + apart]) <= radius]
            forest.link(place[i], place[i + apart])
        for k in np.flatnonzero(sizes > _LEAF).tolist():
            at = place[begins[k] : begins[k] + sizes[k]]
            for left, right in near_pairs(points[begins[k] : begins[k] + sizes[k]], radius):
                forest.link(at[left], at[right])
        members, roots = forest.stars()
        return pa.table({"a": pa.array(names[members], pa.int64()), "b": pa.array(names[roots], pa.int64())})

    return run


def near_links(points: DataFrame, radius: int = 3, blocks: int = 5, shard_rows: int = 4000, depth: int = 6) -> DataFrame:
    """Links a, b (a spanning forest of each shard's) between the distinct fingerprints in points(fp)."""
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(m).cast("long").alias("mask")) for k, m in enumerate(_masks(blocks, radius))])
    kept = points.select("fp", F.explode(tables).alias("x")).select("fp", F.xxhash64("x.t", F.col("fp").bitwiseAND(F.col("x.mask"))).alias("shard"))
    sizes = kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = stage(kept.join(sizes, "shard"), "simhash-shards").df
    ready, crowded = rows.where(f"n <= {shard_rows}").select("shard", "fp"), rows.where(f"n > {shard_rows}")
    for level in range(depth):
        if crowded.isEmpty():
            break
        point = crowded.groupBy("shard").agg(F.min_by("fp", F.xxhash64("fp", F.lit(level))).alias("vantage"))
        far = crowded.join(point, "shard").withColumn("d", _distance(F.col("fp"), F.col("vantage")))
        middle = far.groupBy("shard").agg(F.percentile_approx("d", 0.5).alias("split"))
        sides = F.array_compact(F.array(F.when(F.col("d") <= F.col("split") + radius, 0), F.when(F.col("d") > F.col("split") - radius, 1)))
        dealt = (
            far.join(middle, "shard")
            .withColumn("side", F.explode(sides))
            .select("fp", F.col("n").alias("was"), F.xxhash64("shard", "side", F.lit(level)).alias("shard"))
        )
        sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        rows = stage(dealt.join(sizes, "shard"), f"simhash-shards-{level}").df
        small = F.col("n") <= shard_rows
        stuck = F.col("n") > 0.9 * F.col("was")
        ready = ready.union(rows.where(small | stuck).select("shard", "fp"))
        crowded = rows.where(~small & ~stuck).drop("was")
    else:
        ready = ready.union(crowded.select("shard", "fp"))
    ready = stage(ready, "simhash-ready").df
    bundles = ready.count() // BUNDLE_ROWS + 1
    bundled = ready.withColumn("bundle", F.pmod(F.xxhash64("shard"), F.lit(bundles))).repartition(int(min(bundles, 10_000)), "bundle")
    return bundled.groupBy("bundle").applyInArrow(_spanning(radius), "a bigint, b bigint")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, key: str = "doc_id", text: str = "text", **search) -> DataFrame:
    """key, fp (signed long) and component (the smallest key reachable) of each row."""
    kind = docs.schema[key].dataType.simpleString()
    prints = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_fingerprints(shingle), f"key {kind}, fp bigint")
    prints = stage(prints, "simhash-prints").df
    points = stage(prints.groupBy("fp").agg(F.min("key").alias("first")), "simhash-points").df
    links = stage(near_links(points.select("fp"), radius, **search), "simhash-links").df
    groups = components(links)
    classes = points.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("class"))
    least = classes.groupBy("class").agg(F.min("first").alias("component"))
    named = stage(classes.join(least, "class").select("fp", "component"), "simhash-classes").df
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component")
