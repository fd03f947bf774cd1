"""Near copies: texts whose sets of five-word shingles are 0.8 alike or more, found by SimHash and by MinHash bands and checked exactly.

SimHash (the search of ``simhash``, fingerprints within 3 bits) comes first; bands find what is alike beyond its reach.

Words are as in simhash: ASCII lower case, split at blanks; a text of fewer than five words is one
shingle.  Texts of equal sets fold to one node before anything is compared.  Of each node's set the
minima under 100 orders make 20 bands of 5; a pair of similarity j shares a band with probability
1 - (1 - j**5) ** 20, so of pairs at 0.8 one in 2,800 is missed, at 0.9 none in practice.  SimHash alone
does not do: at 0.8 its fingerprints differ in about 10 of 64 bits, and an exact search by blocks at a
radius that holds most of these pairs would need some 15,000 tables.

Candidate pairs that share fewer than ``LIKELY`` of the 100 minima are dropped: of pairs at 0.8 one in a
million (five standard deviations).  Every other pair is checked by the exact Jaccard similarity of the
sets before it is linked.  Sets are made once, of the nodes that share a band with any other, and dealt by node.
Bands of up to ``CROWD`` nodes give all their pairs.  A larger one has a centre: the node whose bands are the most
crowded in all, which in a group of copies is the one with the fewest edits, and the same in nearly all of the group's
bands.  Bands of one centre are one crowd.  Its members are compared with the centre, and those that are unlike it with
all other members (``operators.crowds``), so that what is joined by any pair of a crowded band is joined.

Nulls and texts without words are one node.  An empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.crowds import crowd_links
from . import simhash
from .bytestext import BLANK, LOWER, as_bytes, mixed, prefix_sums, slices, span_hashes, tokens
from .components import components
from .scratch import only, sent, shuffle_partitions, stage, stage_by

SHINGLE, SIMILAR = 5, 0.8
ROWS, BANDS = 5, 20
#: Nodes of a band that are no crowd; minima that a pair shares.
CROWD, LIKELY = 8, 60
_draw = random.Random(5)
_ORDERS = np.array([_draw.getrandbits(64) | 1 for _ in range(ROWS * BANDS)], np.uint64)
_PLACES = np.array([_draw.getrandbits(64) | 1 for _ in range(SHINGLE)], np.uint64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending in each, and where each text's begin, with the end last."""
    body, offsets = as_bytes(texts)
    begins, ends, rows = tokens(~BLANK[body], offsets)
    n = np.bincount(rows, minlength=len(texts))
    words = np.append(span_hashes(prefix_sums(LOWER[body]), begins, ends), np.zeros(SHINGLE, np.uint64))
    first = np.cumsum(n) - n
    nth = np.arange(len(rows)) - first[rows]
    at = np.flatnonzero(nth <= np.maximum(n - SHINGLE, 0)[rows])
    size = np.minimum(n, SHINGLE)[rows[at]]
    h = size.astype(np.uint64)
    for k in range(SHINGLE):
        h = h + np.where(k < size, words[at + k] * _PLACES[k], np.uint64(0))
    h, rows = mixed(h), rows[at]
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.append(True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]))[: len(h)]
    return h[new], np.append(0, np.cumsum(np.bincount(rows[new], minlength=len(texts))))


def _nodes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(h[a:b].tobytes()) for a, b in zip(at, at[1:])], np.uint64).view(np.int64)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node, the minima, the size of the set and the SimHash fingerprint of each text."""
    for batch in batches:
        for part in slices(batch):
            h, at = shingle_sets(part.column(1))
            full = np.flatnonzero(np.diff(at))
            least = np.zeros((part.num_rows, len(_ORDERS)), np.int32)
            if len(full):
                for k, a in enumerate(_ORDERS):
                    least[full, k] = (np.minimum.reduceat(h * a, at[full]) >> np.uint64(16)).astype(np.uint32).view(np.int32)
            minima = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(_ORDERS)), pa.array(least.ravel()))
            prints = np.array([simhash.fingerprint(x.as_py()) for x in part.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_nodes(h, at)), minima, pa.array(np.diff(at).astype(np.int32)), pa.array(prints.view(np.int64))], ["key", "node", "minima", "size", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            h, at = shingle_sets(part.column(1))
            shingles = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(h, at)), shingles], ["node", "shingles"])


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are SIMILAR."""
    one, other = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where(F.col("common") >= SIMILAR * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b that share LIKELY minima or more."""
    one, other = nodes.select(F.col("node").alias("a"), F.col("minima").alias("ma")), nodes.select(F.col("node").alias("b"), F.col("minima").alias("mb"))
    same = F.size(F.filter(F.zip_with("ma", "mb", lambda x, y: x == y), lambda e: e))
    return pairs.join(one, "a").join(other, "b").where(same >= LIKELY).select("a", "b")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of nodes(node, fp) that SimHash links: of each fingerprint one node meets its others and those of the fingerprints linked to it."""
    points = stage(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "near-points").df
    same = nodes.join(points, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    links = simhash.near_links(points.select("fp"))
    one, other = points.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), points.select(F.col("fp").alias("b"), F.col("rep").alias("rb"))
    across = links.join(one, "a").join(other, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    return stage(same.union(across).distinct(), "near-simhash").df


def near_links(nodes: DataFrame, sets_of, crowd: int = CROWD) -> DataFrame:
    """Links a, b between the nodes in nodes(node, minima, size, fp); sets_of(nodes) gives the sets of some, dealt by node."""
    bands = [F.xxhash64(F.lit(b), F.slice("minima", b * ROWS + 1, ROWS)) for b in range(BANDS)]
    rows, told = nodes.select("node", F.explode(F.array(*bands)).alias("band")), simhash_pairs(nodes)
    met = sent(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-met")
    shared = stage(rows.join(met, "band"), "near-shared").df
    typical = shared.groupBy("node").agg(F.sum("n").alias("typical"))
    sets = sets_of(typical.select("node").union(told.select("a")).union(told.select("b")).distinct())
    several = shared.where(f"n <= {crowd}").groupBy("band").agg(F.sort_array(F.collect_list("node")).alias("m"))
    lower = several.select("m", F.posexplode("m").alias("i", "b"))
    pairs = lower.select(F.explode(F.slice("m", F.lit(1), F.col("i"))).alias("a"), "b")
    likely = stage(_likely(pairs.union(told).distinct(), nodes), "near-pairs").df
    found = stage(_alike(likely, sets), "near-links").df
    many = shared.where(f"n > {crowd}").join(typical, "node")
    centres = sent(many.groupBy("band").agg(F.max_by("node", F.struct("typical", F.xxhash64("node"))).alias("crowd")), "near-centres")
    members = many.join(centres, "band").select("crowd", "node").distinct().join(nodes.select("node", "size"), "node")

    def fetched(some: DataFrame) -> DataFrame:
        return some.join(nodes.select("node", F.col("minima").alias("m")), "node").join(sets.select("node", F.col("shingles").alias("s")), "node")

    return found.union(crowd_links(members, fetched, lambda df, name: stage(df, f"near-{name}").df, LIKELY, SIMILAR))


def least_keys(docs: DataFrame, key: Column, text: str = "text") -> DataFrame:
    """key: the least of each group of rows that are linked as near copies, once a group; null keys are no row's."""
    return only(docs.sparkSession, "near-least", lambda: _least_keys(docs, key, text))


def _least_keys(docs: DataFrame, key: Column, text: str) -> DataFrame:
    rows = docs.select(key.alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    prints = stage(rows.mapInArrow(_prints, f"key {kind}, node bigint, minima array<int>, size int, fp bigint"), "near-prints").df
    parts = shuffle_partitions(docs.sparkSession)
    nodes = stage_by(prints.groupBy("node").agg(F.min("key").alias("key"), F.first("minima").alias("minima"), F.first("size").alias("size"), F.min("fp").alias("fp")), "near-nodes", "node", parts, dealt=True)

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = sent(some.join(nodes.select("node", "key"), "node").select("key"), "near-wanted")
        texts = rows.join(wanted, "key", "left_semi").select("key", "text").mapInArrow(_sets, "node bigint, shingles array<bigint>")
        return stage_by(texts.repartition(parts, "node").dropDuplicates(["node"]), "near-sets", "node", parts, dealt=True)

    groups = components(near_links(nodes, sets_of))
    classes = nodes.select("node", "key").join(groups, "node", "left")
    return classes.groupBy(F.coalesce("component", "node").alias("class")).agg(F.min("key").alias("key")).select("key")
