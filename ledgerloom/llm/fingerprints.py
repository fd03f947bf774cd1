"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer of a text's UTF-8 bytes is an anchor (a closed syncmer) if, of the hashes of its inner
s-mers, the least stands first or last.  Whether it is one depends on its own bytes alone, so any
passage keeps its anchors wherever it stands, and there is one among any k - s + 1 k-mers in a row.
A fingerprint is the ``keep`` least 32-bit hashes of the text's anchors, eight hex digits each,
ascending; texts of fewer than ``short`` bytes take all their 4-byte pieces for anchors.  The
likeness of two fingerprints is the share of the least ``keep`` of their union that both have, which
estimates the Jaccard similarity of the anchor sets; two empty ones are alike.

``edit_check`` compares each document with an edited one, in which the next document's beginning
replaces its last quarter.  As anchors are context-free the edited fingerprint needs no pass over the
edited text: it is merged from the anchors of the kept part, of the part put in and of the seam.
Sketches are made in one pass and written, four bytes a
hash; the texts are shuffled once, by id, and the beginnings, a quarter of that, once more.  The next id comes
from windows over ranges of ids, whose edges are joined from one row a range.

``anchors`` tells where each anchor stands, which places a passage that two texts share.

Nulls: a null text is empty; a null id sorts first, and the id -2**63 counts as null.  Rows that share an id keep a row each; they have
the same next document, and where that id is repeated its least text serves.  An only document is its
own next one.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import rank_in
from .scratch import stage

K, S, KEEP, SHORT, PIECE = 12, 5, 48, 24, 4
#: How many hashes are expected below the value under which the least are looked for first.
_LOOK = 4 * KEEP
#: Ids in one range, and the most ranges.
RANGE_ROWS, RANGES = 50_000, 1000
_NO_ID = -(1 << 63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once.

    Bytes and texts that a lambda reads for each place must be bound like this: reading them from a row copies them.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(body: Column, at: Column, size: int) -> Column:
    """32 bits of a piece's hash; at counts from 1."""
    return F.xxhash64(F.substring(body, at, F.lit(size))).bitwiseAND(F.lit(0xFFFFFFFF))


def _starts(body: Column, k: int) -> Column:
    """Where the k-mers of the bytes start, from 1."""
    n = F.octet_length(body)
    return F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))


def anchor_places(body: Column, k: int = K, s: int = S) -> Column:
    """Starts, from 1, of the closed syncmers of some bytes."""

    def closed(inner: Column) -> Column:
        def is_anchor(at: Column) -> Column:
            near = [F.get(inner, at + (j - 1)) for j in range(k - s + 1)]
            return F.least(near[0], near[-1]) <= F.least(*near[1:-1])

        return F.filter(_starts(body, k), is_anchor)

    return _let(F.transform(_starts(body, s), lambda at: _hash(body, at, s)), closed)


def _least(hashes: Column, keep: int = KEEP) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, keep)


def _least_of_many(hashes: Column) -> Column:
    """The same, sorting only what lies under a value that some _LOOK of them should; all if these are too few."""

    def pick(many: Column) -> Column:
        under = (F.lit(float(1 << 32)) * _LOOK / F.greatest(F.size(many), F.lit(1))).cast("bigint")
        found = _let(under, lambda u: F.array_distinct(F.filter(many, lambda h: h < u)))
        return _let(found, lambda few: F.when(F.size(few) >= KEEP, F.slice(F.sort_array(few), 1, KEEP)).otherwise(_least(many)))

    return _let(hashes, pick)


def _hashes(body: Column, places: Column) -> Column:
    return F.transform(places, lambda at: _hash(body, at, K))


def anchor_sketch(body: Column, places: Column) -> Column:
    return _least_of_many(_hashes(body, places))


def sketch(body: Column) -> Column:
    """The fingerprint of whole texts, as an array of its hashes."""
    pieces = F.transform(_starts(body, PIECE), lambda at: _hash(body, at, PIECE))
    whole = F.when(F.octet_length(body) > 0, F.array(F.xxhash64(body).bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(F.array().cast("array<bigint>"))
    short = F.when(F.octet_length(body) < PIECE, whole).otherwise(_least(pieces))
    return F.when(F.octet_length(body) < SHORT, short).otherwise(anchor_sketch(body, anchor_places(body)))


def anchors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, at (bytes before it) and hash of every anchor of each row; texts too short for a k-mer have none."""
    held = lambda body: _let(anchor_places(body), lambda places: F.transform(places, lambda at: F.struct((at - 1).alias("at"), _hash(body, at, K).alias("hash"))))
    found = F.explode(_let(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), held))
    return docs.select(F.col(key).alias("key"), found.alias("a")).select(F.col("key").alias(key), "a.at", "a.hash")


def shown(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two sketches; each is used once, so that it is computed once."""

    def compare(x: Column, y: Column) -> Column:
        least = _least(F.array_union(x, y))
        both = F.size(F.array_intersect(least, F.array_intersect(x, y)))
        return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(both / F.size(least))

    return _let(a, lambda x: _let(b, lambda y: compare(x, y)))


def neighbours(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, before (the id whose next document this one is) and need (the most characters that takes)."""
    ids = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.char_length(text), F.lit(0)).alias("n"))
    ids = stage(ids.groupBy("id").agg((F.max("n") / 4).cast("int").alias("need")), "print-ids").df
    ranges = min(RANGES, ids.count() // RANGE_ROWS + 1)
    bounds = []
    if ranges > 1:
        bounds = sorted(set(ids.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 10_000)).first()[0]))
    ids = ids.withColumn("range", rank_in(bounds, F.col("id")))
    last = ids.groupBy("range").agg(F.max("id").alias("last"), F.max_by("need", "id").alias("last_need"))
    order = W.partitionBy(F.lit(0)).orderBy("range")
    end = W.partitionBy(F.lit(0)).orderBy(F.col("range").desc())
    edge = [
        F.coalesce(F.lag(c).over(order), F.first(c).over(end.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias(f"edge_{c}")
        for c in ("last", "last_need")
    ]
    edges = last.select("range", *edge)
    inside = W.partitionBy("range").orderBy("id")
    return ids.select("id", "range", F.lag("id").over(inside).alias("b"), F.lag("need").over(inside).alias("bn")).join(F.broadcast(edges), "range").select(
        "id", F.coalesce("b", "edge_last").alias("before"), F.coalesce("bn", "edge_last_need").alias("need")
    )


def edit_check(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row."""
    links = stage(neighbours(docs, key, text), "print-links").df
    id_ = F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("id")
    rows = docs.select(id_, F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = F.char_length("text")
    kept_text = F.left(F.col("text"), n - (n / 4).cast("int"))

    def sketched(body: Column, kept: Column, at: Column, hashes: Column) -> Column:
        first = F.slice(hashes, 1, F.size(F.filter(at, lambda a: a + (K - 1) <= kept)))
        whole = F.when(F.octet_length(body) < SHORT, sketch(body)).otherwise(_least_of_many(hashes))
        return F.struct(whole.alias("all"), _least_of_many(first).alias("kept"))

    def with_places(body: Column, kept: Column) -> Column:
        return _let(anchor_places(body), lambda at: _let(_hashes(body, at), lambda hashes: sketched(body, kept, at, hashes)))

    prints = _let(F.encode("text", "UTF-8"), lambda body: _let(F.octet_length(kept_text), lambda kept: with_places(body, kept)))
    small = lambda c: F.transform(c, lambda h: (h - (1 << 31)).cast("int"))  # noqa: E731  stored in four bytes
    large = lambda c: F.transform(c, lambda h: h.cast("bigint") + (1 << 31))
    made = rows.select("id", F.xxhash64("text").alias("tid"), prints.alias("p"))
    prints = stage(made.select("id", "tid", small(F.col("p.all")).alias("all"), small(F.col("p.kept")).alias("kept")), "print-sketches").df

    begins = rows.join(links, "id").select("before", F.struct(F.left("text", F.col("need")).alias("begin"), F.xxhash64("text").alias("tid"), "id").alias("x"))
    begins = begins.groupBy("before").agg(F.min("x").alias("x"))
    both = rows.join(begins, F.col("id") == F.col("before")).select("id", F.xxhash64("text").alias("tid"), F.col("x.id").alias("next_id"), F.col("x.tid").alias("next_tid"), n.alias("n_chars"), kept_text.alias("left"), F.left("x.begin", (n / 4).cast("int")).alias("put"))
    lb, pb = F.encode("left", "UTF-8"), F.encode("put", "UTF-8")
    edited_body = F.encode(F.concat("left", "put"), "UTF-8")
    seam = F.concat(F.substring(lb, F.greatest(F.octet_length("left") - (K - 2), F.lit(1)), F.lit(K - 1)), F.substring(pb, F.lit(1), F.lit(K - 1)))
    of = lambda b: _let(b, lambda x: anchor_sketch(x, anchor_places(x)))
    short = F.octet_length("left") + F.octet_length("put") < SHORT
    put_in = F.when(short, _let(edited_body, sketch)).otherwise(F.concat(of(pb), of(seam)))
    both = both.select("id", "tid", "next_id", "next_tid", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(edited_body, 256).alias("edited_sha256"), short.alias("short"), put_in.alias("put_in"))
    own = prints.groupBy("id", "tid").agg(F.first("all").alias("own"), F.first("kept").alias("kept"))
    following = prints.groupBy(F.col("id").alias("next_id"), F.col("tid").alias("next_tid")).agg(F.first("all").alias("next"))
    whole = both.join(own, ["id", "tid"]).join(following, ["next_id", "next_tid"])
    edited = F.when(F.col("short"), F.col("put_in")).otherwise(_least(F.concat(large(F.col("kept")), F.col("put_in"))))
    whole = whole.select("id", "n_chars", "edited_sha256", large(F.col("own")).alias("own"), large(F.col("next")).alias("next"), F.explode(F.array(edited)).alias("edited"))
    return whole.select(
        F.nullif(F.col("id"), F.lit(_NO_ID)).cast(docs.schema[key].dataType).alias(key),
        "n_chars",
        "edited_sha256",
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
