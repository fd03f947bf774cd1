"""Best-fit packing by exact-complement hashing.

Tasks tokenize whole documents and cut those longer than a sequence.  Which pieces share a sequence
depends on lengths alone, so the plan is made from a histogram with one count a length (``capacity``
numbers, whatever the corpus): the longest length left takes the single, pair or triple of lengths
that fills its gap exactly, as often as the counts allow, until no exact filling is left; the residue
goes best-fit, longest first.  A pattern of the plan stands for as many sequences as its count says.
Pieces then get their rank among those of their length, from windows over (length, bucket) whose
buckets are sized by the length's count, so that no window holds a whole hot length, and look up
their pattern by rank.

Nulls: a null text is an empty one, which has the end id only; a null key is kept.  Repeated rows are
packed once each.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import inline_table
from .scratch import stage

#: Pieces of one length in one window, and most windows in all: beyond so many, windows grow.
BUCKET_ROWS, BUCKETS = 250, 4_000_000
#: Distinct words, and parts of words, whose ids a Python worker keeps.
WORDS_KEPT, PARTS_KEPT = 200_000, 300_000

#: Fixed: how the vocabulary's pre-tokenizer cuts a lower-cased word, for printable ASCII and Latin-1 letters.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as a printable letter: itself, or the next one from 256 on."""
    itself = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in itself]
    return {b: b for b in itself} | {b: 256 + k for k, b in enumerate(rest)}


class _Ids(dict):
    """Ids of a word as little-endian bytes; a word has no separators in it.

    Plain words are cut as the vocabulary's own pre-tokenizer cuts them and their parts go to its
    merges; any other word goes through the whole tokenizer.  Both give the ids that the tokenizer
    gives for the word within a text, since it drops white space and merges within parts only.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model, self.parts = self.tokenizer.model, {}
        self.letters = _byte_letters()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            found = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(shown))
            if len(self.parts) < PARTS_KEPT and len(part) <= 40:
                self.parts[part] = found
        return found

    def __missing__(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            found = b"".join(map(self._part, _PARTS.findall(word.lower())))
        else:
            found = b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self) < WORDS_KEPT and len(word) <= 40:
            self[word] = found
        return found


@lru_cache(maxsize=1)
def _ids(vocabulary: str) -> _Ids:
    """One table a Python worker, kept from task to task."""
    return _Ids(vocabulary)


def _words(text: str) -> list[str]:
    """Cut at white space as the tokenizer knows it, which four separators of str.split are not."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in re.split(r"[ \t\n\v\f\r]+", text) if w]
    return text.split()


def _pieces(vocabulary: str, capacity: int, end_id: int):
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _ids(vocabulary).__getitem__
        for batch in batches:
            keys, out = batch.column(0), ([], [], [], [], [])
            for row, value in enumerate(batch.column(1)):
                body = b"".join(map(of, _words(value.as_py() or ""))) + tail
                for piece, at in enumerate(range(0, len(body), 4 * capacity)):
                    part = body[at : at + 4 * capacity]
                    for column, found in zip(out, (row, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(found)
            row, piece, start, length, crc = out
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["key", "piece", "start", "length", "ids_crc32"],
            )

    return run


Pattern = tuple[tuple[int, ...], int]


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """(lengths, how many sequences hold just these) for a histogram of piece lengths.

    Exact filling with few large pieces left over can cost more than it saves, so the plan is made with
    single, pair and triple complements, with fewer and with none, and the one of fewest sequences holds.
    """
    plans = [_plan(histogram, capacity, most) for most in (3, 2, 1, 0)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan(histogram: dict[int, int], capacity: int, most: int) -> list[Pattern]:
    """The plan when a gap is filled exactly by at most so many lengths."""
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        left[length] = n
    have = mirror = 0
    for length in range(1, capacity + 1):
        if left[length]:
            have |= 1 << length
            mirror |= 1 << (capacity - length)
    patterns: list[Pattern] = []

    def take(lengths: tuple[int, ...]) -> None:
        nonlocal have, mirror
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(left[x] // k for x, k in need.items())
        patterns.append((lengths, times))
        for x, k in need.items():
            left[x] -= k * times
            if not left[x]:
                have &= ~(1 << x)
                mirror &= ~(1 << (capacity - x))

    def pair(total: int, used: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths left that add up to total, beside those used."""
        both = have & (mirror >> (capacity - total)) if 1 < total <= capacity else 0
        while both:
            a = both.bit_length() - 1
            b = total - a
            if a < b:
                return None
            if all(left[x] >= (used + (a, b)).count(x) for x in (a, b)):
                return a, b
            both &= ~(1 << a)
        return None

    def fill(length: int) -> tuple[int, ...] | None:
        gap = capacity - length
        if gap == 0:
            return (length,)
        if most >= 1 and left[gap] >= 1 + (gap == length):
            return length, gap
        if most >= 2 and (two := pair(gap, (length,))):
            return length, *two
        if most < 3:
            return None
        firsts = have & ((1 << gap) - 1)
        while firsts:
            a = firsts.bit_length() - 1
            if 3 * a < gap:
                return None
            if left[a] >= 1 + (a == length) and (two := pair(gap - a, (length, a))):
                return length, a, *two
            firsts &= ~(1 << a)
        return None

    for length in range(capacity, 0, -1):
        while left[length] and (found := fill(length)):
            take(found)
    open_: dict[int, list[Pattern]] = defaultdict(list)
    gaps = 0
    for length in range(capacity, 0, -1):
        n = left[length]
        while n:
            fitting = gaps >> length
            if fitting:
                gap = length + (fitting & -fitting).bit_length() - 1
                lengths, m = open_[gap].pop()
                if m > n:
                    open_[gap].append((lengths, m - n))
                if not open_[gap]:
                    gaps &= ~(1 << gap)
                used = min(m, n)
            else:
                gap, lengths = capacity, ()
                each = capacity // length
                used = n // each if n >= each else n
                if n >= each:
                    lengths, gap = (length,) * (each - 1), capacity - length * (each - 1)
                    n -= used * (each - 1)
                else:
                    used, lengths, gap = 1, (length,) * (n - 1), capacity - length * (n - 1)
                    n = 1
            open_[gap - length].append((lengths + (length,), used))
            if gap > length:
                gaps |= 1 << (gap - length)
            n -= used
    return patterns + [p for held in open_.values() for p in held]


def _intervals(patterns: list[Pattern]) -> list[dict]:
    """For each length, which ranks go to which sequences and where in them."""
    seen: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rows.append({"at": length, "low": seen[length], "high": seen[length] + times, "base": sequence, "offset": offset})
            seen[length] += times
            offset += length
        sequence += times
    return rows


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    pieces = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        _pieces(vocabulary, capacity, end_id), f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )
    pieces = stage(pieces, "pieces").df
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = inline_table(
        spark, _intervals(plan_patterns(histogram, capacity)), "at bigint, low bigint, high bigint, base bigint, offset bigint"
    )
    each = max(BUCKET_ROWS, sum(histogram.values()) // BUCKETS)
    spread = inline_table(spark, [{"at": n, "buckets": -(-c // each)} for n, c in histogram.items()], "at bigint, buckets bigint")
    row = ["key", "piece", "ids_crc32"]
    dealt = (
        pieces.join(F.broadcast(spread), F.col("length") == F.col("at"))
        .drop("at")
        .withColumn("bucket", F.pmod(F.xxhash64(*row), F.col("buckets")))
        .drop("buckets")
    )
    counts = dealt.groupBy("length", "bucket").count()
    before = F.sum("count").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("length", "bucket", F.coalesce(before, F.lit(0).cast("long")).alias("before"))
    ranked = (
        dealt.withColumn("within", F.row_number().over(W.partitionBy("length", "bucket").orderBy(*row, "start")))
        .join(counts, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("within") - 1)
    )
    there = (F.col("length") == F.col("at")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(F.broadcast(plan), there).select(
        F.col("key").alias(key),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"),
        "offset",
    )
