"""Texts cut into chunks of about so many tokens of four characters, with an overlap, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: characters of a token; how much of the whole text a chunk must at least hold to end at a border.
TOKEN, LEAST = 4, 0.25


def _last(text: Column, backwards: str) -> Column:
    """Where a mark of two signs, told backwards, last begins in a text, from 0; -1 where it does not."""
    p = F.instr(F.reverse(text), backwards)
    return F.when(p > 0, F.length(text) - p - 1).otherwise(F.lit(-1))


def _short(text: Column, size: int, back: int, step: int) -> Column:
    """Chunks of a text of which a chunk can hold a quarter: a fold from cut to cut, a few of them."""
    n = F.length(text)
    none = F.array().cast("array<struct<a:int,b:int>>")
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), none.alias("cuts"))

    def cut(s: Column, _: Column) -> Column:
        at, most = s["at"], F.least(s["at"] + size, n)
        seen = F.substring(text, at + 1, most - at)
        border = at + F.greatest(_last(seen, "\n\n"), _last(seen, " ."))

        def ended(x: Column) -> Column:
            end = F.when((x["most"] < n) & (x["border"] > at + n * F.lit(LEAST)), x["border"] + 1).otherwise(x["most"])
            following = F.greatest(end - back, at + F.lit(step)) if step > 0 else F.greatest(end - back, end)
            return F.struct(following.cast("int").alias("at"), (end >= n).alias("done"), F.concat(s["cuts"], F.array(F.struct(at.cast("int").alias("a"), end.cast("int").alias("b")))).alias("cuts"))

        bound = F.transform(F.array(F.struct(most.alias("most"), border.alias("border"))), ended)
        return F.when(s["done"], s).otherwise(F.get(bound, F.lit(0)))

    stride = step if step > 0 else 1
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(n / F.lit(stride)).cast("int"), F.lit(1)))
    cuts = F.aggregate(steps, begin, cut, lambda s: s["cuts"])
    return F.transform(cuts, lambda c: F.substring(text, c["a"] + 1, c["b"] - c["a"]))


def _long(text: Column, size: int, back: int, step: int) -> Column:
    """Chunks of a text too long for borders to count: one every step."""
    stride = step if step > 0 else size
    last = F.ceil((F.length(text) - size) / F.lit(stride)).cast("int")
    if step > 0 and back <= stride:  # a piece and the beginning of the next one: the text is read once
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
        made = F.transform(F.array(pieces), lambda p: F.transform(F.sequence(F.lit(0), last), lambda k: F.concat(F.get(p, k), F.coalesce(F.left(F.get(p, k + 1), F.lit(back)), F.lit("")))))
        return F.get(made, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * stride + 1, F.lit(size)))


def chunked(text: Column, tokens: int = 2000, overlap: int = 200) -> Column:
    """Chunks of a text, whole and in order, each beginning so many tokens before the one before it ends.

    A chunk ends after the last paragraph's or sentence's end in it if that leaves it more than a quarter of the whole
    text, so borders count in texts of up to four chunks.  A text of one chunk, the empty one too, is that chunk; a null
    has none.
    """
    size, back = tokens * TOKEN, overlap * TOKEN
    n = F.length(text)
    cut = F.when(n * F.lit(LEAST) >= size, _long(text, size, back, size - back)).otherwise(_short(text, size, back, size - back))
    return F.when(text.isNull(), F.array().cast("array<string>")).when(n <= size, F.array(text)).otherwise(cut)
