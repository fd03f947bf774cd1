"""Fill-in-the-middle texts: a middle of whole units goes behind what surrounds it, between marks.

A text is cut into n units (lines, as it stands).  The seed and the key draw, by SHA-256, two cuts among
the n + 1 borders of units, whether the text is rewritten, and in which form: ``psm`` (prefix, suffix,
middle) or ``spm`` (suffix, prefix, middle).  A text that is empty or holds a mark stays ``plain``.
``restore`` undoes it with built-in functions alone.

The rewriting is an Arrow-batched pandas UDF: one pass of the unit pattern gathers where units end, as
an array of integers, two lookups in it slice the text, hashlib draws the seed and makes the digest.
A text is held whole in a task, with 8 bytes for each of its units; nothing is shuffled.

Nulls: a null text is an empty one; a null key draws as an empty string would, so all such rows cut at the
same draw.  Repeated rows each have a result, the same one.  An empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its end, or what stands after the last one.
LINES = r"[^\n]*\n|[^\n]+"
#: Before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
_MADE = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that can be found again: none is empty, holds another one, or ends as one begins."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            meets = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b))))
            if not a or meets or (i != j and a in b):
                raise ValueError(f"marks {a!r} and {b!r} can be mistaken for each other")
    return marks


def ends(text: str, unit: regex.Pattern) -> array:
    """Where each unit ends, in code points, after a first entry of 0."""
    return array("Q", [0, *(m.end() for m in unit.finditer(text))])


def rewritten(text: str, seed: str, unit: regex.Pattern, rate: int, spm: int, marks: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, and the text in that form."""
    at, digest = ends(text, unit), hashlib.sha256(seed.encode()).hexdigest()
    n = len(at) - 1
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    cuts = h1 % (n + 1), h2 % (n + 1)
    a, b = at[min(cuts)], at[max(cuts)]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(
    docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = LINES, marks: tuple[str, str, str] = MARKS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output, output_sha256 of each row.

    ``rate`` of 100 texts are rewritten, ``spm`` of 100 of these with the suffix first; the pattern's matches must
    cover a text, as those of lines do.
    """
    marks = _checked(marks)

    @F.pandas_udf(_MADE)
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(unit)
        for texts, keys in batches:
            rows = [rewritten(t, f"{seed}:{k}", pattern, rate, spm, marks) for t, k in zip(texts, keys)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            out["output_sha256"] = [hashlib.sha256(r[4].encode()).hexdigest() for r in rows]
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return docs.select(F.col(key), made(whole, named).alias("made")).select(key, "made.*")


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form was made of."""
    p, s, m = _checked(marks)
    after = lambda mark: F.substring_index(output, mark, -1)
    between = lambda first, then: F.substring_index(F.substring_index(output, then, 1), first, -1)
    psm = F.concat(between(p, s), after(m), between(s, m))
    spm = F.concat(between(p, m), after(m), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
