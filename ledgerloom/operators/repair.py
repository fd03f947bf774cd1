"""Verdicts read back from replies of a model, as an Arrow-batched function of a column."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


_MARKS = re.compile(r'[{}\[\]"]|\\.', re.S)


def _objects(text: str) -> list[str]:
    """Every stretch from an opening brace to the one that closes it, in order of where they begin; what the end cuts off is closed.

    One pass with a stack over brackets and quotation marks; marks outside of all braces are running text.
    """
    found, open_, quoted = [], [], False
    for m in _MARKS.finditer(text):
        mark = m.group()
        if quoted or mark[0] == "\\":
            quoted = quoted and mark != '"'
        elif mark == '"':
            quoted = bool(open_)
        elif mark in "{[":
            if open_ or mark == "{":
                open_.append((mark, m.start()))
        elif open_ and (open_[-1][0] == "{") == (mark == "}"):
            opened, at = open_.pop()
            if opened == "{":
                found.append((at, text[at : m.end()]))
        else:
            open_.clear()
    if open_:
        tail = ('"' if quoted else "") + "".join("}" if mark == "{" else "]" for mark, _ in reversed(open_))
        found.append((open_[0][1], text[open_[0][1] :] + tail))
    return [s for _, s in sorted(found, key=lambda f: f[0])]


def balanced(text: str | None) -> str | None:
    """The first object in a text that parses; an object cut off at the end is closed.

    An outer stretch that does not parse gives way to those in it, so running text in braces does no harm.
    """
    for made in _objects(text or ""):
        try:
            json.loads(made)
        except ValueError:
            continue
        return made
    return None


@F.pandas_udf(StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(balanced)


def parse_verdict(text: Column) -> Column:
    """The verdict object in a model's reply, whatever stands around it, or null."""
    kinds = "verdict string, exception_type string, severity string, confidence double, reason string, resolution string"
    return F.from_json(_repaired(text), kinds)
