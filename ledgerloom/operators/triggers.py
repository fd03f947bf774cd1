"""Which rules hold of a text, for any number of rules: one automaton of all trigger terms reads the text once.

A rule holds where all its triggers occur.  A trigger of letters, digits, dots, hashes and underscores alone stands for
itself: no letter, digit or dot may come before it and no letter or digit after it; any other trigger may occur
anywhere.  (``functions.text.has_term`` says the same of one term.)  Texts and triggers are lower-case.

The automaton is made from the rule table, which the driver has, and goes to the tasks; a rule is looked at only where
its longest trigger was found.  The work is one pass over each text, and what it finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_ALONE = re.compile(r"[\w.#]+", re.ASCII)
_BEFORE, _AFTER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789."), frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


class Rules:
    """Rules as lists of triggers; a rule without triggers holds of every text, one with a null among them, or null, of none."""

    def __init__(self, rules: list[list[str | None] | None], anywhere: bool = False) -> None:
        terms = sorted({t for triggers in rules for t in triggers or () if t})
        self.ids = {t: i for i, t in enumerate(terms)}
        self.always: list[int] = []
        self.anchored: dict[int, list[tuple[int, frozenset[int]]]] = {}
        for number, triggers in enumerate(rules):
            if triggers is None or None in triggers:
                continue
            needed = {t for t in triggers if t}
            if not needed:
                self.always.append(number)
                continue
            anchor = max(needed, key=lambda t: (len(t), t))
            self.anchored.setdefault(self.ids[anchor], []).append((number, frozenset(self.ids[t] for t in needed)))
        self.automaton = ahocorasick.Automaton()
        for term, i in self.ids.items():
            self.automaton.add_word(term, (i, len(term), not anywhere and _ALONE.fullmatch(term) is not None))
        if terms:
            self.automaton.make_automaton()
        self.any = bool(terms)

    def found(self, text: str) -> set[int]:
        """Terms that occur in a text."""
        held: set[int] = set()
        if not self.any:
            return held
        n = len(text)
        for last, (i, size, alone) in self.automaton.iter(text):
            if i in held:
                continue
            before = last - size
            if not alone or ((before < 0 or text[before] not in _BEFORE) and (last + 1 >= n or text[last + 1] not in _AFTER)):
                held.add(i)
        return held

    def holding(self, text: str) -> list[int]:
        """Numbers of the rules that hold of a text, in order."""
        held = self.found(text)
        return sorted([*self.always, *(number for i in held for number, needed in self.anchored.get(i, ()) if needed <= held)])


def holding(lower: Column, rules: list[list[str]], anywhere: bool = False) -> Column:
    """An array of the numbers of the rules that hold of a lower-case text; null texts have none but those that always hold.

    ``anywhere``: every trigger may occur within a word too, and texts and triggers are taken as they are.
    """

    @F.arrow_udf("array<int>")
    def numbers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = Rules(rules, anywhere)
        for texts in batches:
            # texts stay in Arrow's memory, one at a time is Python's
            yield pa.array((made.holding(t.as_py() or "") for t in texts), pa.list_(pa.int32()), size=len(texts))

    return numbers(lower)
