"""Names and references: normal forms and near equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Printable ASCII with no blank at its edges: neither to be trimmed nor to be looked at closely.
PLAIN = r"^[!-~](?:[ -~]*[!-~])?$"


def trimmed(x: Column) -> Column:
    return F.when(F.rlike(x, F.lit(PLAIN)), x).otherwise(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", ""))


def squashed(x: Column) -> Column:
    """Upper-cased letters and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]", "")


def tokens(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(x, F.lit(""))), F.lit("[A-Z0-9]{2,}"), F.lit(0)))


def present(x: Column) -> Column:
    """Not blank, and within its blank edges of printable characters and plain spaces only."""
    return F.when(F.rlike(x, F.lit(PLAIN)), True).otherwise(F.rlike(trimmed(x), F.lit(r"^(?:[^\p{C}\p{Z}]| )+$")))


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once, which keeps the generated code small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def near_equal(a: Column, b: Column) -> Column:
    """Token sets nest, or share one and differ in at most two, or one text of four or more characters begins the other."""
    raw = lambda x: F.upper(F.coalesce(x, F.lit("")))

    def compare(t: Column) -> Column:
        both = F.size(F.array_intersect(t["ta"], t["tb"]))
        only_a, only_b = F.size(t["ta"]) - both, F.size(t["tb"]) - both
        prefix = (F.length(t["a"]) >= 4) & (F.length(t["b"]) >= 4) & (F.startswith(t["a"], t["b"]) | F.startswith(t["b"], t["a"]))
        return (
            F.when((F.size(t["ta"]) == 0) | (F.size(t["tb"]) == 0), False)
            .when((only_a == 0) & (only_b == 0), False)
            .when((only_a == 0) | (only_b == 0), True)
            .when((both >= 1) & (only_a + only_b <= 2), True)
            .otherwise(prefix)
        )

    both = F.struct(raw(a).alias("a"), raw(b).alias("b"))
    return _bound(both, lambda x: _bound(F.struct(tokens(x["a"]).alias("ta"), tokens(x["b"]).alias("tb"), x["a"].alias("a"), x["b"].alias("b")), compare))
