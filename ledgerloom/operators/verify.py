"""Pair verification: an ordered decision list over a ledger and a statement record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts, dates, names
from .taxonomy import CURRENCIES, reason_of, resolution_of, severity_of


def corrupt(side: Column) -> Column:
    """Any malformed field of one record; a record that is null is not corrupt but missing."""
    sound = (
        amounts.well_formed(side["amount"])
        & F.coalesce(F.upper(side["ccy"]).isin(*CURRENCIES), F.lit(False))
        & dates.value_date(side["value_date"]).isNotNull()
        & names.present(side["ref"])
        & names.present(side["beneficiary"])
        & names.present(side["counterparty"])
    )
    return ~F.coalesce(sound, F.lit(False))


def _judged(pairs: DataFrame) -> DataFrame:
    """pairs with kind: the first rule that fires, or 'MATCH'.  Expected labels are never read.

    Parsed fields are columns of their own, so that each is parsed once however many rules ask for it.
    """
    l, s = F.col("ledger"), F.col("statement")
    fields = {"_there": s.isNotNull(), "_corrupt": corrupt(l) | corrupt(s), "_same": F.upper(l["ccy"]) == F.upper(s["ccy"])}
    for name, side in (("l", l), ("s", s)):
        fields |= {f"_{name}a": amounts.exact(side["amount"]), f"_{name}d": dates.value_date(side["value_date"]), f"_{name}r": names.trimmed(side["ref"])}
        fields |= {f"_{name}t": side["amount"], f"_{name}v": side["value_date"], f"_{name}b": side["beneficiary"], f"_{name}c": side["counterparty"], f"_{name}x": side["fx_rate"]}
    rows = pairs.withColumns(fields | {"_booked": l["booked_at"]})
    c = F.col
    # both dates are texts that parse by now; "2026-8-7" and "2026-08-07" are not the same text
    in_time = dates.due_in_time(c("_ld"), c("_booked")) & (c("_lv") == c("_sv"))

    def name_rule(field: str, other: str) -> Column:
        a, b = c(f"_l{field}"), c(f"_s{field}")
        differs = ~a.eqNullSafe(b) & (names.squashed(a) != names.squashed(b))
        return F.when(differs, F.when(names.near_equal(a, b), "PARTIAL_MATCH").otherwise(other))

    kind = (
        F.when(~c("_there"), "MISSING_MESSAGE")
        .when(c("_corrupt"), "FIELD_CORRUPTION")
        .when(c("_same") & ~amounts.same_amount(c("_la"), c("_sa"), c("_lt"), c("_st")), "AMOUNT_MISMATCH")
        .when(~c("_same") & ~amounts.fx_holds(c("_la"), c("_lx"), c("_sa"), c("_sx")), "FX_CONVERSION_ERROR")
        .when(c("_lr") == c("_sr"), "DUPLICATE")
        .otherwise(F.coalesce(name_rule("b", "BENEFICIARY_MISMATCH"), name_rule("c", "COUNTERPARTY_MISMATCH"), F.when(~in_time, "VALUE_DATE_MISMATCH"), F.lit("MATCH")))
    )
    return once(rows, "kind", kind).drop(*fields, "_booked")


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once a row, however often later expressions use it.

    A generator's output is not inlined into what follows, as a plain column would be.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def verdict_of(kind: Column) -> Column:
    return F.when(kind == "MATCH", "MATCH").otherwise("EXCEPTION")


def verify(pairs: DataFrame) -> DataFrame:
    """pairs with kind ('MATCH' or a type), verdict, severity, resolution and reason; no shuffle."""
    rows = _judged(pairs)
    kind = F.col("kind")
    return rows.withColumns({"verdict": verdict_of(kind), "severity": severity_of(kind), "resolution": resolution_of(kind), "reason": reason_of(kind)})
