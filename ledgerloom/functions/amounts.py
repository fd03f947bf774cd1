"""Amounts as text, exact decimals and tolerances; nothing here raises, whatever the text or rate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Both tolerances are relative and inclusive.
TOLERANCE = "0.005"
#: A decimal number as written: sign, digits before and after the point, exponent.
NUMBER = r"^(?U)\s*([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d{1,5}))?\s*$"
#: The plain ones of these, which are well formed without a closer look.
PLAIN = r"^\+?(?:[0-9]+(?:\.[0-9]{0,2})?|\.[0-9]{1,2})$"
#: Amounts of more integer digits than this have no exact decimal here and are compared as text.
EXACT = "decimal(30,2)"


def _plain(amount: Column) -> Column:
    """Digits may be grouped by underscores."""
    return F.regexp_replace(amount, "_", "")


def well_formed(amount: Column) -> Column:
    """A number not below zero (minus zero is zero) whose last digit stands for a hundredth or more.

    A lexical test: value-equal texts differ ("1.500" is malformed, "1.50" and "1E2" are not), so nothing
    is cast before it.
    """
    part = lambda i: F.regexp_extract(_plain(amount), NUMBER, i)
    digits = F.concat(part(2), part(3))
    power = F.coalesce(F.nullif(part(4), F.lit("")).try_cast("int"), F.lit(0))
    sound = F.rlike(_plain(amount), F.lit(NUMBER)) & (digits != "") & (power - F.length(part(3)) >= -2) & ((part(1) != "-") | ~F.rlike(digits, F.lit("[1-9]")))
    return F.coalesce(F.when(F.rlike(amount, F.lit(PLAIN)), True).otherwise(sound), F.lit(False))


def exact(amount: Column) -> Column:
    """The number as it stands, else without its underscores and blanks."""
    return F.coalesce(amount.try_cast(EXACT), F.regexp_replace(_plain(amount), r"(?U)\s", "").try_cast(EXACT))


def within_tolerance(a: Column, b: Column) -> Column:
    """|a - b| <= 0.005 * max(|a|, |b|), in whole thousandths so that no digit is lost; null where a or b is."""
    return F.abs(a - b) * 1000 <= F.greatest(F.abs(a), F.abs(b)) * 5


def same_amount(a: Column, b: Column, a_text: Column, b_text: Column) -> Column:
    """Within tolerance; amounts too long for an exact decimal are the same if their texts are."""
    return F.coalesce(within_tolerance(a, b), F.trim(a_text) == F.trim(b_text), F.lit(False))


def fx_holds(ledger: Column, ledger_rate: Column, statement: Column, statement_rate: Column) -> Column:
    """The side with the only rate is the foreign one; foreign = rate * local within tolerance, without dividing.

    Exact for amounts under 10**12 and rates under 10**9 with ten decimals; in doubles beyond.
    """
    one = ledger_rate.isNull() != statement_rate.isNull()
    local = F.when(ledger_rate.isNull(), ledger).otherwise(statement)
    foreign = F.when(ledger_rate.isNull(), statement).otherwise(ledger)
    rate = F.coalesce(ledger_rate, statement_rate)
    written = rate.cast("string").try_cast("decimal(38,18)")
    short = written.try_cast("decimal(19,10)")
    due = F.when(short == written, short) * local.try_cast("decimal(14,2)")
    given = foreign.try_cast("decimal(14,2)")
    near = F.abs(given - due) <= F.lit(TOLERANCE).cast("decimal(4,3)") * F.greatest(F.abs(given), F.abs(due))
    f, d = foreign.cast("double"), rate.cast("double") * local.cast("double")
    roughly = F.abs(f - d) <= float(TOLERANCE) * F.greatest(F.abs(f), F.abs(d))
    return F.coalesce(one & (local != 0) & F.coalesce(near, roughly), F.lit(False))
