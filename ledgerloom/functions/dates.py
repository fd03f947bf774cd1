"""Value dates and booking times, strict and without raising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Dates and times in full digits, which need no format to be read; there is no year 0.
_DATE, _TIME = r"^(?!0000)\d{4}-\d{2}-\d{2}$", r"^(?!0000)\d{4}-\d{2}-\d{2}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\dZ$"


def value_date(x: Column) -> Column:
    four = F.rlike(x, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$"))
    return F.when(F.rlike(x, F.lit(_DATE)), x.try_cast("date")).when(four, F.try_to_timestamp(x, F.lit("yyyy-M-d")).cast("date"))


def booked_date(x: Column) -> Column:
    return F.when(F.rlike(x, F.lit(_TIME)), F.left(x, F.lit(10)).try_cast("date")).otherwise(_loosely_booked(x))


def _loosely_booked(x: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit("yyyy-M-d'T'H:m:s'Z'")).cast("date")


def due_in_time(date: Column, booked_at: Column, lag: int = 2) -> Column:
    """A business day no more than the lag after booking; a booking time that does not parse is no bound."""
    return date.isNotNull() & (F.weekday(date) < 5) & F.coalesce(date <= F.date_add(booked_date(booked_at), lag), F.lit(True))


def next_business_day(date: Column) -> Column:
    return F.date_add(date, F.when(F.weekday(date) >= 5, 7 - F.weekday(date)).otherwise(0))
