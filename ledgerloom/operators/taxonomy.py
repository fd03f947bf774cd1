"""The nine exception types, once, as values and as a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: type, weight, severity, resolution, reason.
TAXONOMY = (
    ("AMOUNT_MISMATCH", 1.0, "HIGH", "escalate", "amounts differ beyond tolerance"),
    ("FX_CONVERSION_ERROR", 1.0, "HIGH", "rebook", "implied rate differs from stated"),
    ("BENEFICIARY_MISMATCH", 0.9, "HIGH", "reject", "beneficiary names differ"),
    ("COUNTERPARTY_MISMATCH", 0.9, "HIGH", "reject", "counterparty identifiers differ"),
    ("VALUE_DATE_MISMATCH", 0.6, "MEDIUM", "auto-adjust", "value date invalid or differs"),
    ("MISSING_MESSAGE", 0.6, "MEDIUM", "flag-review", "statement message missing"),
    ("PARTIAL_MATCH", 0.5, "MEDIUM", "flag-review", "fields partially agree, needs review"),
    ("DUPLICATE", 0.2, "LOW", "auto-adjust", "statement duplicates booked instruction"),
    ("FIELD_CORRUPTION", 0.2, "LOW", "flag-review", "malformed field on one side"),
)
#: Fixed: the same of a pair without an exception, and the closed vocabularies of verdicts, severities, resolutions, currencies and messages.
MATCH = ("MATCH", 0.0, "LOW", "auto-adjust", "fields agree within tolerance")
TYPES = tuple(t[0] for t in TAXONOMY)
VERDICTS = ("MATCH", "EXCEPTION", "ESCALATE")
SEVERITIES = ("HIGH", "MEDIUM", "LOW")
RESOLUTIONS = ("auto-adjust", "escalate", "reject", "rebook", "flag-review")
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "BRL")
MESSAGE_TYPES = ("MT103", "MT202", "MT300", "MT940", "pacs.008", "pacs.009", "camt.054", "camt.053", "INTERNAL")
#: Types at least this heavy are HIGH in the weight form of the rules.
HEAVY = 0.9


def dimension(spark: SparkSession) -> DataFrame:
    """Nine rows and MATCH; small by construction."""
    return spark.createDataFrame([*TAXONOMY, MATCH], "exception_type string, weight double, severity string, resolution string, reason string")


def _of(position: int):
    def column(kind: Column) -> Column:
        table = F.create_map(*[F.lit(x) for row in [*TAXONOMY, MATCH] for x in (row[0], row[position])])
        return F.try_element_at(table, kind)

    return column


weight_of, severity_of, resolution_of, reason_of = _of(1), _of(2), _of(3), _of(4)
