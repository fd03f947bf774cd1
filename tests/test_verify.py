import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.taxonomy import TYPES
from ledgerloom.operators.verify import verify
from ledgerloom.sources.pairs import PAIR

BASE = {"message_type": "MT103", "ref": "OUR-1", "amount": "1250.00", "ccy": "USD", "value_date": "2026-08-07", "counterparty": "BANKDEFF", "beneficiary": "Acme Corporation", "fx_rate": None}
LEDGER = {**BASE, "booked_at": "2026-08-05T10:00:00Z"}
STATEMENT = {**BASE, "ref": "CP-1"}

CASES = [
    ("clean", {}, {}, "MATCH"),
    ("no decimals", {}, {"amount": "1250"}, "MATCH"),
    ("lower-case currency", {}, {"ccy": "usd"}, "MATCH"),
    ("padded reference", {}, {"ref": "  CP-1 "}, "MATCH"),
    ("edge of tolerance", {"amount": "1000.00"}, {"amount": "1005.00"}, "MATCH"),
    ("beyond tolerance", {}, {"amount": "1006.00"}, "AMOUNT_MISMATCH"),
    ("rate holds", {}, {"ccy": "EUR", "amount": "1150.00", "fx_rate": 0.92}, "MATCH"),
    ("rate nearly holds", {}, {"ccy": "EUR", "amount": "1150.00", "fx_rate": 0.9245}, "MATCH"),
    ("rate just out", {}, {"ccy": "EUR", "amount": "1150.00", "fx_rate": 0.9255}, "FX_CONVERSION_ERROR"),
    ("rate wrong", {}, {"ccy": "EUR", "amount": "1150.00", "fx_rate": 0.85}, "FX_CONVERSION_ERROR"),
    ("no rate", {}, {"ccy": "EUR", "amount": "1150.00"}, "FX_CONVERSION_ERROR"),
    ("other beneficiary", {}, {"beneficiary": "Zenith Holdings"}, "BENEFICIARY_MISMATCH"),
    ("case variant", {}, {"beneficiary": "acme corporation"}, "MATCH"),
    ("abbreviation", {}, {"beneficiary": "Acme Corp"}, "PARTIAL_MATCH"),
    ("other counterparty", {}, {"counterparty": "XYZZUS33"}, "COUNTERPARTY_MISMATCH"),
    ("cut code", {}, {"counterparty": "BANKDE"}, "PARTIAL_MATCH"),
    ("Saturday", {}, {"value_date": "2026-08-08"}, "VALUE_DATE_MISMATCH"),
    ("late booking", {"booked_at": "2026-08-02T00:00:00Z"}, {}, "VALUE_DATE_MISMATCH"),
    ("booked two days before", {"booked_at": "2026-08-05T23:59:59Z"}, {}, "MATCH"),
    ("unreadable booking", {"booked_at": "soon"}, {}, "MATCH"),
    ("dates differ", {}, {"value_date": "2026-08-06"}, "VALUE_DATE_MISMATCH"),
    ("same reference", {}, {"ref": " OUR-1"}, "DUPLICATE"),
    ("three decimals", {}, {"amount": "1250.000"}, "FIELD_CORRUPTION"),
    ("bad currency", {}, {"ccy": "EURO"}, "FIELD_CORRUPTION"),
    ("bad date", {}, {"value_date": "2026/08/07"}, "FIELD_CORRUPTION"),
    ("short date", {}, {"value_date": "2026-8-7"}, "VALUE_DATE_MISMATCH"),
    ("short date on both sides", {"value_date": "2026-8-7"}, {"value_date": "2026-8-7"}, "MATCH"),
    ("exponent", {"amount": "100.00"}, {"amount": "1E2"}, "MATCH"),
    ("exponent with too many digits", {}, {"amount": "1.25E-1"}, "FIELD_CORRUPTION"),
    ("grouped digits", {}, {"amount": "1_250.00"}, "MATCH"),
    ("seventeen digits", {"amount": "10000000000000000.00"}, {"amount": "90000000000000000.00"}, "AMOUNT_MISMATCH"),
    ("seventeen equal digits", {"amount": "10000000000000000.00"}, {"amount": "10000000000000000.00"}, "MATCH"),
    ("beyond decimals, equal", {"amount": "1E40"}, {"amount": "1E40"}, "MATCH"),
    ("beyond decimals, unlike", {"amount": "1E40"}, {"amount": "2E40"}, "AMOUNT_MISMATCH"),
    ("not a number", {}, {"amount": "NaN"}, "FIELD_CORRUPTION"),
    ("great rate holds", {"amount": "100.00"}, {"ccy": "JPY", "amount": "1000000000.00", "fx_rate": 1e7}, "MATCH"),
    ("great rate fails", {"amount": "100.00"}, {"ccy": "JPY", "amount": "1100000000.00", "fx_rate": 1e7}, "FX_CONVERSION_ERROR"),
    ("rate of seven decimals", {"amount": "1000000.00"}, {"ccy": "EUR", "amount": "1.00", "fx_rate": 0.0000010}, "MATCH"),
    ("rate of seven decimals fails", {"amount": "1000000.00"}, {"ccy": "EUR", "amount": "1.00", "fx_rate": 0.0000014}, "FX_CONVERSION_ERROR"),
    ("tiny rate", {"amount": "100.00"}, {"ccy": "EUR", "amount": "0.00", "fx_rate": 1e-10}, "FX_CONVERSION_ERROR"),
    ("tab at the edge of a name", {}, {"beneficiary": "\tAcme Corporation "}, "MATCH"),
    ("blank name", {}, {"beneficiary": "   "}, "FIELD_CORRUPTION"),
    ("tab in name", {}, {"beneficiary": "Acme\tCorporation"}, "FIELD_CORRUPTION"),
    ("null amount", {}, {"amount": None}, "FIELD_CORRUPTION"),
    ("minus zero", {"amount": "-0.00"}, {"amount": "0.00"}, "MATCH"),
    ("negative", {"amount": "-1.00"}, {"amount": "-1.00"}, "FIELD_CORRUPTION"),
    ("missing", {}, None, "MISSING_MESSAGE"),
]


@pytest.fixture(scope="module")
def kinds(spark):
    rows = [(name, 1, 0.5, {**LEDGER, **l}, None if s is None else {**STATEMENT, **s}, {"verdict": "MATCH"}) for name, l, s, _ in CASES]
    return {r["task_id"]: r for r in verify(spark.createDataFrame(rows, PAIR)).collect()}


@pytest.mark.parametrize("name,expected", [(c[0], c[3]) for c in CASES])
def test_rule(kinds, name, expected):
    assert kinds[name]["kind"] == expected


def test_projection_follows_taxonomy(kinds):
    row = kinds["beyond tolerance"]
    assert (row["verdict"], row["severity"], row["resolution"]) == ("EXCEPTION", "HIGH", "escalate")
    assert kinds["clean"]["severity"] == "LOW"


def test_generated_pairs_are_judged_as_drawn(spark):
    from ledgerloom.operators.generator import generate

    rows = verify(generate(spark, 400, seed=3))
    assert rows.where("drawn <> kind").count() == 0
    assert {r["kind"] for r in rows.select("kind").distinct().collect()} == {*TYPES, "MATCH"}
    again = generate(spark, 400, seed=3).repartition(7)
    assert verify(again).select(F.sum(F.xxhash64("task_id", "kind", "difficulty").cast("decimal(38,0)"))).first() == rows.select(F.sum(F.xxhash64("task_id", "kind", "difficulty").cast("decimal(38,0)"))).first()


def test_no_python_in_the_plan(spark, sf_dir):
    from ledgerloom.plans.views import verified

    assert "Python" not in verified(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_generated_pairs_are_made_and_judged_once(spark):
    """The types that come with the pairs are the verifier's, and reading them draws nothing again."""
    from ledgerloom.operators.generator import generate, judged

    rows = judged(spark, 400, seed=3)
    again = verify(generate(spark, 400, seed=3))
    told = lambda df: sorted((r["task_id"], r["drawn"], r["kind"], r["ledger"], r["statement"]) for r in df.select("task_id", "drawn", "kind", F.to_json("ledger").alias("ledger"), F.coalesce(F.to_json("statement"), F.lit("")).alias("statement")).collect())
    assert told(rows) == told(again) and rows.count() == 400
    assert "md5" not in rows._jdf.queryExecution().executedPlan().toString()
