"""Where a verdict goes, what a low confidence makes of it, and what a review makes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .taxonomy import MESSAGE_TYPES, RESOLUTIONS, SEVERITIES, TYPES, VERDICTS, severity_of


def route(verdict: Column, severity: Column, confidence: Column, threshold: float = 0.6, severities: tuple[str, ...] = ("HIGH",)) -> Column:
    """ESCALATE, EXCEPTION or VERDICT."""
    return (
        F.when((verdict == "ESCALATE") | severity.isin(*severities) | (confidence < threshold), "ESCALATE").when(verdict == "EXCEPTION", "EXCEPTION").otherwise("VERDICT")
    )


def route_reason(verdict: Column, severity: Column, confidence: Column, threshold: float = 0.6, severities: tuple[str, ...] = ("HIGH",)) -> Column:
    return (
        F.when(verdict == "ESCALATE", "model escalated")
        .when(severity.isin(*severities), F.concat(F.lit("severity "), severity))
        .when(confidence < threshold, "low confidence")
        .otherwise("")
    )


def override(rows: DataFrame, threshold: float) -> DataFrame:
    """Verdicts below the threshold become escalations without a type; those that did not parse stay as they are."""
    low = F.coalesce(F.col("p_verdict").isNotNull() & (F.col("confidence") < threshold), F.lit(False))
    put = lambda c, v: F.when(low, F.lit(v)).otherwise(F.col(c))
    return rows.withColumns({"p_verdict": put("p_verdict", "ESCALATE"), "p_type": put("p_type", None), "p_severity": put("p_severity", "MEDIUM")})


def fold_review(decision: Column, provisional: Column, final: Column) -> Column:
    """The final verdict (verdict, type, resolution) of a review.

    A change counts if its verdict is a known one; a rejection makes a match that is to be rejected;
    all else keeps the provisional verdict.
    """
    rejected = F.struct(F.lit("MATCH").alias("verdict"), F.lit(None).cast("string").alias("type"), F.lit("reject").alias("resolution"))
    return F.when((decision == "CHANGE") & final["verdict"].isin(*VERDICTS), final).when(decision == "REJECT", rejected).otherwise(provisional)


def normalise(verdict: Column, kind: Column, severity: Column, confidence: Column, resolution: Column, reason: Column) -> Column:
    """A predicted verdict in normal form, or null where verdict or type are unknown or an exception has no type."""
    sound = verdict.isin(*VERDICTS) & F.coalesce(kind.isin(*TYPES), F.lit(True)) & ((verdict != "EXCEPTION") | kind.isNotNull())
    own = F.when(verdict == "EXCEPTION", kind)
    usual = F.coalesce(severity_of(own), F.when(verdict == "ESCALATE", "MEDIUM").otherwise("LOW"))
    made = F.struct(
        verdict.alias("verdict"),
        own.alias("exception_type"),
        F.when(severity.isin(*SEVERITIES), severity).otherwise(usual).alias("severity"),
        F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.coalesce(reason, F.lit("")).alias("reason"),
        F.when(resolution.isin(*RESOLUTIONS), resolution).otherwise("flag-review").alias("resolution"),
    )
    return F.when(F.coalesce(sound, F.lit(False)), made)


#: Fixed: where a review can stand, and how long notes and reasons may be.
STATES = ("resolved", "timed-out", "pending", "rejected")
NOTE, REASON = 2000, 200


def _codes(checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for broken, code in checks]))


def violations(pair: DataFrame) -> Column:
    """Codes of what breaks the wire contract in a pair; an empty array for a sound one.  Dates are left as text (they are judged later)."""
    there = {"ledger": F.col("ledger").isNotNull(), "statement": F.col("statement").isNotNull()}
    checks = [(F.col("task_id").isNull() | (F.length("task_id") == 0), "task_id"), (~there["ledger"], "ledger")]
    for side, is_there in there.items():
        of = F.col(side)
        checks.append((is_there & ~F.coalesce(of["message_type"].isin(*MESSAGE_TYPES), F.lit(False)), f"{side}.message_type"))
        checks += [(is_there & of[f].isNull(), f"{side}.{f}") for f in ("ref", "amount", "ccy", "value_date", "counterparty")]
    if "difficulty" in pair.columns:
        checks.append((~F.col("difficulty").between(0.0, 2.0), "difficulty"))
    if "expected" in pair.columns:
        e = F.col("expected")
        checks += [(e.isNotNull() & ~F.coalesce(e[f].isin(*known), F.lit(False)), f"expected.{f}") for f, known in (("verdict", VERDICTS), ("severity", SEVERITIES))]
        checks += [(e.isNotNull() & e[f].isNull(), f"expected.{f}") for f in ("explanation", "resolution")]
    return _codes(checks)


def verdict_violations(v: Column) -> Column:
    """Codes of what breaks the contract of a verdict(verdict, exception_type, severity, confidence, reason, resolution, review_state)."""
    unknown = lambda f, known: ~F.coalesce(v[f].isin(*known), F.lit(False))
    return _codes(
        [
            (unknown("verdict", VERDICTS), "verdict"),
            (v["exception_type"].isNotNull() & unknown("exception_type", TYPES), "exception_type"),
            (unknown("severity", SEVERITIES), "severity"),
            (~F.coalesce(v["confidence"].between(0.0, 1.0), F.lit(False)), "confidence"),
            (~F.coalesce(F.length(v["reason"]).between(1, REASON), F.lit(False)), "reason"),
            (unknown("resolution", RESOLUTIONS), "resolution"),
            (v["review_state"].isNotNull() & unknown("review_state", STATES), "review_state"),
        ]
    )


def resolution_violations(task_id: Column, decision: Column, note: Column) -> Column:
    """Codes of what breaks the contract of a reviewer's answer."""
    return _codes([(task_id.isNull(), "task_id"), (~F.coalesce(decision.isin("APPROVE", "REJECT", "CHANGE"), F.lit(False)), "decision"), (F.length(note) > NOTE, "note")])


def prompt(ledger: Column, statement: Column) -> Column:
    """The two records as a question's text: keys in order, one a line, a missing record as null."""
    side = lambda s: F.when(s.isNull(), "null").otherwise(F.to_json(s, {"pretty": "true", "ignoreNullFields": "false"}))
    return F.concat(F.lit("Ledger entry:\n"), side(ledger), F.lit("\n\nBank statement:\n"), side(statement))


def loose_object(text: Column, schema: str) -> Column:
    """What stands between the first opening and the last closing brace of a reply, parsed; null where that is no object."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


__all__ = ["fold_review", "loose_object", "normalise", "override", "prompt", "resolution_violations", "route", "route_reason", "verdict_violations", "violations"]
