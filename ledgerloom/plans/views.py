"""The pair view and its predictions, as DataFrames and as the SQL that other engines run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.taxonomy import MATCH, TAXONOMY, TYPES, severity_of
from ..operators.verify import once, verify
from ..sources.pairs import order_pairs

KINDS = (*TYPES, "MATCH")


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(order_pairs(spark, sf_dir))


def predicted(spark: SparkSession, sf_dir: str, factor: int = 7919) -> DataFrame:
    """Verified pairs with a prediction: by the key times a factor mod 97 null, escalated, the next type, or right."""
    rows = verified(spark, sf_dir).select("k", "task_id", "kind", "verdict", "severity", "resolution", ((F.col("k") % 21) / 10).alias("difficulty"))
    return with_predictions(rows, factor)


def with_predictions(rows: DataFrame, factor: int | Column) -> DataFrame:
    h = F.col("k") * factor % 97
    kinds = F.array(*map(F.lit, KINDS))
    following = F.get(kinds, (F.array_position(kinds, F.col("kind")) % len(KINDS)).cast("int"))
    told = F.when(h < 5, None).when(h < 15, "ESCALATE").when(h < 25, following).otherwise(F.col("kind"))
    rows = once(rows, "told", told)
    told = F.col("told")
    kind = F.when(~told.isin("MATCH", "ESCALATE"), told)
    return rows.withColumns(
        {
            "p_verdict": F.when(told.isin("MATCH", "ESCALATE"), told).when(told.isNotNull(), "EXCEPTION"),
            "p_type": kind,
            "p_severity": F.when(told.isNull(), None).when(told == "ESCALATE", "MEDIUM").otherwise(severity_of(told)),
            "confidence": (F.col("k") * 31 % 101) / 100,
        }
    ).drop("told")


def _values(rows, columns: str) -> str:
    shown = ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)
    return f"(VALUES {shown}) AS {columns}"


TAXONOMY_SQL = f"tax AS (SELECT * FROM {_values([*TAXONOMY, MATCH], 'tax(exception_type, weight, severity, resolution, reason)')})"

PAIRS_SQL = """
base AS (
  SELECT o_orderkey AS k, CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS amt, c_name, n_name, n_name || ' ' || c_mktsegment AS ben,
    CAST(o_orderdate AS DATE) + CAST(CASE isodow(CAST(o_orderdate AS DATE)) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS INTEGER) AS due
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
pairs AS (
  SELECT k, printf('recon-%06d', k) AS task_id, 'OUR-' || k AS l_ref, CAST(amt AS VARCHAR) AS l_amount, 'USD' AS l_ccy,
    strftime(due, '%Y-%m-%d') AS l_date, c_name AS l_cp, ben AS l_ben,
    strftime(due - CAST(k % 3 AS INTEGER), '%Y-%m-%d') || 'T00:00:00Z' AS l_booked, k % 20 <> 16 AS there,
    CASE k % 20 WHEN 17 THEN 'OUR-' || k WHEN 3 THEN '  CP-' || k || ' ' ELSE 'CP-' || k END AS s_ref,
    CASE k % 20 WHEN 1 THEN CAST(CAST(amt * 1.002 AS DECIMAL(18,2)) AS VARCHAR) WHEN 11 THEN CAST(CAST(amt * 1.020 AS DECIMAL(18,2)) AS VARCHAR)
      WHEN 4 THEN CAST(CAST(amt * 0.920 AS DECIMAL(18,2)) AS VARCHAR) WHEN 12 THEN CAST(CAST(amt * 0.850 AS DECIMAL(18,2)) AS VARCHAR)
      WHEN 18 THEN CAST(amt AS VARCHAR) || '0' ELSE CAST(amt AS VARCHAR) END AS s_amount,
    CASE WHEN k % 20 IN (4, 12) THEN 'EUR' WHEN k % 20 = 6 THEN 'usd' ELSE 'USD' END AS s_ccy,
    strftime(CASE WHEN k % 20 = 15 THEN due + CAST(6 - isodow(due) AS INTEGER) ELSE due END, '%Y-%m-%d') AS s_date,
    CASE WHEN k % 20 = 14 THEN 'Qqwv Partners' ELSE c_name END AS s_cp,
    CASE k % 20 WHEN 2 THEN lower(ben) WHEN 13 THEN 'Zzqx Holdings' WHEN 19 THEN n_name ELSE ben END AS s_ben,
    CASE WHEN k % 20 IN (4, 12) THEN CAST(0.92 AS DECIMAL(12,6)) END AS s_fx
  FROM base)"""

_AMOUNT = r"\s*(\+?(\d+(\.\d{0,2})?|\.\d{1,2})|-0+(\.0{0,2})?)\s*"


def _squash(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"


def near_sql(a: str, b: str) -> str:
    t = lambda x: f"list_distinct(regexp_extract_all(upper({x}), '[A-Z0-9]{{2,}}'))"
    ta, tb = t(a), t(b)
    both = f"len(list_intersect({ta}, {tb}))"
    return f"""CASE WHEN len({ta}) = 0 OR len({tb}) = 0 THEN false
      WHEN {both} = len({ta}) AND {both} = len({tb}) THEN false
      WHEN {both} = len({ta}) OR {both} = len({tb}) THEN true
      WHEN {both} >= 1 AND len({ta}) + len({tb}) - 2 * {both} <= 2 THEN true
      ELSE length({a}) >= 4 AND length({b}) >= 4 AND (starts_with(upper({a}), upper({b})) OR starts_with(upper({b}), upper({a}))) END"""


def corrupt_sql(side: str) -> str:
    return f"""(NOT regexp_full_match({side}_amount, '{_AMOUNT}') OR upper({side}_ccy) NOT IN ('USD','EUR','GBP','JPY','CHF','CAD','AUD','BRL')
      OR try_strptime({side}_date, '%Y-%m-%d') IS NULL OR trim({side}_ref) = '' OR trim({side}_ben) = '' OR trim({side}_cp) = '')"""


SAME_AMOUNT_SQL = "abs(la - sa) * 1000 <= 5 * greatest(abs(la), abs(sa))"
FX_SQL = "(s_fx IS NOT NULL AND la <> 0 AND abs(sa - s_fx * la::DECIMAL(18,2)) <= 0.005 * greatest(abs(sa), abs(s_fx * la::DECIMAL(18,2))))"
DATES_SQL = """(isodow(ld) < 6 AND l_date = s_date AND ld <= booked + INTERVAL 2 DAY)"""

VERIFIED_SQL = f"""{PAIRS_SQL},
parsed AS (
  SELECT *, try_cast(l_amount AS DECIMAL(30,2)) AS la, try_cast(s_amount AS DECIMAL(30,2)) AS sa, try_strptime(l_date, '%Y-%m-%d') AS ld,
    try_strptime(s_date, '%Y-%m-%d') AS sd, try_strptime(l_booked, '%Y-%m-%dT%H:%M:%SZ') AS booked FROM pairs),
judged AS (
  SELECT *, CASE WHEN NOT there THEN 'MISSING_MESSAGE'
    WHEN {corrupt_sql('l')} OR {corrupt_sql('s')} THEN 'FIELD_CORRUPTION'
    WHEN upper(l_ccy) = upper(s_ccy) AND NOT {SAME_AMOUNT_SQL} THEN 'AMOUNT_MISMATCH'
    WHEN upper(l_ccy) <> upper(s_ccy) AND NOT {FX_SQL} THEN 'FX_CONVERSION_ERROR'
    WHEN trim(l_ref) = trim(s_ref) THEN 'DUPLICATE'
    WHEN {_squash('l_ben')} <> {_squash('s_ben')} THEN CASE WHEN {near_sql('l_ben', 's_ben')} THEN 'PARTIAL_MATCH' ELSE 'BENEFICIARY_MISMATCH' END
    WHEN {_squash('l_cp')} <> {_squash('s_cp')} THEN CASE WHEN {near_sql('l_cp', 's_cp')} THEN 'PARTIAL_MATCH' ELSE 'COUNTERPARTY_MISMATCH' END
    WHEN NOT {DATES_SQL} THEN 'VALUE_DATE_MISMATCH' ELSE 'MATCH' END AS kind FROM parsed),
{TAXONOMY_SQL},
verified AS (
  SELECT j.*, CASE WHEN kind = 'MATCH' THEN 'MATCH' ELSE 'EXCEPTION' END AS verdict, t.weight, t.severity, t.resolution, t.reason
  FROM judged j JOIN tax t ON j.kind = t.exception_type)"""


def predicted_sql(factor: int = 7919, name: str = "scored") -> str:
    kinds = "[" + ", ".join(repr(k) for k in KINDS) + "]"
    return f"""{name}_told AS (
  SELECT v.*, CAST(k % 21 AS DOUBLE) / 10 AS difficulty, CAST(k * 31 % 101 AS DOUBLE) / 100 AS confidence,
    CASE WHEN k * {factor} % 97 < 5 THEN NULL WHEN k * {factor} % 97 < 15 THEN 'ESCALATE'
      WHEN k * {factor} % 97 < 25 THEN {kinds}[list_position({kinds}, kind) % {len(KINDS)} + 1] ELSE kind END AS told FROM verified v),
{name} AS (
  SELECT s.*, CASE WHEN told IN ('MATCH', 'ESCALATE') THEN told WHEN told IS NOT NULL THEN 'EXCEPTION' END AS p_verdict,
    CASE WHEN told NOT IN ('MATCH', 'ESCALATE') THEN told END AS p_type,
    CASE WHEN told IS NULL THEN NULL WHEN told = 'ESCALATE' THEN 'MEDIUM' ELSE p.severity END AS p_severity,
    kind <> 'MATCH' AS ex, s.weight >= 0.9 AS heavy
  FROM {name}_told s LEFT JOIN tax p ON s.told = p.exception_type)"""


VERIFIED = f"WITH {VERIFIED_SQL} "
CORRECT_SQL = "coalesce(CASE WHEN ex THEN p_verdict = 'EXCEPTION' AND p_type = kind ELSE p_verdict = 'MATCH' END, false)"
CAUGHT_SQL = "coalesce(ex AND p_verdict IS NOT NULL AND CASE WHEN heavy THEN p_verdict <> 'MATCH' ELSE p_type = kind END, false)"
CAUGHT_SEVERITY_SQL = "coalesce(ex AND CASE WHEN severity = 'HIGH' THEN coalesce(p_verdict, 'MATCH') <> 'MATCH' ELSE p_type = kind END, false)"
SCORED = f"WITH {VERIFIED_SQL}, {predicted_sql()} "
