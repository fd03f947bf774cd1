"""Queries over payments: memos and their triples, generated benchmarks, contracts and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence, ledger, routing, score
from ..operators.generator import generate
from ..operators.verify import verify
from ..sources.pairs import order_pairs
from . import views
from .corpus import _triples_sql
from .events import _ENTRIES, _REVIEWS, entries, review_acts
from .registry import query, table
from .views import PAIRS_SQL, SCORED, VERIFIED

#: Fixed: fields of payment messages that memos of this view name, by message type: tag and label.
MESSAGE_FIELDS = (
    ("MT103", "Tag20", "SenderReference"), ("MT103", "Tag32A", "ValueDateCurrencyAmount"), ("MT103", "Tag50a", "OrderingCustomer"), ("MT103", "Tag59a", "BeneficiaryCustomer"), ("MT103", "Tag71A", "DetailsOfCharges"),
    ("MT202", "Tag20", "SenderReference"), ("MT202", "Tag21", "RelatedReference"), ("MT202", "Tag32A", "ValueDateCurrencyAmount"), ("MT202", "Tag58a", "BeneficiaryInstitution"),
    ("MT300", "Tag30T", "TradeDate"), ("MT300", "Tag30V", "ValueDate"), ("MT300", "Tag36", "ExchangeRate"),
    ("pacs.008", "PmtId", "PaymentIdentification"), ("pacs.008", "EndToEndId", "EndToEndIdentification"), ("pacs.008", "Cdtr", "Creditor"),
    ("camt.053", "Stmt", "StatementIdentification"), ("camt.053", "Ntry", "Entry"),
)
#: Rules of payments, over the words of memos.
RULES = [
    ("MT202", "MessageType", "COVERS", "CoverPayment", "PaymentInstruction", ["mt202", "cover"], 0.9, ["cover payment"]),
    ("MT103", "MessageType", "CONFLICTS_WITH", "CoverPayment", "PaymentInstruction", ["mt103", "customer transfer"], 0.85, ["customer transfer"]),
    ("MT300", "MessageType", "APPLIES_TO", "ForeignExchangeTrade", "Instrument", ["mt300", "trade"], 0.9, ["confirms a trade"]),
    ("PaymentVersusPayment", "SettlementSystem", "MITIGATES", "SettlementRisk", "Risk", ["both legs", "settle"], 0.8, ["both legs settle together"]),
]
#: Questions with the verdict they should get from these rules.
PROBES = [
    ("P1", "Does the MT202 message cover a cover payment?", "SUPPORT"),
    ("P2", "Does MT103 serve as the cover payment of a customer transfer?", "CONTRADICT"),
    ("P3", "Which message confirms a foreign exchange trade, MT300?", "SUPPORT"),
    ("P4", "Who won the football match on Sunday?", "SILENT"),
]
_MEMOS = (
    "Order {k} went out by MT 103 as a customer transfer in USD.",
    "The bank sent MT202 for the cover of order {k}. It settled.",
    "An MT300 confirms the trade behind order {k}!\nBoth legs settle at once.",
    "Order {k} came as pacs.008, see camt.053.",
    "Order {k} was cancelled, no message xmt103 of it.",
)
_MEMO_SQL = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN replace('{m}', '{{k}}', CAST(o_orderkey AS VARCHAR))" for i, m in enumerate(_MEMOS)).replace("\n", "' || chr(10) || '") + " END AS text FROM orders"


def memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of text on each order."""
    k = F.col("o_orderkey")
    said = F.get(F.array(*map(F.lit, _MEMOS)), (k % len(_MEMOS)).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.replace(said, F.lit("{k}"), k.cast("string")).alias("text"))


_FIELD_VALUES = ", ".join(f"('{m}', '{t}', '{n}')" for m, t, n in MESSAGE_FIELDS)


@query(
    f"WITH f(m, tag, label) AS (VALUES {_FIELD_VALUES}), d AS ({_MEMO_SQL}), q AS (SELECT doc_id, ' ' || regexp_replace(replace(lower(text), 'mt ', 'mt'), '[^a-z0-9.]', ' ', 'g') || ' ' AS p FROM d)"
    " SELECT m AS head, tag || ' ' || label AS tail, count(*) AS n, min(doc_id) AS first FROM q JOIN f ON contains(p, ' ' || lower(m) || ' ') OR contains(p, ' ' || lower(m) || '.') GROUP BY ALL"
)
def message_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the message types that memos name."""
    fields = spark.createDataFrame(MESSAGE_FIELDS, "message_type string, tag string, label string")
    rows = evidence.message_fields(memos(spark, sf_dir), fields, "doc_id", "text")
    return rows.groupBy("head", "tail").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("first"))


@query(f"WITH d AS ({_MEMO_SQL}) SELECT 'USD' AS name, count(*) AS n FROM d WHERE regexp_matches(lower(text), '(^|[^a-z0-9.])usd($|[^a-z0-9])')")
def named_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.named(memos(spark, sf_dir), ("USD", "EUR", "GBP"), "Currency", "doc_id", "text")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(
    _triples_sql(RULES, _MEMO_SQL) + ", s AS (SELECT source, head, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|' || chr(10) || '+'),"
    " lambda x: contains(lower(x), lower(triggers[1]))) AS hits FROM triples) SELECT source, head, coalesce(left(trim(hits[1]), 220), '') AS evidence FROM s"
)
def sentence_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence with the first trigger of each rule that a memo fulfils."""
    return evidence.extract(memos(spark, sf_dir), evidence.facts_table(spark, RULES), "doc_id", "text").select("source", "head", "evidence")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.extract(memos(spark, sf_dir), evidence.facts_table(spark, RULES), "doc_id", "text")
    kept = evidence.merge_relations(found).select("head", "relation", "tail")
    rules = evidence.facts_table(spark, RULES).select(F.xxhash64("head", "relation", "tail").alias("id"), "head", "relation", "tail", "aliases")
    return rules.join(kept, ["head", "relation", "tail"], "left_semi")


_PROBE_VALUES = ", ".join(f"('{i}', '{t}')" for i, _, t in PROBES)


@query(f"SELECT id, target, target AS verdict, true AS agrees FROM (VALUES {_PROBE_VALUES}) AS p(id, target)")
def probe_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether questions get the verdicts they should from the rules that memos fulfil."""
    probes = spark.createDataFrame(PROBES, "id string, question string, target string")
    return evidence.probe_agreement(probes, _graph(spark, sf_dir))


@query()
def pair_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's verdict on every pair's claim."""
    return evidence.ground_pairs(views.verified(spark, sf_dir), "task_id", _graph(spark, sf_dir))


SEEDS = (7, 11)


def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many generated pairs a seed as there are customers, judged."""
    rows = generate(spark, table(spark, sf_dir, "customer").count(), SEEDS)
    return verify(rows).select("seed", "task_id", "difficulty", F.col("drawn").alias("expected"), "kind")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pairs as two benchmarks: a label that somebody gave each, right for most, and the verifier's own verdict."""
    rows = views.predicted(spark, sf_dir)
    return rows.select(F.when(F.col("k") % 2 == 0, 7).otherwise(11).cast("bigint").alias("seed"), "task_id", "difficulty", F.coalesce("p_type", F.lit("MATCH")).alias("expected"), "kind")


_LABELLED = (
    SCORED + ", g AS (SELECT CAST(CASE WHEN k % 2 = 0 THEN 7 ELSE 11 END AS BIGINT) AS seed, task_id, difficulty, coalesce(p_type, 'MATCH') AS expected, kind FROM scored),"
    " l AS (SELECT g.*, t.weight AS w, g.expected <> 'MATCH' AS exc, CASE WHEN t.severity = 'HIGH' THEN kind <> 'MATCH' ELSE kind = expected END AS hit FROM g JOIN tax t ON t.exception_type = g.expected),"
    " p AS (SELECT seed, count(*) AS n, count(*) FILTER (WHERE kind = expected) AS agreed, round(count(*) FILTER (WHERE kind = expected)::DOUBLE / count(*), 4) AS oracle_agreement,"
    " round(coalesce(sum(w) FILTER (WHERE exc AND hit) / sum(w) FILTER (WHERE exc), 0), 4)::DOUBLE AS weighted_recall FROM l GROUP BY seed) "
)


@query(_LABELLED + "SELECT * FROM p")
def pilot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the verifier agrees with the labels of each of two benchmarks."""
    return score.pilot(labelled(spark, sf_dir)).select("seed", "n", "agreed", "oracle_agreement", "weighted_recall")


@query(_LABELLED + "SELECT count(*) AS seeds, CAST(sum(n) AS BIGINT) AS n, min(oracle_agreement) AS oracle_agreement_min FROM p")
def pilot_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.pilots(score.pilot(labelled(spark, sf_dir)))


@query(_LABELLED + "SELECT seed, expected, count(*) AS n FROM g GROUP BY ALL")
def pilot_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.pilot_distribution(labelled(spark, sf_dir))


@query(_LABELLED + "SELECT seed, task_id, expected, kind FROM g WHERE kind <> expected")
def pilot_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that the verifier judges otherwise than they are labelled."""
    return score.disagreements(labelled(spark, sf_dir))


@query("SELECT CAST(s AS BIGINT) AS seed, true AS difficulty_sound, true AS exceptions_sound, true AS mix_sound FROM (VALUES (7), (11)) AS t(s)")
def generator_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated pairs against what they are drawn from: mean difficulty near 0.7, exceptions as probable as their difficulty says, types by the mix.

    Each within six standard deviations (difficulty 0.35; shares at most 0.5) of as many draws.
    """
    from ..operators.generator import MIX, _of, exception_probability

    rows = benchmarks(spark, sf_dir).withColumn("due", exception_probability(F.col("difficulty")))
    ex, n = F.col("expected") != "MATCH", F.count(F.lit(1))
    by = rows.groupBy("seed").agg(n.alias("n"), F.avg("difficulty").alias("d"), (F.avg(ex.cast("double")) - F.avg("due")).alias("e"))
    types = rows.where(ex).groupBy("seed", "expected").agg(n.alias("k"))
    total = types.groupBy("seed").agg(F.sum("k").alias("all"))
    off = types.join(total, "seed").groupBy("seed").agg(F.max(F.abs(F.col("k") / F.col("all") - _of(MIX, F.col("expected"))) * F.sqrt("all")).alias("off"))
    near = lambda c, deviation: F.abs(c) <= 6 * deviation / F.sqrt("n")
    return by.join(off, "seed").select("seed", near(F.col("d") - 0.7, 0.35).alias("difficulty_sound"), near(F.col("e"), 0.5).alias("exceptions_sound"), (F.col("off") <= 3.0).alias("mix_sound"))


#: Ledger and statement amounts, dates and rates at the edges of the rules, and the verdict that the rules' words give.
_EDGES = (
    ("10000000000000000.00", "USD", "2026-01-05", None, "90000000000000000.00", "USD", "2026-01-05", None, "AMOUNT_MISMATCH"),
    ("100.00", "USD", "2026-01-05", None, "1E2", "USD", "2026-01-05", None, "MATCH"),
    ("100.00", "USD", "2026-01-05", None, "100.000", "USD", "2026-01-05", None, "FIELD_CORRUPTION"),
    ("100.00", "USD", "2026-01-05", None, "100.00", "USD", "2026-1-5", None, "VALUE_DATE_MISMATCH"),
    ("100.00", "USD", "2026-01-05", None, "1000000000.00", "JPY", "2026-01-05", 1e7, "MATCH"),
    ("1000000.00", "USD", "2026-01-05", None, "1.00", "EUR", "2026-01-05", 1.4e-6, "FX_CONVERSION_ERROR"),
    ("1000.00", "USD", "2026-01-05", None, "1005.00", "USD", "2026-01-05", None, "MATCH"),
    ("1000.00", "USD", "2026-01-05", None, "1006.00", "USD", "2026-01-05", None, "AMOUNT_MISMATCH"),
)


@query("SELECT o_orderkey AS k, CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{e[8]}'" for i, e in enumerate(_EDGES)) + " END AS kind FROM orders")
def verdict_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair at one of eight edges of the rules for each order."""
    k = F.col("o_orderkey")
    side = "struct<amount:string,ccy:string,value_date:string,fx_rate:double>"
    edges = F.from_json(F.lit(_edges_json()), f"array<struct<l:{side},s:{side}>>")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.get(edges, (k % len(_EDGES)).cast("int")).alias("e"))
    names = [F.lit("Acme").alias("counterparty"), F.lit("Acme").alias("beneficiary")]
    made = lambda s, ref: F.struct(F.lit("MT103").alias("message_type"), F.lit(ref).alias("ref"), *names, F.col(f"e.{s}.amount"), F.col(f"e.{s}.ccy"), F.col(f"e.{s}.value_date"), F.col(f"e.{s}.fx_rate"), F.lit("2026-01-04T00:00:00Z").alias("booked_at"))
    return verify(rows.select("k", made("l", "OUR").alias("ledger"), made("s", "CP").alias("statement"))).select("k", "kind")


def _edges_json() -> str:
    import json

    fields = ("amount", "ccy", "value_date", "fx_rate")
    return json.dumps([{"l": dict(zip(fields, e[:4])), "s": dict(zip(fields, e[4:8]))} for e in _EDGES])


@query(
    f"WITH {PAIRS_SQL} SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN k % 9 = 0 THEN 'task_id' END, CASE WHEN k % 8 = 0 THEN 'ledger.message_type' END,"
    " CASE WHEN k % 7 = 0 THEN 'ledger.amount' END, CASE WHEN k % 6 = 0 AND there THEN 'statement.counterparty' END, CASE WHEN k % 5 = 0 THEN 'difficulty' END], lambda x: x IS NOT NULL)) AS code FROM pairs) GROUP BY code"
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a field broken here and there, by the code of what is broken."""
    k, l, s = F.col("k"), F.col("ledger"), F.col("statement")
    rows = order_pairs(spark, sf_dir).select(
        F.when(k % 9 != 0, F.col("task_id")).alias("task_id"),
        l.withField("message_type", F.when(k % 8 == 0, "MT999").otherwise(l["message_type"])).withField("amount", F.when(k % 7 != 0, l["amount"])).alias("ledger"),
        s.withField("counterparty", F.when(k % 6 != 0, s["counterparty"])).alias("statement"),
        F.when(k % 5 == 0, 2.5).otherwise(1.0).alias("difficulty"),
    )
    return rows.select(F.explode(routing.violations(rows)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    VERIFIED + "SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN k % 4 = 0 THEN 'confidence' END, CASE WHEN k % 3 = 0 THEN 'reason' END, CASE WHEN k % 5 = 0 THEN 'review_state' END,"
    " CASE WHEN k % 7 = 0 THEN 'exception_type' END], lambda x: x IS NOT NULL)) AS code FROM verified) GROUP BY code"
)
def verdict_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with a field broken here and there, by the code of what is broken."""
    k = F.col("k")
    v = F.struct(
        "verdict", F.when(k % 7 == 0, "ODD").when(F.col("kind") != "MATCH", F.col("kind")).alias("exception_type"), "severity", F.when(k % 4 == 0, 1.5).otherwise(0.5).alias("confidence"),
        F.when(k % 3 == 0, F.repeat(F.lit("x"), 201)).otherwise(F.col("reason")).alias("reason"), "resolution", F.when(k % 5 == 0, "lost").alias("review_state"),
    )
    rows = views.verified(spark, sf_dir).select(F.explode(routing.verdict_violations(v)).alias("code"))
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {PAIRS_SQL} SELECT task_id, 'Ledger entry:' || chr(10) || '{{' || chr(10) || '  \"amount\" : \"' || l_amount || '\",' || chr(10) || '  \"ref\" : \"' || l_ref || '\"' || chr(10) || '}}' || chr(10) || chr(10) || 'Bank statement:' || chr(10) ||"
    " CASE WHEN there THEN '{' || chr(10) || '  \"amount\" : \"' || s_amount || '\",' || chr(10) || '  \"fx_rate\" : ' || CASE WHEN s_fx IS NULL THEN 'null' ELSE '0.92' END || chr(10) || '}' ELSE 'null' END AS prompt FROM pairs"
)
def pair_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question that a pair is put as, over some of its fields."""
    s = F.col("statement")
    short = F.when(s.isNotNull(), F.struct(s["amount"].alias("amount"), s["fx_rate"].alias("fx_rate")))
    return order_pairs(spark, sf_dir).select("task_id", routing.prompt(F.struct(F.col("ledger.amount"), F.col("ledger.ref")), short).alias("prompt"))


@query(
    VERIFIED + "SELECT CASE WHEN k % 3 <> 2 THEN verdict END AS verdict, CASE WHEN k % 3 <> 2 AND kind <> 'MATCH' THEN kind END AS exception_type, count(*) AS n FROM verified GROUP BY ALL"
)
def loose_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with talk before and after an object, and some without one, read by their outer braces."""
    whole = F.to_json(F.struct("verdict", F.when(F.col("kind") != "MATCH", F.col("kind")).alias("exception_type")))
    told = F.when(F.col("k") % 3 == 0, F.concat(F.lit("I think\n"), whole, F.lit(" so."))).when(F.col("k") % 3 == 1, whole).otherwise("none")
    rows = views.verified(spark, sf_dir).select(routing.loose_object(told, "verdict string, exception_type string").alias("v"))
    return rows.groupBy("v.verdict", "v.exception_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (WHERE o_orderkey % 3 <> 2) AS chunks, count(*) FILTER (WHERE o_orderkey % 3 <> 2) AS relations, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS doubtful FROM orders")
def chunk_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples in replies of a language model: names trimmed, a missing confidence set to 0.7, replies without an object left out."""
    k = F.col("o_orderkey")
    reply = F.when(k % 3 == 0, '```json\n{"entities": [{"name": " MT103 ", "type": "MessageType"}], "relations": [{"head": " MT103", "relation": "COVERS", "tail": "X "}]}\n```')
    reply = reply.when(k % 3 == 1, '{"relations": [{"head": "MT103", "relation": "COVERS", "tail": "X", "confidence": 0.9}]}').otherwise("I cannot say.")
    rows = table(spark, sf_dir, "orders").select(evidence.coerce_chunk(reply).alias("c")).where("c IS NOT NULL")
    flat = rows.select(F.explode("c.relations").alias("r"))
    counted = flat.where("r.head = 'MT103' AND r.tail = 'X'").agg(F.count(F.lit(1)).alias("relations"), F.sum((F.col("r.confidence") == 0.7).cast("bigint")).alias("doubtful"))
    return rows.agg(F.count(F.lit(1)).alias("chunks")).crossJoin(counted)


@query(
    "SELECT p_partkey, upper(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) AS shouted, lower(trim(p_name)) AS quiet, array_to_string(list_slice(string_split(regexp_replace(trim(p_name), '\\s+', ' ', 'g'), ' '), 1, 1), ' ')"
    " || CASE WHEN len(string_split(regexp_replace(trim(p_name), '\\s+', ' ', 'g'), ' ')) > 1 THEN '...' ELSE '' END AS short FROM part"
)
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.cased(n, F.lit(0.0)).alias("shouted"), T.cased(n, F.lit(1.0)).alias("quiet"), T.first_words(n, 1).alias("short"))


@query(
    "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g') AS name"
    " FROM (SELECT p_partkey, replace(p_name, ' ', '') || 'MT' || p_partkey || 'Type' AS x FROM part)"
)
def camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts written as one word with a number in it, split again."""
    joined = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("MT"), F.col("p_partkey").cast("string"), F.lit("Type"))
    return table(spark, sf_dir, "part").select("p_partkey", T.split_name(joined).alias("name"))


@query(_ENTRIES + ", e AS (SELECT *, CASE WHEN verdict = 'MATCH' THEN 'LOW' ELSE 'HIGH' END AS severity FROM entries) SELECT severity, count(*) AS n FROM e WHERE source <> 'system' AND created_at >= (SELECT max(ts) FROM events) - INTERVAL 168 HOUR GROUP BY severity")
def ledger_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the last 168 hours before the newest event by severity."""
    rows = entries(spark, sf_dir).withColumn("severity", F.when(F.col("verdict") == "MATCH", "LOW").otherwise("HIGH"))
    return ledger.severity_counts(rows, rows.agg(F.max("created_at")).first()[0])


@query(_REVIEWS + "SELECT task_id, opened_at + INTERVAL 24 HOUR AS due_at FROM reviews WHERE status = 'pending' AND opened_at <= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def review_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that were open for 24 hours when the newest event came, and when each was due."""
    acts = review_acts(spark, sf_dir)
    return ledger.overdue(acts, acts.agg(F.max("at")).first()[0], "task_id", "at", "n")


@query("SELECT json_extract_string(v, '$.severity') AS severity, count(*) AS n FROM (SELECT '{\"verdict\":\"EXCEPTION\",\"severity\":\"' || CASE event_id % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END || '\"}' AS v FROM events) GROUP BY ALL")
def json_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities read by path from verdicts held as JSON text."""
    severity = F.get(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH"))), (F.col("event_id") % 3).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.lit("EXCEPTION").alias("verdict"), severity.alias("severity"))).alias("v"))
    return rows.groupBy(F.get_json_object("v", "$.severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))
