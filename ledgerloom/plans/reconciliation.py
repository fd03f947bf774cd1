"""Queries over the pair view: verdicts, scores, calibration, routing, splits, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import amounts, dates, names
from ..operators import agreement, calibrate, contamination, resample, routing, score, split, verify, voting
from ..operators.taxonomy import weight_of
from ..sources.pairs import order_pairs
from . import views
from .registry import query, table
from .views import CAUGHT_SEVERITY_SQL, CAUGHT_SQL, CORRECT_SQL, PAIRS_SQL, SCORED, VERIFIED

PARSED = VERIFIED
HIT = "CAST(count(*) FILTER (WHERE {}) AS BIGINT)"


def hits(condition: str) -> str:
    return HIT.format(condition)


@query(VERIFIED + "SELECT task_id, kind, verdict, severity, resolution, reason FROM verified")
def recon_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.verified(spark, sf_dir).select("task_id", "kind", "verdict", "severity", "resolution", "reason")


@query(VERIFIED + "SELECT kind, severity, count(*) AS n FROM verified GROUP BY ALL")
def recon_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.verified(spark, sf_dir).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(PARSED + f"SELECT task_id, {views.corrupt_sql('l')} AS ledger_corrupt, {views.corrupt_sql('s')} AS statement_corrupt FROM parsed WHERE there")
def corrupt_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_pairs(spark, sf_dir).where("statement IS NOT NULL")
    return rows.select("task_id", verify.corrupt(F.col("ledger")).alias("ledger_corrupt"), verify.corrupt(F.col("statement")).alias("statement_corrupt"))


@query(PARSED + f"SELECT task_id, la AS ledger_amount, sa AS statement_amount, {views.SAME_AMOUNT_SQL} AS within FROM parsed WHERE there AND upper(l_ccy) = upper(s_ccy)")
def amount_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_pairs(spark, sf_dir).where("statement IS NOT NULL AND upper(ledger.ccy) = upper(statement.ccy)")
    la, sa = amounts.exact(F.col("ledger.amount")), amounts.exact(F.col("statement.amount"))
    return rows.select("task_id", la.alias("ledger_amount"), sa.alias("statement_amount"), amounts.within_tolerance(la, sa).alias("within"))


@query(PARSED + f"SELECT task_id, la AS ledger_amount, sa AS statement_amount, {views.FX_SQL} AS holds FROM parsed WHERE there AND upper(l_ccy) <> upper(s_ccy)")
def fx_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_pairs(spark, sf_dir).where("statement IS NOT NULL AND upper(ledger.ccy) <> upper(statement.ccy)")
    la, sa = amounts.exact(F.col("ledger.amount")), amounts.exact(F.col("statement.amount"))
    return rows.select("task_id", la.alias("ledger_amount"), sa.alias("statement_amount"), amounts.fx_holds(la, F.col("ledger.fx_rate"), sa, F.col("statement.fx_rate")).alias("holds"))


@query(PARSED + "SELECT task_id, isodow(ld) < 6 AND ld <= booked + INTERVAL 2 DAY AS ledger_due, isodow(sd) < 6 AND sd <= booked + INTERVAL 2 DAY AS statement_due, l_date = s_date AS same FROM parsed WHERE there")
def value_date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_pairs(spark, sf_dir).where("statement IS NOT NULL")
    ld, sd, booked = dates.value_date(F.col("ledger.value_date")), dates.value_date(F.col("statement.value_date")), F.col("ledger.booked_at")
    return rows.select("task_id", dates.due_in_time(ld, booked).alias("ledger_due"), dates.due_in_time(sd, booked).alias("statement_due"), (F.col("ledger.value_date") == F.col("statement.value_date")).alias("same"))


@query(PARSED + f"SELECT task_id, {views.near_sql('l_ben', 's_ben')} AS beneficiary_near, {views.near_sql('l_cp', 's_cp')} AS counterparty_near FROM parsed WHERE there")
def near_equal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_pairs(spark, sf_dir).where("statement IS NOT NULL")
    near = [names.near_equal(F.col(f"ledger.{f}"), F.col(f"statement.{f}")).alias(f"{f}_near") for f in ("beneficiary", "counterparty")]
    return rows.select("task_id", *near)


@query(f"WITH {PAIRS_SQL} SELECT task_id, trim(l_ref) AS ref FROM pairs WHERE there AND trim(l_ref) = trim(s_ref)")
def duplicate_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_pairs(spark, sf_dir).where(names.trimmed(F.col("ledger.ref")) == names.trimmed(F.col("statement.ref")))
    return rows.select("task_id", names.trimmed(F.col("ledger.ref")).alias("ref"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no line item belongs to."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(lines, "o_orderkey", "left_anti")


@query(
    "SELECT o_orderkey, round(o_totalprice, 2) AS ordered, round(sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))), 2)::DOUBLE AS booked FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
    " GROUP BY o_orderkey, o_totalprice HAVING abs(CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) - sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))))"
    " > 0.005 * greatest(CAST(round(o_totalprice, 2) AS DECIMAL(18,2)), sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))))"
)
def order_amount_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose price and lines differ by more than the tolerance; lines are summed before the join."""
    money = lambda c: F.round(c, 2).cast("decimal(18,2)")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money(F.col("l_extendedprice"))).cast("decimal(18,2)").alias("b"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", money(F.col("o_totalprice")).alias("a")).join(lines, "o_orderkey")
    return rows.where(~amounts.within_tolerance(F.col("a"), F.col("b"))).select("o_orderkey", F.col("a").cast("double").alias("ordered"), F.col("b").cast("double").alias("booked"))


@query(
    SCORED + f"SELECT count(*) AS n, {hits('p_verdict IS NULL')} AS parse_failures,"
    " round(avg(CASE WHEN coalesce(p_verdict, 'MATCH') = verdict THEN 1.0::DOUBLE ELSE 0 END), 4) AS verdict_accuracy,"
    f" round(avg(CASE WHEN {CORRECT_SQL} THEN 1.0::DOUBLE ELSE 0 END), 4) AS accuracy,"
    f" round({hits(f'ex AND NOT heavy AND {CORRECT_SQL}')}::DOUBLE / {hits('ex')}, 4) AS type_accuracy_light_only,"
    f" round({hits(f'ex AND {CORRECT_SQL}')}::DOUBLE / {hits('ex')}, 4) AS type_accuracy,"
    f" round(sum(CASE WHEN ex AND {CAUGHT_SEVERITY_SQL} THEN weight::DOUBLE ELSE 0 END) / sum(CASE WHEN ex THEN weight::DOUBLE ELSE 0 END), 4) AS weighted_recall,"
    f" {hits(chr(39).join(['p_verdict = ', 'ESCALATE', '']))} AS escalations,"
    f" round({hits(chr(39).join(['ex AND p_verdict = ', 'ESCALATE', '']))}::DOUBLE / {hits(chr(39).join(['p_verdict = ', 'ESCALATE', '']))}, 4) AS escalation_precision FROM scored"
)
def score_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.scorecard(views.predicted(spark, sf_dir))


@query(SCORED + f"SELECT severity, count(*) AS n, {hits(CAUGHT_SEVERITY_SQL)} AS caught, round({hits(CAUGHT_SEVERITY_SQL)}::DOUBLE / count(*), 4) AS recall FROM scored WHERE ex GROUP BY severity")
def score_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.recall_by_severity(views.predicted(spark, sf_dir))


@query(
    SCORED + f"SELECT kind AS exception_type, count(*) AS n, {hits(CAUGHT_SQL)} AS caught,"
    f" round(sum(CASE WHEN {CAUGHT_SQL} THEN weight::DOUBLE ELSE 0 END) / sum(weight::DOUBLE), 4) AS recall FROM scored WHERE ex GROUP BY ROLLUP (kind)"
)
def severity_weighted_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.weighted_recall(views.predicted(spark, sf_dir))


@query(SCORED + "SELECT kind AS exception_type, count(*) AS n, round(count(*) FILTER (WHERE p_type = kind)::DOUBLE / count(*), 4) AS exact_recall FROM scored WHERE ex GROUP BY kind")
def type_exact_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.exact_recall(views.predicted(spark, sf_dir))


@query(
    SCORED + "SELECT CASE WHEN weight >= 0.9 THEN 'HIGH' WHEN weight >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS band, count(*) AS n,"
    f" round({hits(CAUGHT_SQL)}::DOUBLE / count(*), 4) AS recall FROM scored WHERE ex GROUP BY band"
)
def severity_band_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.band_recall(views.predicted(spark, sf_dir))


@query(
    SCORED + ", f AS (SELECT *, p_verdict IS NULL OR p_verdict <> 'MATCH' AS flag FROM scored), s AS (SELECT count(*) FILTER (WHERE ex AND flag) AS tp, count(*) FILTER (WHERE NOT ex AND flag) AS fp,"
    " count(*) FILTER (WHERE ex AND NOT flag) AS fn FROM f) SELECT tp, fp, fn, round(tp::DOUBLE / (tp + fp), 4) AS precision, round(tp::DOUBLE / (tp + fn), 4) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 4) AS f1 FROM s"
)
def flag_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.flag_scores(views.predicted(spark, sf_dir))


_LABELS = ", ".join(f"('{x}')" for x in score.LABELS)


@query(
    SCORED + f", labels(l) AS (VALUES {_LABELS}) SELECT e.l AS expected, p.l AS predicted, count(s.k) AS n FROM labels e CROSS JOIN labels p"
    " LEFT JOIN scored s ON s.kind = e.l AND coalesce(s.p_type, s.p_verdict, 'PARSE_FAIL') = p.l GROUP BY ALL"
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.confusion(views.predicted(spark, sf_dir))


@query(
    SCORED + ", c AS (SELECT kind AS expected, coalesce(p_type, p_verdict, 'PARSE_FAIL') AS predicted, count(*) AS n FROM scored GROUP BY ALL)"
    " SELECT expected, predicted, n, CAST(row_number() OVER (PARTITION BY expected ORDER BY n DESC, predicted) AS INTEGER) AS rank FROM c WHERE expected <> predicted QUALIFY rank <= 3"
)
def confusion_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.top_confusions(views.predicted(spark, sf_dir))


@query(SCORED + f"SELECT count(*) AS n, round({hits(CORRECT_SQL)}::DOUBLE / count(*), 4) AS accuracy, round({hits('p_verdict IS NOT NULL')}::DOUBLE / count(*), 4) AS parse_rate FROM scored")
def accuracy_parse_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.accuracy(views.predicted(spark, sf_dir))


@query(
    SCORED + f", s AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_verdict IS NULL OR p_verdict = 'ESCALATE') AS escalations, count(*) FILTER (WHERE ex AND heavy AND NOT {CAUGHT_SQL}) AS missed_high FROM scored)"
    " SELECT n, escalations, missed_high, escalations + 5.0::DOUBLE * missed_high AS total_cost, round((escalations + 5.0::DOUBLE * missed_high) / n, 4) AS normalized_cost FROM s"
)
def severity_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.cost(views.predicted(spark, sf_dir))


_BINNED = SCORED + f", b AS (SELECT greatest(0, least(9, CAST(floor(confidence * 10) AS INTEGER))) AS bin, confidence, CASE WHEN {CORRECT_SQL} THEN 1.0::DOUBLE ELSE 0 END AS ok FROM scored WHERE p_verdict IS NOT NULL) "


@query(_BINNED + "SELECT CAST(bin AS INTEGER) AS bin, round(bin / 10, 3) AS conf_min, round((bin + 1) / 10, 3) AS conf_max, round(avg(confidence), 4) AS conf_mean, round(avg(ok), 4) AS accuracy, count(*) AS n FROM b GROUP BY bin")
def ece_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.ece_curve(views.predicted(spark, sf_dir))


@query(_BINNED + ", g AS (SELECT count(*) AS n, avg(confidence) AS c, avg(ok) AS a FROM b GROUP BY bin) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(a - c)) / sum(n), 4) AS ece FROM g")
def ece_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.ece(views.predicted(spark, sf_dir))


_SWEEP = SCORED + (
    ", taus AS (SELECT round(i / 20, 3) AS tau FROM range(21) r(i)), w AS (SELECT tau, count(*) FILTER (WHERE p_verdict IS NULL OR p_verdict = 'ESCALATE' OR confidence < tau) AS escalations,"
    " count(*) FILTER (WHERE ex AND heavy AND (p_verdict IS NULL OR (confidence >= tau AND p_verdict = 'MATCH'))) AS missed_high FROM scored, taus GROUP BY tau),"
    " sweep AS (SELECT tau, escalations, missed_high, escalations + 5.0::DOUBLE * missed_high AS total_cost FROM w) "
)


@query(_SWEEP + "SELECT * FROM sweep")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.threshold_sweep(views.predicted(spark, sf_dir))


@query(_SWEEP + "SELECT * FROM sweep ORDER BY total_cost, tau LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.best_threshold(views.predicted(spark, sf_dir))


_ROUTE = "CASE WHEN p_verdict = 'ESCALATE' OR p_severity = 'HIGH' OR confidence < 0.6 THEN 'ESCALATE' WHEN p_verdict = 'EXCEPTION' THEN 'EXCEPTION' ELSE 'VERDICT' END"
_WHY = "CASE WHEN p_verdict = 'ESCALATE' THEN 'model escalated' WHEN p_severity = 'HIGH' THEN 'severity HIGH' WHEN confidence < 0.6 THEN 'low confidence' ELSE '' END"


@query(SCORED + f"SELECT task_id, {_ROUTE} AS route, {_WHY} AS why FROM scored WHERE p_verdict IS NOT NULL")
def route_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.predicted(spark, sf_dir).where("p_verdict IS NOT NULL")
    to = (F.col("p_verdict"), F.col("p_severity"), F.col("confidence"))
    return rows.select("task_id", routing.route(*to).alias("route"), routing.route_reason(*to).alias("why"))


@query(
    SCORED + "SELECT task_id, CASE WHEN p_verdict IS NOT NULL AND confidence < 0.5 THEN 'ESCALATE' ELSE p_verdict END AS p_verdict, CASE WHEN p_verdict IS NOT NULL AND confidence < 0.5 THEN NULL ELSE p_type END AS p_type,"
    " CASE WHEN p_verdict IS NOT NULL AND confidence < 0.5 THEN 'MEDIUM' ELSE p_severity END AS p_severity FROM scored"
)
def override_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.override(views.predicted(spark, sf_dir), 0.5).select("task_id", "p_verdict", "p_type", "p_severity")


@query(
    SCORED + ", d AS (SELECT *, CASE k % 4 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'CHANGE' ELSE 'HOLD' END AS decision FROM scored WHERE p_verdict IS NOT NULL)"
    " SELECT task_id, decision, CASE decision WHEN 'CHANGE' THEN verdict WHEN 'REJECT' THEN 'MATCH' ELSE p_verdict END AS verdict,"
    " CASE decision WHEN 'CHANGE' THEN CASE WHEN ex THEN kind END WHEN 'REJECT' THEN NULL ELSE p_type END AS type,"
    " CASE decision WHEN 'CHANGE' THEN resolution WHEN 'REJECT' THEN 'reject' ELSE 'flag-review' END AS resolution FROM d"
)
def review_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.predicted(spark, sf_dir).where("p_verdict IS NOT NULL")
    decision = F.element_at(F.array(*map(F.lit, ("APPROVE", "REJECT", "CHANGE", "HOLD"))), (F.col("k") % 4 + 1).cast("int"))
    made = lambda v, t, r: F.struct(v.alias("verdict"), t.alias("type"), r.alias("resolution"))
    provisional = made(F.col("p_verdict"), F.col("p_type"), F.lit("flag-review"))
    final = made(F.col("verdict"), F.when(F.col("kind") != "MATCH", F.col("kind")), F.col("resolution"))
    return rows.select("task_id", decision.alias("decision"), routing.fold_review(decision, provisional, final).alias("v")).select("task_id", "decision", "v.*")


_SAMPLES = (7919, 104729, 1299709, 15485863, 32452843)
_SAMPLED = f"WITH {views.VERIFIED_SQL}, " + ", ".join(views.predicted_sql(f, f"s{i}") for i, f in enumerate(_SAMPLES))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five predictions of each pair: k, i, told ('VERDICT' or 'VERDICT:TYPE', null where none); pairs are verified once."""
    numbered = F.posexplode(F.array(*map(F.lit, _SAMPLES))).alias("i", "factor")
    rows = views.with_predictions(views.verified(spark, sf_dir).select("k", "kind", numbered), F.col("factor"))
    return rows.select("k", "i", F.when(F.col("p_verdict").isNotNull(), F.concat_ws(":", "p_verdict", "p_type")).alias("told"))


@query(
    _SAMPLED + ", all5 AS (" + " UNION ALL ".join(f"SELECT k, {i} AS i, concat_ws(':', p_verdict, p_type) AS told FROM s{i} WHERE p_verdict IS NOT NULL" for i in range(5)) + "),"
    " c AS (SELECT k, told, count(*) AS votes, min(i) AS first, min(i) FILTER (WHERE i > 0) AS later FROM all5 GROUP BY k, told),"
    " m AS (SELECT *, sum(votes) OVER (PARTITION BY k) AS valid, max(votes) OVER (PARTITION BY k) AS most FROM c)"
    " SELECT k, told AS winner, votes, CAST(valid AS BIGINT) AS valid, round(votes::DOUBLE / valid, 4) AS confidence FROM m WHERE votes = most"
    " QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN most = 1 THEN first ELSE coalesce(later, first) END, told) = 1"
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.majority(samples(spark, sf_dir), "k", "i", "told")


_SPLIT = SCORED + (
    ", st AS (SELECT *, least(9, CAST(floor(difficulty * 10) AS INTEGER)) AS decile FROM scored), r AS (SELECT task_id, decile, kind, count(*) OVER w AS n, row_number() OVER (PARTITION BY decile, kind ORDER BY md5('7:' || task_id), task_id) AS nth FROM st WINDOW w AS (PARTITION BY decile, kind)),"
    " split AS (SELECT task_id, CAST(decile AS INTEGER) AS decile, kind, CASE WHEN nth <= CASE WHEN n >= 2 THEN greatest(1, least(n - 1, round_even(n * 0.8, 0))) ELSE round_even(n * 0.8, 0) END THEN 'train' ELSE 'val' END AS split FROM r) "
)


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.predicted(spark, sf_dir).select("task_id", split.decile(F.col("difficulty")).alias("decile"), "kind")
    return split.stratified(rows, ["decile", "kind"], "task_id")


@query(_SPLIT + "SELECT * FROM split")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(spark, sf_dir)


@query(_SPLIT + "SELECT decile, kind, count(*) AS n, count(*) FILTER (WHERE split = 'train') AS n_train FROM split GROUP BY decile, kind")
def split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.balance(split_rows(spark, sf_dir), ["decile", "kind"])


@query(
    VERIFIED + "SELECT task_id, '{\"confidence\":1.0,\"exception_type\":' || CASE WHEN kind = 'MATCH' THEN 'null' ELSE '\"' || kind || '\"' END || ',\"reason\":\"' || reason || '\",\"resolution\":\"' || resolution || '\",\"severity\":\"' || severity || '\",\"verdict\":\"' || verdict || '\"}' AS target FROM verified"
)
def verdict_json_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.verified(spark, sf_dir)
    kind = F.when(F.col("kind") != "MATCH", F.col("kind"))
    return rows.select("task_id", split.verdict_json(F.col("verdict"), kind, F.col("severity"), F.col("resolution"), F.col("reason")).alias("target"))


def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What resampled metrics need of each pair: kind, its weight, and caught and right by two predictors."""
    base = views.verified(spark, sf_dir).select("k", "kind", F.posexplode(F.array(F.lit(7919), F.lit(104729))).alias("i", "factor"))
    rows = views.with_predictions(base, F.col("factor")).select("k", "kind", "i", score.caught_by_weight().cast("int").alias("caught"), score.correct().cast("int").alias("right"))
    of = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    # both predictions of a pair lie beside each other in one partition; the exchange is on the pair's key
    both = rows.groupBy("k", "kind").agg(of(0, "caught").alias("caught"), of(0, "right").alias("right_a"), of(1, "caught").alias("caught_b"), of(1, "right").alias("right_b"))
    return both.select("kind", weight_of(F.col("kind")).alias("weight"), "caught", "right_a", "caught_b", "right_b")


FOLDED = ["kind", "weight", "caught", "right_a", "caught_b", "right_b"]


def _recall(caught: str) -> Column:
    return F.sum(F.when(F.col("kind") != "MATCH", F.col("weight") * F.col(caught) * F.col("w"))) / F.sum(F.when(F.col("kind") != "MATCH", F.col("weight") * F.col("w")))


def _accuracy(right: str) -> Column:
    return F.sum(F.col(right) * F.col("w")).cast("double") / F.sum("w")


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the weighted recall from 10,000 replicates of as many draws as there are pairs."""
    drawn = resample.draws(outcome_rows(spark, sf_dir), FOLDED)
    return resample.interval(drawn.groupBy("replicate").agg(_recall("caught").alias("value")))


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two predictors in accuracy and in weighted recall on the same replicates."""
    drawn = resample.draws(outcome_rows(spark, sf_dir), FOLDED)
    made = drawn.groupBy("replicate").agg(*[m(c).alias(c) for m, c in ((_accuracy, "right_a"), (_accuracy, "right_b"), (_recall, "caught"), (_recall, "caught_b"))])
    both = F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(a).alias("a"), F.col(b).alias("b")) for n, a, b in (("accuracy", "right_a", "right_b"), ("weighted_recall", "caught", "caught_b"))]))
    return resample.paired(made.select(both), by=("metric",))


@query()
def interval_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, weighted recall, recall by band and exact recall by type of two predictors, each with its interval."""
    rows = outcome_rows(spark, sf_dir)
    runs = F.inline(F.array(*[F.struct(F.lit(n).alias("run"), F.col(c).alias("_caught"), F.col(r).alias("right")) for n, c, r in (("a", "caught", "right_a"), ("b", "caught_b", "right_b"))]))
    return resample.study(rows.select("kind", "weight", runs).withColumnRenamed("_caught", "caught"))


_POINTS = f"WITH {views.VERIFIED_SQL}, {views.predicted_sql(7919, 'sa_')}, " + (
    f"o AS (SELECT CASE WHEN {CORRECT_SQL} THEN 1.0::DOUBLE ELSE 0 END AS ok FROM sa_), p AS (SELECT count(*) AS n, avg(ok) AS p FROM o) "
)


@query(_POINTS + "SELECT n, round(p, 4) AS point, 0.0::DOUBLE AS shift, 1.0::DOUBLE AS width_ratio FROM p")
def bootstrap_normal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accuracy's bootstrap held against the normal approximation.

    ``shift`` is the distance of the replicates' mean from the metric and ``width_ratio`` the interval's width by
    that of p +- 1.96 * sqrt(p * (1 - p) / n), in tenths: 0 and 1 if replicates draw n of n.
    """
    rows = outcome_rows(spark, sf_dir)
    point = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("right_a").alias("p"))
    values = resample.draws(rows, FOLDED).groupBy("replicate").agg(_accuracy("right_a").alias("value"))
    ranked = values.select("value", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("value")) - 1).alias("at"), F.count(F.lit(1)).over(W.partitionBy(F.lit(0))).alias("m"))
    pick = lambda p: resample.at_rank(F.col("value"), F.col("at"), F.col("m"), p)
    spans = ranked.agg(F.avg("value").alias("mean"), (pick(0.975) - pick(0.025)).alias("width"))
    due = 2 * 1.959964 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return spans.crossJoin(point).select("n", F.round("p", 4).alias("point"), F.abs(F.round(F.col("mean") - F.col("p"), 2)).alias("shift"), F.round(F.col("width") / due, 1).alias("width_ratio"))


_QUOTED = lambda c: f"'\"' || {c} || '\"'"
_LEDGER_JSON = "".join(
    f" || ',\"ledger.{f}\":' || {v}" for f, v in (("beneficiary", _QUOTED("l_ben")), ("booked_at", _QUOTED("l_booked")), ("ccy", _QUOTED("l_ccy")), ("counterparty", _QUOTED("l_cp")), ("fx_rate", "'null'"), ("message_type", "'\"MT103\"'"), ("ref", _QUOTED("l_ref")), ("value_date", _QUOTED("l_date")))
)
_STATEMENT_JSON = "".join(
    f" || ',\"statement.{f}\":' || {v}" for f, v in (("amount", _QUOTED("s_amount")), ("beneficiary", _QUOTED("s_ben")), ("booked_at", None), ("ccy", _QUOTED("s_ccy")), ("counterparty", _QUOTED("s_cp")), ("fx_rate", "CASE WHEN s_fx IS NULL THEN 'null' ELSE '0.92' END"), ("message_type", "'\"camt.054\"'"), ("ref", _QUOTED("s_ref")), ("value_date", _QUOTED("s_date"))) if v
)
_SIG = f"WITH {PAIRS_SQL}, sg AS (SELECT k, task_id, l_cp, sha256('{{\"ledger.amount\":' || {_QUOTED('l_amount')}{_LEDGER_JSON} || CASE WHEN there THEN ''{_STATEMENT_JSON} ELSE '' END || '}}') AS sig FROM pairs) "


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_pairs(spark, sf_dir).select("k", "task_id", contamination.pair_signature().alias("sig"))


@query(_SIG + "SELECT task_id, sig FROM sg")
def pair_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed(spark, sf_dir).select("task_id", "sig")


@query(_SIG + ", h AS (SELECT s.sig, s.sig IN (SELECT sig FROM sg WHERE k % 5 <> 0 OR k % 3 = 0) AS hit FROM sg s WHERE k % 5 = 0) SELECT count(*) AS n, count(*) FILTER (WHERE hit) AS matches, round(count(*) FILTER (WHERE hit)::DOUBLE / count(*), 4) AS overlap, count(*) FILTER (WHERE hit) > 0 AS fired FROM h")
def leak_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth pair is held out, and each third of these leaks into training."""
    rows = signed(spark, sf_dir)
    return contamination.leak_probe(rows.where("k % 5 <> 0 OR k % 3 = 0"), rows.where("k % 5 = 0"))


_ROC = _SIG + (
    ", g AS (SELECT unnest([0.05, 0.1, 0.2, 0.5])::DOUBLE AS fraction), train AS (SELECT * FROM sg WHERE k % 2 = 0),"
    " src AS (SELECT fraction, sig, row_number() OVER (PARTITION BY fraction ORDER BY md5('11:source:' || fraction || ':' || task_id), task_id) AS nth FROM train, g),"
    " pl AS (SELECT fraction, sig, row_number() OVER (PARTITION BY fraction ORDER BY md5('11:place:' || fraction || ':' || task_id), task_id) AS nth, count(*) OVER (PARTITION BY fraction) AS n FROM sg, g WHERE k % 2 = 1),"
    " seen AS (SELECT pl.fraction, nth_k >= pl.nth AS leaked, CASE WHEN nth_k >= pl.nth THEN src.sig ELSE pl.sig END AS sig FROM (SELECT *, greatest(1, round_even(n * fraction, 0)) AS nth_k FROM pl) pl"
    " JOIN src ON src.fraction = pl.fraction AND src.nth = (pl.nth - 1) % (SELECT count(*) FROM train) + 1),"
    " hit AS (SELECT fraction, leaked, sig IN (SELECT sig FROM train) AS hit FROM seen),"
    " roc AS (SELECT fraction, count(*) FILTER (WHERE leaked) AS n_leaked, count(*) FILTER (WHERE NOT leaked) AS n_clean, round(count(*) FILTER (WHERE leaked AND hit)::DOUBLE / count(*) FILTER (WHERE leaked), 4) AS fire_on_leaked,"
    " round(count(*) FILTER (WHERE NOT leaked AND hit)::DOUBLE / count(*) FILTER (WHERE NOT leaked), 4) AS false_fire_on_clean FROM hit GROUP BY fraction) "
)


@query(_ROC + "SELECT * FROM roc")
def leak_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training pairs spliced into every second pair in four shares, and what the monitor then says of each row."""
    rows = signed(spark, sf_dir)
    return contamination.leak_roc(rows.where("k % 2 = 0"), rows.where("k % 2 = 1"), "task_id")


@query(_ROC + "SELECT min(fire_on_leaked) AS fire_on_leaked_min, max(false_fire_on_clean) AS false_fire_on_clean_max FROM roc")
def leak_roc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.roc_summary(leak_roc(spark, sf_dir))


def nearest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_pairs(spark, sf_dir)
    return contamination.near_duplicate_audit(rows.where("k % 100 <> 0"), rows.where("k % 100 = 0"), "task_id", contamination.pair_payload())


@query()
def near_dup_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every pair whose key is divisible by 100 the most similar of all other pairs."""
    return nearest_pairs(spark, sf_dir)


@query()
def near_dup_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of these pairs, how many have a nearest neighbour of which similarity."""
    return contamination.similarity_histogram(nearest_pairs(spark, sf_dir))


@query(
    "SELECT count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END), 4) AS agreement, round((avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END) - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic))))"
    " / (1 - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))), 4) AS kappa FROM labels"
)
def labels_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT quality || '->' || toxic AS change, count(*) AS n FROM labels WHERE quality <> toxic GROUP BY ALL")
def judge_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.confusions(table(spark, sf_dir, "labels"), "quality", "toxic")


@query()
def generated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many synthetic pairs as there are orders, with the type drawn and the type found."""
    from ..operators.generator import judged

    n = table(spark, sf_dir, "orders").count()
    return judged(spark, n).select("task_id", "difficulty", "drawn", "kind")


_SHARED = " UNION ALL ".join(f"SELECT '{c}' AS column, CAST(count(*) AS BIGINT) AS shared FROM (SELECT {c} FROM both_sides GROUP BY {c} HAVING count(DISTINCT split) > 1)" for c in ("task_id", "sig", "counterparty"))


@query(_SPLIT + _SIG.replace("WITH " + PAIRS_SQL, "", 1).rstrip() + f", both_sides AS (SELECT task_id, sig, l_cp AS counterparty, split FROM split JOIN sg USING (task_id)) {_SHARED}")
def split_leak_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ids, signatures and counterparties stand on both sides of the split; the first two must be none."""
    marked = order_pairs(spark, sf_dir).select("task_id", contamination.pair_signature().alias("sig"), F.col("ledger.counterparty").alias("counterparty"))
    return split.leaks(split_rows(spark, sf_dir).join(marked, "task_id"), ["task_id", "sig", "counterparty"])
