import pytest

from ledgerloom.operators import agreement, calibrate, drift, routing, score, voting
from pyspark.sql import functions as F


def scored(spark, rows):
    return spark.createDataFrame(rows, "kind string, p_verdict string, p_type string, confidence double")


def test_accuracy_counts_verdict_and_type(spark):
    rows = scored(spark, [("AMOUNT_MISMATCH", "EXCEPTION", "AMOUNT_MISMATCH", 0.9), ("DUPLICATE", "EXCEPTION", "PARTIAL_MATCH", 0.9), ("MATCH", "MATCH", None, 0.9)])
    assert score.accuracy(rows).first()["accuracy"] == pytest.approx(2 / 3, abs=1e-4)


def test_weighted_recall_is_lenient_on_heavy_types(spark):
    rows = scored(spark, [("AMOUNT_MISMATCH", "ESCALATE", None, 1.0), ("BENEFICIARY_MISMATCH", "EXCEPTION", "DUPLICATE", 1.0), ("DUPLICATE", "EXCEPTION", "DUPLICATE", 1.0), ("FX_CONVERSION_ERROR", "MATCH", None, 1.0)])
    total = score.weighted_recall(rows).where("exception_type IS NULL").first()
    assert total["recall"] == pytest.approx((1.0 + 0.9 + 0.2) / 3.1, abs=1e-4)


def test_null_prediction_means_what_each_score_says(spark):
    rows = scored(spark, [("AMOUNT_MISMATCH", None, None, None)])
    assert score.flag_scores(rows).first()["recall"] == 1.0
    assert score.cost(rows).first()["total_cost"] == 6.0
    assert score.accuracy(rows).first()["parse_rate"] == 0.0
    cells = {(r["expected"], r["predicted"]): r["n"] for r in score.confusion(rows).collect()}
    assert cells["AMOUNT_MISMATCH", "PARSE_FAIL"] == 1 and sum(cells.values()) == 1 and len(cells) == 144


def test_flag_scores(spark):
    rows = scored(spark, [("DUPLICATE", "EXCEPTION", "DUPLICATE", 1.0), ("MATCH", "EXCEPTION", "DUPLICATE", 1.0), ("DUPLICATE", "MATCH", None, 1.0)])
    r = score.flag_scores(rows).first()
    assert (r["tp"], r["fp"], r["fn"], r["f1"]) == (1, 1, 1, 0.5)


def test_calibration(spark):
    sure_and_wrong = scored(spark, [("MATCH", "EXCEPTION", "DUPLICATE", 0.9)] * 4)
    assert calibrate.ece(sure_and_wrong).first()["ece"] == 0.9
    assert calibrate.ece(scored(spark, [("MATCH", "MATCH", None, 1.0)] * 3)).first()["ece"] == 0.0


def test_threshold_catches_an_overconfident_miss(spark):
    rows = scored(spark, [("AMOUNT_MISMATCH", "MATCH", None, 0.3), ("MATCH", "MATCH", None, 0.9)])
    best = calibrate.best_threshold(rows).first()
    assert (best["tau"], best["total_cost"]) == (0.35, 1.0)


def test_kappa_edges(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert agreement.kappa(empty, "a", "b").first()["kappa"] == 0.0
    assert agreement.kappa(spark.createDataFrame([("x", "x")] * 3, "a string, b string"), "a", "b").first()["kappa"] == 1.0
    mixed = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y")], "a string, b string")
    assert agreement.kappa(mixed, "a", "b").first()["kappa"] == 0.5


def test_drift_edges(spark):
    counts = lambda d: spark.createDataFrame(list(d.items()), "k string, n long")
    same = drift.drift(counts({"a": 5, "b": 5}), counts({"a": 1, "b": 1}), "k").first()
    assert same["psi"] == 0.0 and not same["fired"]
    assert drift.drift(counts({"a": 9, "b": 1}), counts({"a": 1, "b": 9}), "k").first()["fired"]
    lost = drift.drift(counts({}), counts({"a": 1}), "k").first()
    assert lost["psi"] == float("inf") and not lost["fired"]


def test_vote_ties(spark):
    rows = [("t", i, v) for i, v in enumerate("ABBA")] + [("u", 0, "A"), ("u", 1, "B"), ("v", 0, None), ("v", 1, "C"), ("v", 2, "C")]
    got = {r["k"]: (r["winner"], r["valid"]) for r in voting.majority(spark.createDataFrame(rows, "k string, i int, v string"), "k", "i", "v").collect()}
    assert got == {"t": ("B", 4), "u": ("A", 2), "v": ("C", 2)}


def test_normal_form(spark):
    rows = spark.createDataFrame(
        [("EXCEPTION", "DUPLICATE", "ODD", 3.0, "nope"), ("EXCEPTION", None, None, 0.5, None), ("SURE", None, None, 0.5, None), ("MATCH", "DUPLICATE", None, None, "reject")],
        "v string, t string, s string, c double, r string",
    )
    made = rows.select(routing.normalise(*(F.col(c) for c in "vtscr"), F.lit(None).cast("string")).alias("n")).collect()
    assert made[0]["n"]["severity"] == "LOW" and made[0]["n"]["confidence"] == 1.0 and made[0]["n"]["resolution"] == "flag-review"
    assert made[1]["n"] is None and made[2]["n"] is None
    assert made[3]["n"]["exception_type"] is None and made[3]["n"]["confidence"] == 0.0


def test_a_pair_is_judged_once_whatever_reads_it(spark, sf_dir):
    """The decision list is a great expression: a plan that repeats it at every use is slow to compile and to run."""
    from ledgerloom.plans import reconciliation

    for query in (reconciliation.confusion_matrix, reconciliation.ece_curve, reconciliation.majority_vote, reconciliation.severity_cost):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("THEN MISSING_MESSAGE") <= 2, query.__name__
