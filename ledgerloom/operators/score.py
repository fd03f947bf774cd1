"""Scores of predictions against verified pairs.

Rows hold kind ('MATCH' or the true type), p_verdict, p_type and confidence; p_verdict is null where
the prediction did not parse.  What a null means differs by score and is said at each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .taxonomy import HEAVY, TYPES, severity_of, weight_of

PARSE_FAIL = "PARSE_FAIL"
LABELS = (*TYPES, "MATCH", "ESCALATE", PARSE_FAIL)
ROUND = 4


def n_of(condition: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("bigint")), F.lit(0).cast("bigint"))


def share(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, part / whole).otherwise(0.0), ROUND)



def is_exception() -> Column:
    return F.col("kind") != "MATCH"


def correct() -> Column:
    """Verdict and, for exceptions, type are right; null is wrong."""
    right = F.when(is_exception(), (F.col("p_verdict") == "EXCEPTION") & F.col("p_type").eqNullSafe(F.col("kind"))).otherwise(F.col("p_verdict") == "MATCH")
    return F.coalesce(right, F.lit(False))


def caught_by_weight() -> Column:
    """Heavy types need any flag, the others their very type; null is a miss."""
    heavy = weight_of(F.col("kind")) >= HEAVY
    hit = F.when(heavy, F.col("p_verdict") != "MATCH").otherwise(F.col("p_type") == F.col("kind"))
    return F.coalesce(is_exception() & F.col("p_verdict").isNotNull() & hit, F.lit(False))


def caught_by_severity() -> Column:
    """HIGH records need any flag, the others their very type; null counts as MATCH."""
    flagged = F.coalesce(F.col("p_verdict"), F.lit("MATCH")) != "MATCH"
    hit = F.when(severity_of(F.col("kind")) == "HIGH", flagged).otherwise(F.col("p_type") == F.col("kind"))
    return F.coalesce(is_exception() & hit, F.lit(False))


def flagged() -> Column:
    """Null is a flag."""
    return F.col("p_verdict").isNull() | (F.col("p_verdict") != "MATCH")


def predicted_label() -> Column:
    known = F.coalesce("p_type", "p_verdict")
    return F.when(known.isin(*LABELS), known).otherwise(PARSE_FAIL)


def scorecard(rows: DataFrame) -> DataFrame:
    """One row; accuracy by verdict alone and by verdict and type, and both readings of escalation precision."""
    weight = F.when(is_exception(), weight_of(F.col("kind"))).otherwise(0.0)
    escalated = F.coalesce(F.col("p_verdict") == "ESCALATE", F.lit(False))
    verdict_right = F.coalesce(F.col("p_verdict"), F.lit("MATCH")) == F.when(is_exception(), "EXCEPTION").otherwise("MATCH")
    exceptions, n = n_of(is_exception()), F.count(F.lit(1))
    low = is_exception() & (weight_of(F.col("kind")) < HEAVY)
    return rows.agg(
        n.alias("n"),
        n_of(F.col("p_verdict").isNull()).alias("parse_failures"),
        share(n_of(verdict_right), n).alias("verdict_accuracy"),
        share(n_of(correct()), n).alias("accuracy"),
        share(n_of(low & correct()), exceptions).alias("type_accuracy_light_only"),
        share(n_of(is_exception() & correct()), exceptions).alias("type_accuracy"),
        F.round(F.sum(weight * caught_by_severity().cast("double")) / F.sum(weight), ROUND).alias("weighted_recall"),
        n_of(escalated).alias("escalations"),
        share(n_of(escalated & is_exception()), n_of(escalated)).alias("escalation_precision"),
    )


def recall_by_severity(rows: DataFrame) -> DataFrame:
    grouped = rows.where(is_exception()).groupBy(severity_of(F.col("kind")).alias("severity"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), n_of(caught_by_severity()).alias("caught"), share(n_of(caught_by_severity()), F.count(F.lit(1))).alias("recall"))


def weighted_recall(rows: DataFrame) -> DataFrame:
    """Each type and, with type null, all of them: one pass with grouping sets."""
    weight, caught = weight_of(F.col("kind")), caught_by_weight()
    marked = rows.where(is_exception()).select("kind", weight.alias("weight"), caught.alias("caught"))
    return marked.rollup(F.col("kind").alias("exception_type")).agg(
        F.count(F.lit(1)).alias("n"),
        n_of(F.col("caught")).alias("caught"),
        F.round(F.sum(F.col("weight") * F.col("caught").cast("double")) / F.sum("weight"), ROUND).alias("recall"),
    )


def exact_recall(rows: DataFrame) -> DataFrame:
    """Recall by type when only the very type counts."""
    hit = F.coalesce(F.col("p_type") == F.col("kind"), F.lit(False))
    return rows.where(is_exception()).groupBy(F.col("kind").alias("exception_type")).agg(F.count(F.lit(1)).alias("n"), share(n_of(hit), F.count(F.lit(1))).alias("exact_recall"))


def band_recall(rows: DataFrame) -> DataFrame:
    """Recall in the bands of weight: heavy, middle (0.5 and more), light."""
    weight = weight_of(F.col("kind"))
    band = F.when(weight >= HEAVY, "HIGH").when(weight >= 0.5, "MEDIUM").otherwise("LOW")
    return rows.where(is_exception()).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), share(n_of(caught_by_weight()), F.count(F.lit(1))).alias("recall"))


def flag_scores(rows: DataFrame) -> DataFrame:
    tp, fn, fp = n_of(is_exception() & flagged()), n_of(is_exception() & ~flagged()), n_of(~is_exception() & flagged())
    sums = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return sums.select("tp", "fp", "fn", *[F.round(F.coalesce(x, F.lit(0.0)), ROUND).alias(a) for x, a in ((p, "precision"), (r, "recall"), (f1, "f1"))])


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of every pair of the fixed labels, zeros too."""
    labels = rows.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    cells = labels.withColumnRenamed("label", "expected").crossJoin(labels.withColumnRenamed("label", "predicted"))
    seen = rows.groupBy(F.col("kind").alias("expected"), predicted_label().alias("predicted")).agg(F.count(F.lit(1)).alias("seen"))
    return cells.join(F.broadcast(seen), ["expected", "predicted"], "left").select("expected", "predicted", F.coalesce("seen", F.lit(0).cast("bigint")).alias("n"))


def top_confusions(rows: DataFrame, k: int = 3) -> DataFrame:
    wrong = rows.groupBy(F.col("kind").alias("expected"), predicted_label().alias("predicted")).agg(F.count(F.lit(1)).alias("n")).where("expected <> predicted")
    order = W.partitionBy("expected").orderBy(F.col("n").desc(), "predicted")
    return wrong.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def class_summary(rows: DataFrame, k: int = 3) -> DataFrame:
    """class, n, correct, recall and its k most frequent confusions, as (label, n) in falling order; ties by the labels' order."""
    cells = rows.groupBy(F.col("kind").alias("class"), predicted_label().alias("label")).agg(F.count(F.lit(1)).alias("cell"))
    place = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label"))
    wrong = F.when(F.col("label") != F.col("class"), F.struct((-F.col("cell")).alias("c"), place.alias("p"), F.col("label").alias("label")))
    by = cells.groupBy("class").agg(
        F.sum("cell").alias("n"), F.coalesce(F.sum(F.when(F.col("label") == F.col("class"), F.col("cell"))), F.lit(0)).alias("correct"), F.slice(F.array_sort(F.collect_list(wrong)), 1, k).alias("worst")
    )
    confusions = F.array_join(F.transform("worst", lambda w: F.concat(w["label"], F.lit(":"), (-w["c"]).cast("string"))), " ")
    return by.select("class", "n", "correct", share(F.col("correct"), F.col("n")).alias("recall"), confusions.alias("top_confusions"))


def pilot(rows: DataFrame) -> DataFrame:
    """How a verifier agrees with the labels of rows(task_id, difficulty, expected, kind, by seed): one row a seed.

    ``expected`` and ``kind`` are 'MATCH' or a type; recall is weighted, by the severity of the expected type.
    """
    weight, ex = weight_of(F.col("expected")), F.col("expected") != "MATCH"
    caught = F.when(severity_of(F.col("expected")) == "HIGH", F.col("kind") != "MATCH").otherwise(F.col("kind") == F.col("expected"))
    same = n_of(F.col("kind") == F.col("expected"))
    return rows.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n"), same.alias("agreed"), F.round(same / F.count(F.lit(1)), ROUND).alias("oracle_agreement"), n_of(ex).alias("exceptions"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(ex & caught, weight)), F.sum(F.when(ex, weight))), F.lit(0.0)), ROUND).alias("weighted_recall"),
        F.round(F.avg("difficulty"), ROUND).alias("difficulty_mean"), F.min("difficulty").alias("difficulty_min"), F.max("difficulty").alias("difficulty_max"),
    )


def pilot_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("seed", "expected").agg(F.count(F.lit(1)).alias("n"))


def disagreements(rows: DataFrame) -> DataFrame:
    return rows.where("kind <> expected").select("seed", "task_id", "expected", "kind")


def pilots(by_seed: DataFrame) -> DataFrame:
    """Of several seeds the least agreement."""
    return by_seed.agg(F.count(F.lit(1)).alias("seeds"), F.sum("n").alias("n"), F.min("oracle_agreement").alias("oracle_agreement_min"))


def accuracy(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), share(n_of(correct()), n).alias("accuracy"), share(n_of(F.col("p_verdict").isNotNull()), n).alias("parse_rate"))


def cost_columns(escalated: Column, missed: Column, per_escalation: float, per_miss: float) -> list[Column]:
    e, m = n_of(escalated), n_of(missed)
    return [e.alias("escalations"), m.alias("missed_high"), (per_escalation * e + per_miss * m).alias("total_cost")]


def cost(rows: DataFrame, per_escalation: float = 1.0, per_miss: float = 5.0) -> DataFrame:
    """Escalations and missed heavy types; a null on a heavy type counts as both."""
    escalated = F.col("p_verdict").isNull() | (F.col("p_verdict") == "ESCALATE")
    missed = is_exception() & (weight_of(F.col("kind")) >= HEAVY) & ~caught_by_weight()
    out = rows.agg(F.count(F.lit(1)).alias("n"), *cost_columns(escalated, missed, per_escalation, per_miss))
    return out.withColumn("normalized_cost", share(F.col("total_cost"), F.col("n")))
