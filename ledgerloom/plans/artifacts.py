"""Queries over artifacts: each writes tables of the driver as files, in a folder that all executors share, and reads them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement, calibrate, evidence, predictions, resample, score, split
from ..operators.generator import generate
from ..operators.groups import written
from ..operators.taxonomy import TYPES, severity_of
from ..operators.verify import verify
from ..sources import artifacts, extractions, shared, sinks
from ..sources.pairs import order_pairs
from . import views
from .corpus import FACTS, _triples_sql
from .registry import query, table
from .views import CORRECT_SQL, PAIRS_SQL, SCORED, VERIFIED


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def expected_of(kind: Column, explanation: Column) -> Column:
    """The label of a pair, as files carry it."""
    ex = kind != "MATCH"
    return F.struct(
        F.when(ex, "EXCEPTION").otherwise("MATCH").alias("verdict"), F.when(ex, kind).alias("exception_type"), severity_of(kind).alias("severity"), explanation.alias("explanation"), F.lit("flag-review").alias("resolution")
    )


@query(VERIFIED + "SELECT kind, severity, count(*) AS n FROM verified GROUP BY ALL")
def tasks_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs written as JSON lines, read back as tasks and judged."""
    path = shared.folder(spark, "tasks")
    order_pairs(spark, sf_dir).select("task_id", "ledger", "statement").select(F.to_json(F.struct("task_id", "ledger", "statement")).alias("value")).write.text(f"{path}/tasks.jsonl")
    return verify(spark.read.schema(artifacts.PAIR).json(f"{path}/tasks.jsonl")).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(VERIFIED + "SELECT kind, count(*) AS n FROM verified GROUP BY ALL")
def tasks_from_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs, from the first of some places that has tasks: behind one that there is not and an empty one, a folder of JSON lines."""
    path = shared.folder(spark, "places")
    for place in ("none", "folder"):
        fs, at = shared.filesystem(spark, f"{path}/{place}")
        fs.mkdirs(at)
    order_pairs(spark, sf_dir).select("task_id", "ledger", "statement").write.json(f"{path}/lines")
    for i, part in enumerate(n for n in shared.names(spark, f"{path}/lines") if n.startswith("part-")):
        fs.rename(shared.filesystem(spark, f"{path}/lines/{part}")[1], shared.filesystem(spark, f"{path}/folder/tasks-{i}.jsonl")[1])
    tasks = artifacts.tasks_from(spark, [f"{path}/nowhere", f"{path}/none", f"{path}/folder", f"{path}/lines"])
    return verify(tasks).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS seed, CAST(120 AS BIGINT) AS n FROM region ORDER BY r_regionkey DESC LIMIT 2")
def latest_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One benchmark artifact of 120 generated tasks a region, written one after the other; the newest that hold 200 tasks together."""
    path = shared.folder(spark, "benchmarks")
    seeds = tuple(sorted(int(r[0]) for r in table(spark, sf_dir, "region").select("r_regionkey").collect()))
    tasks = F.struct("task_id", "seed", "difficulty", "ledger", "statement")
    generate(spark, 120, seeds).groupBy("seed").agg(F.sort_array(F.collect_list(tasks)).alias("tasks")).write.parquet(f"{path}/made")
    for seed in seeds:
        sinks.write_named(_lines(spark.read.parquet(f"{path}/made").where(F.col("seed") == seed)), path, f"pilot-{seed}.json")
    return artifacts.latest_tasks(spark, path, 200).groupBy("seed").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, round(avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END), 4) AS agreement FROM (SELECT n_regionkey % 3 AS a, n_nationkey % 3 AS b FROM nation)")
def golden_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an old golden set, the newest and a local judge's, the newest that counts: agreement of its two labels."""
    path, rows = shared.folder(spark, "golden"), table(spark, sf_dir, "nation")
    made = lambda judge: _lines(rows.select(F.col("n_nationkey").cast("string").alias("task_id"), (F.col("n_regionkey") % 3).cast("string").alias("label"), judge.cast("string").alias("judge")))
    sinks.write_named(made(F.col("n_regionkey") % 3), path, "golden-old.jsonl")
    sinks.write_named(made(F.col("n_nationkey") % 3), path, "golden-new.jsonl")
    sinks.write_named(made(F.col("n_regionkey") % 3), path, "golden-new-local-judge.jsonl")
    return agreement.kappa(artifacts.newest_golden(spark, path), "label", "judge").select("n", "agreement")


@query("SELECT r_name || '.md' AS source, '# ' || r_name || chr(10) || n AS text FROM (SELECT r_name, string_agg(n_name, ', ' ORDER BY n_nationkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name)")
def markdown_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a region, read back whole from the first folder that has documents."""
    path = shared.folder(spark, "corpus")
    named = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ", ").alias("n"))
    rows = table(spark, sf_dir, "region").join(named, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", F.concat(F.lit("# "), "r_name", F.lit("\n"), "n").alias("value"))
    for r in rows.orderBy("r_name").collect():
        sinks.write_named(spark.createDataFrame([(r["value"],)], "value string"), path, f"{r['r_name']}.md")
    found = artifacts.first_with_files(spark, [f"{path}-none", path], ".md")
    return artifacts.read_corpus(spark, found).select("source", F.rtrim(F.regexp_replace("text", r"\n$", "")).alias("text"))


@query(_triples_sql(FACTS) + "SELECT relation, count(*) AS n FROM triples GROUP BY relation")
def extraction_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of all documents, extracted once and read from the newest cache by whoever asks for the best there are."""
    path, docs = shared.folder(spark, "extractions"), table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    extract = lambda d: evidence.extract(d, evidence.facts_table(spark, FACTS), "source", "text")
    artifacts.cached(docs, path, extract)
    return artifacts.best_triples(docs, path, f"{path}/canonical", extract).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(
    _triples_sql(FACTS) + ", r AS (SELECT relation AS what, count(*) AS n FROM triples GROUP BY relation), c AS (SELECT CASE WHEN doc_id % 7 = 3 THEN 'extracted' WHEN doc_id % 10 = 0 THEN 'extracted' END AS what FROM documents"
    " UNION ALL SELECT 'dropped' FROM documents WHERE doc_id % 10 = 0 AND doc_id % 7 <> 3 UNION ALL SELECT 'revived' FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 3 AND doc_id % 9 = 4)"
    " SELECT * FROM r UNION ALL SELECT what, count(*) FROM c WHERE what IS NOT NULL GROUP BY what"
)
def extraction_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of extractions that is refreshed three times: some texts are of old at first and some documents missing, then
    some are gone, then all is as it is now.  What it holds in the end, and what the last refresh had to do."""
    path, i = shared.folder(spark, "extractions"), F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", i.cast("string").alias("source"), "text")
    extract = lambda d: evidence.extract(d, evidence.facts_table(spark, FACTS), "source", "text")
    old = docs.where(i % 7 != 3).withColumn("text", F.when(i % 10 == 0, F.concat(F.lit("the version before and "), "text")).otherwise(F.col("text")))
    extractions.refresh(old, path, extract)
    extractions.refresh(old.where((i % 10 == 0) | (i % 9 != 4)), path, extract)
    held = extractions.refresh(docs, path, extract).groupBy(F.col("relation").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return held.unionByName(extractions.changes(spark, path, 3).withColumnRenamed("change", "what"))


_GOLD = [("GPL", "CONFLICTS_WITH", "ClosedSource", 0.95, "gold"), ("Der", "RELATED_TO", "German", 0.4, "gold"), ("GPL", "RELATED_TO", "Apache License", None, None), ("GPL", "COVERS", "Nowhere", 0.9, "gold")]
_GOLD_SQL = "(VALUES ('GPL','CONFLICTS_WITH','ClosedSource',0.95::DOUBLE), ('Der','RELATED_TO','German',0.4), ('GPL','RELATED_TO','Apache License',0.9)) AS g(head, relation, tail, confidence)"


@query(_triples_sql(FACTS) + f"SELECT head, relation, tail, max(confidence) AS confidence FROM (SELECT head, relation, tail, confidence FROM triples UNION ALL SELECT * FROM {_GOLD_SQL}) GROUP BY ALL")
def gold_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted triples and gold ones from a JSON array, as one bag, the most confident of equals; gold names without a type are left out."""
    path = shared.folder(spark, "gold")
    rows = spark.createDataFrame(_GOLD, "head string, relation string, tail string, confidence double, source string")
    sinks.write_named(rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")), path, "gold-triples.json")
    types = spark.createDataFrame(sorted({(f[i], f[i + 1]) for f in FACTS for i in (0, 3)}), "name string, type string")
    gold, _ = artifacts.read_gold(spark, f"{path}/gold-triples.json", types)
    mine = evidence.extract(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"), evidence.facts_table(spark, FACTS), "doc_id", "text")
    return evidence.merge_relations(evidence.with_gold(mine, gold)).select("head", "relation", "tail", "confidence")


@query(VERIFIED + "SELECT CASE WHEN kind = 'MATCH' THEN NULL ELSE kind END AS exception_type, verdict, k % 2 = 0 AS from_chat, count(*) AS n FROM verified GROUP BY ALL")
def eval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as evaluation records, odd ones with their label and even ones as chats that end with it; labels read back from both."""
    path = shared.folder(spark, "records")
    rows = views.verified(spark, sf_dir)
    kind = F.when(F.col("kind") != "MATCH", F.col("kind"))
    target = split.verdict_json(F.col("verdict"), kind, F.col("severity"), F.col("resolution"), F.col("reason"))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    chat = F.when(F.col("k") % 2 == 0, F.array(turn("user", F.lit("reconcile")), turn("assistant", target)))
    told = F.when(F.col("k") % 2 == 1, expected_of(F.col("kind"), F.col("reason")))
    written = rows.select("task_id", "ledger", "statement", told.alias("expected"), chat.alias("messages"))
    written.select(F.to_json(F.struct(*written.columns)).alias("value")).write.text(path)
    back = artifacts.read_eval_records(spark, path)
    even = F.substring("task_id", -1, 1).cast("int") % 2 == 0
    return back.groupBy(F.col("expected.exception_type").alias("exception_type"), F.col("expected.verdict").alias("verdict"), even.alias("from_chat")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, round(avg(CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey % 10 <> 3 THEN 1.0::DOUBLE ELSE 0 END), 4) AS accuracy, round(avg(CASE WHEN n_nationkey % 4 <> 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS parse_rate FROM nation")
def run_export_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation export, half of it listed per task and half per prediction: every fourth reply missing, every tenth wrong."""
    path, i = shared.folder(spark, "runs"), F.col("n_nationkey")
    kinds = F.array(*map(F.lit, (*TYPES, "MATCH")))
    kind = F.get(kinds, (i % 10).cast("int"))
    told = F.when(i % 10 == 3, F.lit("DUPLICATE")).otherwise(kind)
    verdict = lambda k: F.struct(F.when(k == "MATCH", "MATCH").otherwise("EXCEPTION").alias("verdict"), F.when(k != "MATCH", k).alias("exception_type"))
    rows = table(spark, sf_dir, "nation").select((i % 2).alias("side"), F.struct(i.cast("string").alias("task_id"), expected_of(kind, F.lit("")).alias("expected"), F.when(i % 4 != 0, verdict(told)).alias("predicted")).alias("r"))
    for side, name in ((0, "per_task"), (1, "per_prediction")):
        sinks.write_named(rows.where(F.col("side") == side).agg(F.to_json(F.struct(F.collect_list("r").alias(name))).alias("value")), path, f"run-{name}.json")
    back = artifacts.read_run(spark, path)
    return score.accuracy(back.select(F.coalesce("expected.exception_type", F.lit("MATCH")).alias("kind"), F.col("predicted.verdict").alias("p_verdict"), F.col("predicted.exception_type").alias("p_type")))


@query("SELECT count(*) FILTER (WHERE k % 2 = 0) AS later, count(*) FILTER (WHERE k % 2 <> 0 AND k % 3 < 2) AS earlier, count(*) FILTER (WHERE k % 2 <> 0 AND k % 3 = 2) AS pending FROM (SELECT o_orderkey AS k FROM orders)")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint that two runs appended to: of each task the last record counts, and what has none is pending."""
    path = shared.folder(spark, "checkpoint")
    tasks = table(spark, sf_dir, "orders").select(F.format_string("recon-%06d", "o_orderkey").alias("task_id"), F.col("o_orderkey").alias("k"))
    artifacts.append_records(tasks.where("k % 3 < 2").select("task_id", F.lit("first").alias("run")), path)
    artifacts.append_records(tasks.where("k % 2 = 0").select("task_id", F.lit("second").alias("run")), path)
    done = artifacts.last_records(spark, path, "task_id string, run string")
    runs = done.agg(F.coalesce(F.sum((F.col("run") == "second").cast("bigint")), F.lit(0)).alias("later"), F.coalesce(F.sum((F.col("run") == "first").cast("bigint")), F.lit(0)).alias("earlier"))
    return runs.crossJoin(artifacts.pending(tasks, done).agg(F.count(F.lit(1)).alias("pending")))


def told_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of predictions as a run leaves it: none for every thirteenth pair, two for every seventh, and some for pairs that there are not."""
    rows, _ = written(views.predicted(spark, sf_dir).select("k", "task_id", "p_verdict", "p_type", "confidence", F.lit(2).alias("at")), "predictions")
    kept = rows.where("k % 13 <> 0")
    first = kept.where("k % 7 = 0").select("k", "task_id", F.lit("ESCALATE").alias("p_verdict"), F.lit(None).cast("string").alias("p_type"), F.lit(0.0).alias("confidence"), F.lit(1).alias("at"))
    odd = kept.where("k % 11 = 0").withColumn("task_id", F.concat(F.lit("gone-"), "task_id"))
    return kept.unionByName(first).unionByName(odd).drop("k")


_JOINED = SCORED + ", j AS (SELECT * REPLACE (CASE WHEN k % 13 = 0 THEN NULL ELSE p_verdict END AS p_verdict, CASE WHEN k % 13 = 0 THEN NULL ELSE p_type END AS p_type) FROM scored) "


@query(_JOINED + f"SELECT count(*) AS n, round(count(*) FILTER (WHERE {CORRECT_SQL})::DOUBLE / count(*), 4) AS accuracy, round(count(*) FILTER (WHERE p_verdict IS NOT NULL)::DOUBLE / count(*), 4) AS parse_rate FROM j")
def joined_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of a table of predictions joined to the tasks by id."""
    tasks = views.verified(spark, sf_dir).select("task_id", "kind")
    return score.accuracy(predictions.attach(tasks, told_predictions(spark, sf_dir), order="at"))


@query("SELECT count(*) FILTER (WHERE k % 13 <> 0) AS predicted, count(*) FILTER (WHERE k % 13 = 0) AS missing, count(*) FILTER (WHERE k % 13 <> 0 AND k % 11 = 0) AS surplus FROM (SELECT o_orderkey AS k FROM orders)")
def joined_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions.coverage(order_pairs(spark, sf_dir).select("task_id"), told_predictions(spark, sf_dir).select("task_id"))


_LABEL = "CASE WHEN p_verdict IS NULL THEN 'UNPARSEABLE' ELSE coalesce(p_type, 'MATCH') END"


@query(SCORED + f"SELECT kind || '->' || {_LABEL} AS change, count(*) AS n FROM scored WHERE kind <> {_LABEL} GROUP BY ALL")
def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where labels and predictions, both as one category, part."""
    rows = views.predicted(spark, sf_dir).select("kind", predictions.label(F.col("p_verdict"), F.col("p_type")).alias("judge"))
    return agreement.confusions(rows, "kind", "judge")


_CLASSES = "[" + ", ".join(f"'{x}'" for x in score.LABELS) + "]"


@query(
    SCORED + ", c AS (SELECT kind AS class, coalesce(p_type, p_verdict, 'PARSE_FAIL') AS label, count(*) AS cell FROM scored GROUP BY ALL),"
    f" r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY label = class, cell DESC, list_position({_CLASSES}, label)) AS nth FROM c)"
    " SELECT class, CAST(sum(cell) AS BIGINT) AS n, CAST(coalesce(sum(cell) FILTER (WHERE label = class), 0) AS BIGINT) AS correct, round(coalesce(sum(cell) FILTER (WHERE label = class), 0)::DOUBLE / sum(cell), 4) AS recall,"
    " coalesce(string_agg(label || ':' || cell, ' ' ORDER BY nth) FILTER (WHERE nth <= 3 AND label <> class), '') AS top_confusions FROM r GROUP BY class"
)
def confusion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.class_summary(views.predicted(spark, sf_dir))


@query(
    f"WITH {PAIRS_SQL} SELECT task_id, rtrim('Ledger message MT103 against statement message ' || CASE WHEN there THEN 'camt.054' ELSE 'UNKNOWN' END || ' for ' || l_amount || ' ' || l_ccy) || ' with value date ' || l_date"
    " || CASE WHEN there THEN '' ELSE ' has provisional verdict EXCEPTION with exception MISSING_MESSAGE severity MEDIUM reason: statement message missing' END AS claim FROM pairs WHERE NOT there"
)
def missing_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate is asked of each pair without a statement."""
    rows = views.verified(spark, sf_dir).where("statement IS NULL")
    kind = F.when(F.col("kind") != "MATCH", F.col("kind"))
    return rows.select("task_id", evidence.build_claim(F.col("ledger"), F.col("statement"), F.col("verdict"), kind, F.col("severity"), F.col("reason")).alias("claim"))


@query(
    SCORED + ", f AS (SELECT *, p_verdict IS NULL OR p_verdict <> 'MATCH' AS flag FROM scored), c AS (SELECT count(*) FILTER (WHERE ex AND flag) AS tp, count(*) FILTER (WHERE NOT ex AND flag) AS fp, count(*) FILTER (WHERE ex AND NOT flag) AS fn FROM f),"
    f" b AS (SELECT greatest(0, least(9, CAST(floor(confidence * 10) AS INTEGER))) AS bin, confidence, CASE WHEN {CORRECT_SQL} THEN 1.0::DOUBLE ELSE 0 END AS ok FROM scored WHERE p_verdict IS NOT NULL), g AS (SELECT bin, count(*) AS n, avg(confidence) AS c, avg(ok) AS a FROM b GROUP BY bin)"
    " SELECT 'flags' AS artifact, 'f1' AS name, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 4) AS value FROM c UNION ALL SELECT 'flags', 'precision', round(tp::DOUBLE / (tp + fp), 4) FROM c"
    " UNION ALL SELECT 'ece', 'ece', round(sum(n * abs(a - c)) / sum(n), 4) FROM g UNION ALL SELECT 'calibration', 'bin ' || bin, round(a, 4) FROM g"
    f" UNION ALL SELECT 'intervals', 'accuracy', round(avg(CASE WHEN {CORRECT_SQL} THEN 1.0::DOUBLE ELSE 0 END), 4) FROM scored"
)
def score_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag metrics, calibration and intervals of one predictor, written as files of JSON lines and read back."""
    path = shared.folder(spark, "scores")
    rows, _ = written(views.predicted(spark, sf_dir).select("kind", "p_verdict", "p_type", "confidence"), "predictions")
    right = rows.select(score.correct().cast("int").alias("ok"))
    drawn = resample.draws(right, ["ok"])
    interval = resample.interval(drawn.groupBy("replicate").agg((F.sum(F.col("ok") * F.col("w")) / F.sum("w")).alias("value"))).crossJoin(right.agg(F.round(F.avg("ok"), 4).alias("point")))
    sinks.write_tables({"flags": score.flag_scores(rows), "ece": calibrate.ece(rows), "calibration": calibrate.ece_curve(rows), "intervals": interval}, path)
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}.jsonl")
    told = lambda rows, artifact, name, value: rows.select(F.lit(artifact).alias("artifact"), name.alias("name"), F.col(value).alias("value"))
    flags = read("flags", "f1 double, precision double")
    held = read("intervals", "low double, point double, high double").where("low <= point AND point <= high")
    return (
        told(flags, "flags", F.lit("f1"), "f1").unionByName(told(flags, "flags", F.lit("precision"), "precision")).unionByName(told(read("ece", "ece double"), "ece", F.lit("ece"), "ece"))
        .unionByName(told(read("calibration", "bin int, accuracy double"), "calibration", F.concat(F.lit("bin "), F.col("bin").cast("string")), "accuracy"))
        .unionByName(told(held, "intervals", F.lit("accuracy"), "point"))
    )
