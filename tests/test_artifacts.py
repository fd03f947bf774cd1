import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import evidence, predictions, repair, routing
from ledgerloom.sources import artifacts, shared, sinks
from tests.test_verify import LEDGER, STATEMENT

TASK = {"task_id": "t1", "seed": 1, "difficulty": 0.5, "ledger": LEDGER, "statement": STATEMENT, "expected": None}


def test_tasks_from_lines_arrays_and_wrapped_objects(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps(TASK) + "\n\n{broken\n")
    (tmp_path / "list.json").write_text(json.dumps([TASK, {**TASK, "task_id": "t2"}]))
    (tmp_path / "wrapped.json").write_text(json.dumps({"tasks": [TASK]}))
    lines = artifacts.read_tasks(spark, str(tmp_path)).collect()
    assert sorted(str(r["task_id"]) for r in lines) == ["None", "t1"]
    assert artifacts.read_tasks(spark, f"{tmp_path}/list.json").count() == 2
    assert artifacts.read_tasks(spark, f"{tmp_path}/wrapped.json").first()["ledger"]["ref"] == LEDGER["ref"]


def test_the_last_record_of_a_task_counts(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"task_id": t, "run": r}) for t, r in (("x", "1"), ("y", "1"), ("x", "2"))))
    got = artifacts.last_records(spark, str(tmp_path), "task_id string, run string")
    assert {r["task_id"]: r["run"] for r in got.collect()} == {"x": "2", "y": "1"}
    tasks = spark.createDataFrame([("x",), ("z",)], "task_id string")
    assert [r["task_id"] for r in artifacts.pending(tasks, got).collect()] == ["z"]


def test_extraction_is_cached_by_content(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one"), ("b", "two")], "source string, text string")
    calls = []
    extract = lambda d: calls.append(1) or d.select("source")
    folder = f"{tmp_path}/cache"
    assert artifacts.newest_cache(spark, folder) is None
    for d in (docs, docs.orderBy(F.desc("source")), docs.where("source = 'a'")):
        artifacts.cached(d, folder, extract)
    assert len(calls) == 2
    assert artifacts.cache_key(docs) != artifacts.cache_key(docs, offline=False)
    assert artifacts.best_triples(docs, folder, f"{tmp_path}/none", extract).count() == 1
    assert artifacts.best_triples(docs, f"{tmp_path}/no", f"{tmp_path}/none", extract).count() == 2


def test_gold_without_types_is_told_apart(spark, tmp_path):
    rows = [{"head": "A", "relation": "COVERS", "tail": "B"}, {"head": "A", "relation": "COVERS", "tail": "?", "confidence": 0.5, "source": "s"}]
    (tmp_path / "gold.json").write_text(json.dumps(rows))
    types = spark.createDataFrame([("A", "Rule"), ("B", "Risk")], "name string, type string")
    gold, skipped = artifacts.read_gold(spark, f"{tmp_path}/gold.json", types)
    assert [(r["tail"], r["confidence"], r["source"]) for r in gold.collect()] == [("B", 0.9, "gold-triples.json")] and skipped.count() == 1


def test_corpus_in_order_with_names_as_they_are(spark, tmp_path):
    for name in ("b c.md", "a+b.md", "skip.txt"):
        (tmp_path / name).write_text(f"# {name}\n\nbody\n")
    got = [tuple(r) for r in artifacts.read_corpus(spark, str(tmp_path)).collect()]
    assert got == [("a+b.md", "# a+b.md\n\nbody\n"), ("b c.md", "# b c.md\n\nbody\n")]
    assert artifacts.first_with_files(spark, [f"{tmp_path}/none", str(tmp_path)], ".md") == str(tmp_path)
    assert artifacts.first_with_files(spark, [str(tmp_path)], ".pdf") is None


def test_artifacts_are_one_canonical_line(spark, tmp_path):
    sinks.write_artifact(spark.createDataFrame([(1, None)], "b int, a string"), f"{tmp_path}/out/report.json")
    assert (tmp_path / "out/report.json").read_text() == '{"a":null,"b":1}\n'
    assert shared.folder(spark, "x") != shared.folder(spark, "x")


def test_predictions_join_by_id(spark):
    tasks = spark.createDataFrame([("a", 1), ("b", 2)], "task_id string, n int")
    told = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("c", "z", 1), (None, "q", 1)], "task_id string, p string, at int")
    assert {r["task_id"]: r["p"] for r in predictions.attach(tasks, told, order="at").collect()} == {"a": "x", "b": None}
    assert tuple(predictions.coverage(tasks, told).first()) == (1, 1, 1)


def test_contracts_name_what_is_broken(spark):
    from ledgerloom.sources.pairs import PAIR

    expected = {"verdict": "MATCH", "severity": "LOW", "explanation": "e", "resolution": "r"}
    rows = [({**TASK, "expected": expected}, []), ({**TASK, "task_id": "", "difficulty": 2.1}, ["task_id", "difficulty"]), ({**TASK, "ledger": None}, ["ledger"]), ({**TASK, "expected": {**expected, "verdict": "SURE", "resolution": None}}, ["expected.verdict", "expected.resolution"]), ({**TASK, "statement": {**STATEMENT, "message_type": "MT999", "ref": None}}, ["statement.message_type", "statement.ref"])]
    table = spark.createDataFrame([tuple(t[c] for c in ("task_id", "seed", "difficulty", "ledger", "statement", "expected")) for t, _ in rows], PAIR)
    assert [r["c"] for r in table.select(routing.violations(table).alias("c")).collect()] == [c for _, c in rows]
    answers = spark.createDataFrame([("t", "APPROVE", ""), (None, "MAYBE", "x" * 2001)], "t string, d string, n string")
    assert [r["c"] for r in answers.select(routing.resolution_violations(*map(F.col, "tdn")).alias("c")).collect()] == [[], ["task_id", "decision", "note"]]


def test_a_broken_graph_is_refused(spark):
    entities = spark.createDataFrame([("A", "Rule"), ("B", "Risk")], "name string, type string")
    sound = spark.createDataFrame([("A", "COVERS", "B", 0.5)], "head string, relation string, tail string, confidence double")
    assert evidence.checked(entities, sound).count() == 1
    for wrong in (("A", "OWNS", "B", 0.5), ("A", "COVERS", "C", 0.5), ("A", "COVERS", "B", 1.5), ("", "COVERS", "B", 0.5)):
        with pytest.raises(Exception, match="breaks its rules"):
            evidence.checked(entities, spark.createDataFrame([wrong], sound.schema)).collect()
    with pytest.raises(Exception, match="breaks its rules"):
        evidence.checked(entities.union(spark.createDataFrame([("X", "Word")], entities.schema)), sound).collect()


def test_terms_have_word_borders(spark):
    rows = spark.createDataFrame([("See pacs.008. A C# tool, café x_y",)], "t string")
    assert rows.select(T.terms(F.col("t")).alias("x")).first()["x"] == ["see", "pacs.008", "a", "c", "tool"]
    low = F.lit("mt103, see apache.org; my.mt202 not xmt300")
    for term, there in (("mt103", True), ("apache", True), ("mt202", False), ("mt300", False), ("see apache", True)):
        assert rows.select(T.has_term(low, T.padded(low), F.lit(term)).alias("x")).first()["x"] is there


def test_many_open_braces_end_soon():
    assert repair.balanced("{" * 100_000) is None
    assert repair.balanced('{"a": "}" , "b": [1, {"c": "') == '{"a": "}" , "b": [1, {"c": ""}]}'


def test_dense_search_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)).round(2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, None)], "id long, v array<double>")
    got = {(r["query_id"], r["rank"]): r["key"] for r in evidence.dense_top(rows.where("id % 100 = 0"), rows, "id", "v", 4).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in (0, 100, 200):
        s = np.round(unit @ unit[q], 4)
        assert [got[q, k + 1] for k in range(4)] == [j for j in np.lexsort((np.arange(300), -s)) if j != q][:4]


def test_the_first_place_with_tasks_counts(spark, tmp_path):
    from tests.test_verify import LEDGER, STATEMENT

    task = lambda i: {"task_id": f"t{i}", "ledger": LEDGER, "statement": STATEMENT}
    for name in ("empty", "lines", "pilots"):
        (tmp_path / name).mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text(json.dumps(task(1)) + "\n")
    (tmp_path / "pilots" / "pilot-1.json").write_text(json.dumps({"seed": 1, "tasks": [task(2), task(3)]}))
    places = lambda *names: artifacts.tasks_from(spark, [f"{tmp_path}/{n}" for n in names])
    ids = lambda rows: sorted(r["task_id"] for r in rows.collect())
    assert ids(places("nowhere", "empty", "pilots", "lines")) == ["t2", "t3"] and ids(places("empty", "lines", "pilots")) == ["t1"]
    assert ids(places("lines/a.jsonl")) == ["t1"] and places("nowhere", "empty") is None
