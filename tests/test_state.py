import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import contamination, ledger, resample, split
from ledgerloom.sources import pairs, sinks
from ledgerloom.streaming import pipeline, windows

T0 = dt.datetime(2026, 1, 1)


def test_first_write_stays(spark):
    rows = spark.createDataFrame([("a", T0, 2, "late"), ("a", T0, 1, "first"), ("b", T0, 3, "only")], "k string, at timestamp_ntz, n int, v string")
    assert {r["k"]: r["v"] for r in ledger.first_write(rows, "k", "at", "n").collect()} == {"a": "first", "b": "only"}
    assert [r["k"] for r in ledger.append_new(rows.where("k = 'a'"), rows, "k", "at", "n").collect()] == ["b"]


def test_reviews_end_once(spark):
    acts = [("a", 1, "open"), ("a", 2, "resolve"), ("a", 3, "timeout"), ("b", 1, "resolve"), ("b", 2, "open"), ("c", 1, "open"), ("c", 5, "timeout"), ("d", 1, "resolve")]
    rows = spark.createDataFrame([(k, T0 + dt.timedelta(hours=n), n, a) for k, n, a in acts], "k string, at timestamp_ntz, n int, action string")
    got = {r["k"]: (r["status"], r["refused"]) for r in ledger.fold_reviews(rows, "k", "at", "n").collect()}
    assert got == {"a": ("resolved", 1), "b": ("pending", 0), "c": ("timed_out", 0)}


def test_bounds():
    with pytest.raises(ValueError):
        ledger.stats(None, T0, hours=0)
    with pytest.raises(ValueError):
        ledger.pending(None, "k", limit=1001)


def test_leak_probe_and_roc(spark):
    rows = spark.range(100).select("id", F.sha2(F.col("id").cast("string"), 256).alias("sig"))
    clean = contamination.leak_probe(rows.where("id < 50"), rows.where("id >= 50")).first()
    assert clean["matches"] == 0 and not clean["fired"]
    one = contamination.leak_probe(rows.where("id < 51"), rows.where("id >= 50")).first()
    assert one["matches"] == 1 and one["fired"]
    points = contamination.leak_roc(rows.where("id < 50"), rows.where("id >= 50"), "id").collect()
    assert {p["fraction"]: p["n_leaked"] for p in points} == {0.05: 2, 0.1: 5, 0.2: 10, 0.5: 25}  # 2.5 goes to the even
    assert all(p["false_fire_on_clean"] == 0.0 for p in points)


def test_near_duplicates(spark):
    from ledgerloom.functions.text import word_shingles

    text = " ".join(f"w{i}" for i in range(200))
    rows = spark.createDataFrame([(1, text), (2, text), (3, text.replace("w100", "x")), (4, text[::-1]), (None, text), (9, None), (8, "")], "id long, text string")
    got = {r["key"]: (r["class"], r["group"]) for r in contamination.near_groups(rows, "id", word_shingles(F.col("text"))).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 4), None: (1, 1), 9: (8, 8), 8: (8, 8)}
    assert contamination.near_groups(rows.limit(0), "id", word_shingles(F.col("text"))).collect() == []


def test_near_duplicates_of_crowds_and_chains_equal_brute_force(spark):
    """Copies of a text with two edits each, most of them unlike each other, and chains that leave it step by step."""
    import random

    from ledgerloom.functions.text import word_shingles

    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"

    def edited(words, n):
        at = set(rng.sample(range(len(words)), n))
        return [word() if i in at else w for i, w in enumerate(words)]

    base = [word() for _ in range(200)]
    texts = [base] + [edited(base, 2) for _ in range(300)]
    for _ in range(15):
        chain = base
        for _ in range(5):
            chain = edited(chain, 3)
            texts.append(chain)
    texts += [edited(base, 50) for _ in range(15)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    group = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if group[i] != group[j] and len(x & y) >= 0.8 * len(x | y):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "id long, text string")
    got = {r["key"]: r["group"] for r in contamination.near_groups(rows, "id", word_shingles(F.col("text"))).collect()}
    assert got == dict(enumerate(group)) and 15 < len(set(group)) < 60


def test_sets_move_for_likely_pairs_only(spark, monkeypatch):
    from ledgerloom.functions.text import word_shingles

    seen, keep = {}, contamination.written
    monkeypatch.setattr(contamination, "written", lambda df, name: seen.setdefault(name, keep(df, name)))
    texts = [" ".join(f"w{i}-{j}" for j in range(60)) for i in range(50)]
    texts += [texts[7] + " more", texts[9], texts[9], texts[9]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["key"]: (r["class"], r["group"]) for r in contamination.near_groups(rows, "id", word_shingles(F.col("text"))).collect()}
    assert got == {**{i: (i, i) for i in range(50)}, 50: (50, 7), **{i: (9, 9) for i in (51, 52, 53)}}
    assert seen["near-asked"][0].count() == 2 and seen["near-signed"][0].count() == 51 and "s" not in seen["near-signed"][0].columns


def test_components_of_a_long_chain(spark):
    from ledgerloom.operators.groups import components

    links = spark.range(400).select((F.col("id") * 7919 % 401).alias("a"), ((F.col("id") + 1) * 7919 % 401).alias("b"))
    assert components(links).where("group <> 0").count() == 0
    pairs = spark.createDataFrame([(5, 9), (9, 7), (3, 4), (8, 8)], "a long, b long")
    assert {tuple(r) for r in components(pairs).collect()} == {(5, 5), (9, 5), (7, 5), (3, 3), (4, 3)}


def test_nearest_neighbours_equal_brute_force(spark):
    import hashlib
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    texts += [t[:-1] + "z" for t in texts[:6]]
    perms = contamination.universal_perms(16, 11)
    prime = (1 << 61) - 1

    def sign(t):
        x = [int.from_bytes(hashlib.md5(s.encode()).digest()[:8], "big") for s in {t[i : i + 5] for i in range(max(1, len(t) - 4))}]
        return [min((a * v + b) % prime for v in x) for a, b in perms]

    signs = [sign(t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: (r["nearest"], r["similarity"]) for r in contamination.near_duplicate_audit(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0"), "id", F.col("text"), perms=16).collect()}
    for i in range(0, len(texts), 3):
        same = {j: sum(a == b for a, b in zip(signs[i], signs[j])) for j in range(len(texts)) if j % 3}
        best = min(same, key=lambda j: (-same[j], j))
        assert got[i] == (best, round(same[best] / 16, 4))
    alone = contamination.near_duplicate_audit(rows.limit(0), rows.where("id < 2"), "id", F.col("text")).collect()
    assert [r["similarity"] for r in alone] == [0.0, 0.0]
    bins = contamination.similarity_histogram(spark.createDataFrame([(0.05,), (0.8,), (0.8999,), (1.0,)], "similarity double")).collect()
    assert {r["bin"]: r["n"] for r in bins} == {**dict.fromkeys(range(11), 0), 0: 1, 8: 2, 10: 1}


def test_tiles_find_what_brute_force_finds(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = np.where(rng.random((3000, 24)) < 0.6, 0, rng.integers(0, 700, (3000, 24)))
    rows[2000:2500] = rows[:500]
    asked = np.where(rng.random((60, 24)) < 0.2, rng.integers(0, 1400, (60, 24)), rows[rng.integers(0, 3000, 60)])
    asked[0], asked[1] = 5000, rows[2100]
    split = lambda x: [np.unique(c, return_inverse=True) for c in x.T]
    packed = lambda x: ([v for v, _ in split(x)], np.stack([i for _, i in split(x)], 1).astype(np.uint32))
    same = (asked[:, None] == rows[None]).sum(axis=2)
    for few in (0, 40, 4000):
        monkeypatch.setattr(contamination, "FEW", few)
        tile = contamination._Tile(*packed(rows))
        assert [tile.nearest(a) for a in tile.translated(*packed(asked))] == [(int(s.argmax()), int(s.max())) for s in same]


def test_a_tile_passes_over_what_is_farther_than_a_known_row():
    """What is as near as the known row is found, the first of equals; nothing where all rows are farther."""
    import numpy as np

    rng = np.random.default_rng(5)
    kinds = [np.arange(40) for _ in range(64)]
    rows = np.minimum(rng.geometric(0.2, (3_000, 64)), 39).astype(np.uint32)
    rows[[700, 2_900]] = rows[40]
    tile = contamination._Tile(kinds, rows)
    asked = np.concatenate([rows[[40, 5]], np.minimum(rng.geometric(0.2, (30, 64)), 39)]).astype(np.uint32)
    same = (rows[None] == asked[:, None]).sum(axis=2)
    want = [(int(s.argmax()), int(s.max())) for s in same]
    signs = tile.translated(kinds, asked)
    assert want[0] == (40, 64) and tile.all_nearest(signs, [0] * 32) == want == tile.all_nearest(signs, [n for _, n in want])
    assert tile.all_nearest(signs, [n - 2 for _, n in want]) == want
    assert {n for _, n in tile.all_nearest(signs[1:], [n + 1 for _, n in want[1:]])} == {0}
    assert all(0 < g <= n for g, (_, n) in zip(tile.glances(signs), want))


def test_shingles_of_a_form_are_looked_at_once(spark):
    """Texts of one form, some of which miss a part of it, have the signatures that plain hashing gives, and few shingles of their own."""
    import hashlib

    import numpy as np

    a, b = np.array(perms := contamination.universal_perms(4, 11), np.uint64).T
    texts = [f'{{"one form of all texts": "{i * 7919 % 1000}", "and its end": null}}' for i in range(200)]
    texts[77], texts[78], texts[79], texts[80] = "", "abc", texts[77][:20], "not of the form"
    want = [[min((p * int.from_bytes(hashlib.md5(s.encode()).digest()[:8], "big") + q) % ((1 << 61) - 1) for s in {t[i : i + 5] for i in range(max(1, len(t) - 4))}) for p, q in perms] for t in texts]
    assert contamination._signed(texts, 5, a, b).tolist() == want
    alike = texts[:77] + texts[81:]
    assert contamination._signed(alike, 5, a, b).tolist() == want[:77] + want[81:]
    _, where, form, whole = contamination._shingled(alike, 5)
    assert whole.all() and form > 35 and max(map(len, where)) < 12


def test_signatures_of_awkward_texts_equal_plain_hashing(monkeypatch):
    import hashlib

    import numpy as np

    perms = contamination.universal_perms(6, 11)
    a, b = np.array(perms, np.uint64).T
    for texts in (["", "a", "abcd", "\x00\x00\x00\x00a", "abcabcabcabc"], ["", "\U0010ffff\U0001f600", "\U0001f600bcdef", "x" * 9]):
        want = [[min((p * int.from_bytes(hashlib.md5(s.encode()).digest()[:8], "big") + q) % ((1 << 61) - 1) for s in {t[i : i + 5] for i in range(max(1, len(t) - 4))}) for p, q in perms] for t in texts]
        for held in (1, 1 << 20):
            monkeypatch.setattr(contamination, "HELD_VALUES", held)
            assert contamination._signed(texts, 5, a, b).tolist() == want


def test_rows_of_one_file_are_signed_by_many_tasks(spark, monkeypatch):
    seen = {}
    keep = contamination.written
    monkeypatch.setattr(contamination, "written", lambda df, name: seen.setdefault(name, keep(df, name)))
    rows = spark.range(0, 400, 1, 1).withColumn("text", F.sha2(F.col("id").cast("string"), 256))
    got = contamination.near_duplicate_audit(rows.where("id % 8 <> 0"), rows.where("id % 8 = 0").withColumn("text", F.sha2((F.col("id") + 1).cast("string"), 256)), "id", F.col("text"), perms=8).collect()
    assert all(r["nearest"] == r["id"] + 1 and r["similarity"] == 1.0 for r in got) and len(got) == 50
    assert seen["audit-train"][0].count() == 4


def test_a_splice_takes_training_rows_again_where_they_are_few(spark):
    rows = spark.range(100).select("id", F.sha2(F.col("id").cast("string"), 256).alias("sig"))
    points = contamination.leak_roc(rows.where("id < 3"), rows.where("id >= 50"), "id").collect()
    assert all(p["fire_on_leaked"] == 1.0 and p["false_fire_on_clean"] == 0.0 for p in points)
    nothing = contamination.leak_roc(rows.limit(0), rows.where("id >= 50"), "id").collect()
    assert all(p["fire_on_leaked"] == 0.0 for p in nothing)


def test_signatures_keep_fields_apart(spark):
    from ledgerloom.sources.pairs import PAIR
    from tests.test_verify import LEDGER, STATEMENT

    sides = [({**LEDGER, "ref": 'x","ledger.value_date":"y'}, STATEMENT), ({**LEDGER, "ref": "x"}, STATEMENT), (LEDGER, None), (LEDGER, dict.fromkeys(STATEMENT)), ({**LEDGER, "ccy": None}, None), ({**LEDGER, "ccy": "null"}, None)]
    rows = spark.createDataFrame([(str(i), 1, 0.5, l, s, None) for i, (l, s) in enumerate(sides)], PAIR)
    assert rows.select(contamination.pair_signature().alias("s")).distinct().count() == len(sides)


def test_split_is_stable_and_guarded(spark):
    rows = spark.range(500).select(F.format_string("t%04d", "id").alias("task_id"), (F.col("id") % 7).alias("s"))
    a = split.stratified(rows, ["s"], "task_id")
    b = split.stratified(rows.repartition(9), ["s"], "task_id")
    assert a.exceptAll(b).isEmpty()
    assert all(0 < r["n_train"] < r["n"] for r in split.balance(a, ["s"]).collect())
    assert split.guarded(a, ["task_id"]).count() == 500
    with pytest.raises(Exception, match="share values"):
        split.guarded(a, ["s"]).collect()


def test_bootstrap_draws_all_rows_and_is_as_wide_as_the_normal(spark):
    n = 4000
    rows = spark.range(n).select((F.col("id") % 4 != 0).cast("int").alias("ok"))
    drawn = resample.draws(rows, ["ok"], 2000)
    assert drawn.groupBy("replicate").agg(F.sum("w").alias("n")).where(f"n <> {n}").isEmpty()
    r = resample.interval(drawn.groupBy("replicate").agg((F.sum(F.col("ok") * F.col("w")) / F.sum("w")).alias("value"))).first()
    half = 1.96 * (0.75 * 0.25 / n) ** 0.5
    assert abs(r["mean"] - 0.75) < 0.002 and abs((r["high"] - r["low"]) / 2 / half - 1) < 0.1
    again = resample.draws(rows.repartition(7), ["ok"], 2000)
    assert drawn.exceptAll(again).isEmpty()
    assert resample.draws(rows.limit(0), ["ok"], 10).count() == 0


def test_intervals_by_nearest_rank_and_signs(spark):
    values = spark.createDataFrame([("m", float(i), 0.0) for i in range(1000)], "g string, a double, b double")
    r = resample.interval(values.select("g", F.col("a").alias("value")), by=("g",)).first()
    assert (r["low"], r["high"]) == (25.0, 974.0)
    padded = resample.interval(values.where("a < 500").select(F.col("a").alias("value")), replicates=1000).first()
    assert (padded["low"], padded["high"], padded["replicates"]) == (0.0, 474.0, 1000)
    p = resample.paired(spark.createDataFrame([(1.0, 0.0)] * 95 + [(0.0, 0.0)] * 5, "a double, b double")).first()
    assert p["p_value"] == 0.1
    study = resample.study(spark.createDataFrame([("a", "DUPLICATE", 0.2, 1, 1), ("a", "MATCH", 0.0, 0, 1), ("a", "AMOUNT_MISMATCH", 1.0, 0, 0)] * 20, "run string, kind string, weight double, caught int, right int"), 200)
    got = {(r["metric"], r["part"]): r for r in study.collect()}
    assert got["accuracy", "all"]["point"] == 0.6667 and got["weighted_recall", "all"]["point"] == 0.1667 and got["type_recall", "DUPLICATE"]["low"] == 1.0
    assert got["accuracy", "all"]["low"] < 0.6667 < got["accuracy", "all"]["high"]


def test_ranks_need_no_sort_of_a_group(spark):
    from ledgerloom.operators.ranks import ranked

    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    got = ranked(rows, ["g"], F.md5(F.col("id").cast("string")), "id")
    want: dict = {}
    import hashlib

    for r in sorted(rows.collect(), key=lambda r: hashlib.md5(str(r["id"]).encode()).hexdigest()):
        want.setdefault(r["g"], []).append(r["id"])
    assert {(r["g"], r["_rank"], r["_n"]): r["id"] for r in got.collect()} == {(g, i + 1, len(ids)): x for g, ids in want.items() for i, x in enumerate(ids)}


def test_stream_equals_table(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    q = windows.tumbling(stream, late=None).writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    table = windows.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet"))
    assert spark.table("hourly").exceptAll(table).isEmpty() and spark.table("hourly").count() == table.count()


def test_pipeline_runs_twice_without_doubling(spark, tmp_path):
    from tests.test_verify import LEDGER, STATEMENT

    source, target = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    tasks = [{"task_id": f"t{i}", "ledger": LEDGER, "statement": {**STATEMENT, "amount": "1250.00" if i % 2 else "9.00"}, "event_id": f"e{i}", "created_at": "2026-01-01T00:00:00Z"} for i in range(6)]
    (source / "a.json").write_text("\n".join(map(json.dumps, tasks)) + "\n{broken\n" + json.dumps({"task_id": "x"}) + "\n" + json.dumps({**tasks[1], "task_id": "odd", "difficulty": 9.0, "ledger": {**LEDGER, "fx_rate": 1e300}}) + "\n")
    for name in ("b.json",):
        pipeline.run(spark, str(source), target, f"{tmp_path}/cp").awaitTermination()
        (source / name).write_text(json.dumps(tasks[0]) + "\n")
        pipeline.run(spark, str(source), target, f"{tmp_path}/cp").awaitTermination()
    held = pipeline.ledger(spark, target).read()
    assert held.where("source = 'model'").count() == 6 and held.select("task_id").distinct().count() == held.count() == 8
    assert [tuple(r) for r in held.where("source = 'system'").select("task_id", "verdict", "kind").orderBy("task_id").collect()] == [("odd", "ESCALATE", "FIELD_CORRUPTION"), ("x", "ESCALATE", "FIELD_CORRUPTION")]
    assert spark.read.parquet(f"{target}/escalations").count() == 3 and spark.read.parquet(f"{target}/verdicts").count() == 3
    assert spark.read.parquet(f"{target}/dead").count() == 3


def test_a_first_batch_of_broken_lines_only_stops_nothing(spark, tmp_path):
    from tests.test_verify import LEDGER, STATEMENT

    source, target = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    (source / "a.json").write_text("{broken\n")
    pipeline.run(spark, str(source), target, f"{tmp_path}/cp").awaitTermination()
    (source / "b.json").write_text(json.dumps({"task_id": "t", "ledger": LEDGER, "statement": STATEMENT, "event_id": "e", "created_at": "2026-01-01T00:00:00Z"}) + "\n")
    pipeline.run(spark, str(source), target, f"{tmp_path}/cp").awaitTermination()
    assert pipeline.ledger(spark, target).read().count() == 1 and spark.read.parquet(f"{target}/verdicts").count() == 1


def test_files_round_trip(spark, tmp_path):
    from tests.test_verify import LEDGER, STATEMENT

    one = {"task_id": "t1", "seed": 1, "difficulty": 0.5, "ledger": LEDGER, "statement": STATEMENT, "expected": None}
    (tmp_path / "a.jsonl").write_text(json.dumps(one) + "\n\n" + json.dumps({**one, "task_id": "t2", "statement": None}) + "\n")
    rows = pairs.read_pairs(spark, str(tmp_path))
    assert {r["task_id"] for r in rows.where("task_id IS NOT NULL").collect()} == {"t1", "t2"}
    (tmp_path / "w.json").write_text(json.dumps({"tasks": [one, one]}))
    assert pairs.read_wrapped(spark, f"{tmp_path}/w.json").count() == 2
    sinks.write_split(spark.createDataFrame([("b", "train"), ("a", "train"), ("c", "val")], "task_id string, split string"), f"{tmp_path}/s")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/s/train").collect()] == ['{"task_id":"a"}', '{"task_id":"b"}']
    graph = spark.createDataFrame([("a", "X", 1), ("a", "X", 2)], "name string, type string, at int")
    once = sinks.merge_graph(None, graph, ["name", "type"], "at")
    assert sinks.merge_graph(once, graph, ["name", "type"], "at").collect() == once.collect()


def test_first_ranks_are_those_of_a_ranking_of_all(spark):
    from ledgerloom.operators.ranks import ranked

    rows = spark.range(3000).select("id", (F.col("id") % 2).alias("g"))
    digest, most = F.md5(F.col("id").cast("string")), F.when(F.col("g") == 0, 7).otherwise(400)
    told = lambda df: sorted((r["g"], r["_rank"], r["_n"], r["id"]) for r in df.where(F.col("_rank") <= most).collect())
    some = ranked(rows, ["g"], digest, "id", upto=most)
    assert told(some) == told(ranked(rows, ["g"], digest, "id")) and len(told(some)) == 407 and some.count() < 1000
