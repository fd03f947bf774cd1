"""Rules over texts by one automaton, and extractions kept by content."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import contamination, evidence, triggers
from ledgerloom.sources import extractions

PARTS = ["mt103", "mt", "103", "iban", "a.b", "t2s", "#x", "late", "payment", "pay", "ment", " ", ", ", "-", ".", "é", "_", "#", "\n"]


def made_rules(rng, n):
    term = lambda: "".join(rng.choice(PARTS[:11] + [" "]) for _ in range(rng.randint(1, 3))).strip() or "pay"
    return [[term() for _ in range(rng.randint(1, 3))] for _ in range(n)]


def test_automaton_equals_each_term_looked_up_alone(spark):
    rng = random.Random(6)
    rules = made_rules(rng, 300) + [[], [""], ["pay", ""], ["pay", None], None, ["[", "("], ["é"], ["\\e"], ["late payment"]]
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["", None, "pay", "pay.", ".pay", "late payments [(]", "\\E"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    held = spark.createDataFrame([(i, r) for i, r in enumerate(rules)], "rule int, terms array<string>")
    lower = docs.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    there = F.forall("terms", lambda x: T.has_term(F.col("t"), T.padded(F.col("t")), F.lower(x)))
    want = {tuple(r) for r in lower.crossJoin(held).where(there).select("id", "rule").collect()}
    got = lower.select("id", F.explode(triggers.holding(F.col("t"), rules)).alias("rule"))
    kept = {tuple(r) for r in got.collect()}
    assert kept == want and len(want) > 300


def test_ten_thousand_rules_meet_texts_without_a_nested_loop(spark):
    rng = random.Random(1)
    rules = [(f"H{i}", "Rule", "COVERS", f"T{i}", "Rule", [f"word{i}", rng.choice(["alpha", "beta"])], 0.5, []) for i in range(10_000)]
    docs = spark.createDataFrame([(d, " ".join(["alpha"] * (d % 2) + ["Beta"] + [f"word{rng.randrange(10_000)}" for _ in range(200)])) for d in range(50)], "id long, text string")
    found = evidence.extract(docs, evidence.facts_table(spark, rules), "id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    need = {r[0]: r[5] for r in rules}
    got = {(r["source"], r["head"]) for r in found.collect()}
    words = {r["id"]: set(r["text"].lower().split()) for r in docs.collect()}
    want = {(d, f"H{w[4:]}") for d, ws in words.items() for w in ws if w.startswith("word") and set(need[f"H{w[4:]}"]) <= ws}
    assert got == want and len(want) > 1000


def test_every_message_type_is_looked_for(spark):
    """Far more types than a thousand; none is left out."""
    fields = spark.createDataFrame([(f"TYPE{i:05d}", "20", "Reference") for i in range(3000)], "message_type string, tag string, label string")
    docs = spark.createDataFrame([(1, "a type00007 and a TYPE02999."), (2, "xtype00007")], "id long, text string")
    assert {(r["source"], r["head"]) for r in evidence.message_fields(docs, fields, "id", "text").collect()} == {(1, "TYPE00007"), (1, "TYPE02999")}


@pytest.fixture
def counted():
    seen = []

    def extract(docs):
        rows = docs.select("source", F.explode(F.split("text", " ")).alias("word"))
        seen.append(docs.count())
        return rows.where("word <> ''")

    return extract, seen


def test_a_changed_document_is_extracted_alone(spark, tmp_path, counted):
    extract, seen = counted
    docs = [(f"d{i}", f"a{i} b{i}") for i in range(20)] + [("none", ""), ("null", None)]
    table = lambda rows: spark.createDataFrame(rows, "source string, text string")
    fresh = lambda rows: sorted((s, w) for s, t in set(rows) for w in (t or "").split())
    refresh = lambda rows: sorted(tuple(r) for r in extractions.refresh(table(rows), str(tmp_path), extract).select("source", "word").collect())
    assert refresh(docs + docs[:3]) == fresh(docs)
    changed = [("d4", "x y z") if s == "d4" else (s, t) for s, t in docs]
    assert refresh(changed) == fresh(changed)
    assert refresh(changed[:10]) == fresh(changed[:10])
    assert refresh(docs) == fresh(docs)
    assert refresh(docs) == fresh(docs) == sorted(tuple(r) for r in extractions.read(spark, str(tmp_path)).select("source", "word").collect())
    assert seen == [22, 1, 0, 0, 0]  # d4's first text is still there
    assert {r["change"]: r["n"] for r in extractions.changes(spark, str(tmp_path), 4).collect()} == {"revived": 13, "dropped": 1}
    renamed = [("e1", docs[1][1])] + docs
    assert refresh(renamed) == fresh(renamed) and seen[-1] == 1


def test_pruned_search_equals_all_sums_and_meets_fewer_rows(spark):
    """Long claims over texts with a few common words and many rare ones; some texts hold most of a claim."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    pick = lambda n: [rng.choice(words[: max(5, int(3000 * rng.random() ** 6))]) for _ in range(n)]
    claims = [(c, " ".join(pick(30) + ["the"])) for c in range(25)]
    docs = [(d, " ".join(pick(40) + ["the"] * 3 + (claims[d // 2 % 25][1].split()[:25] if d % 2 == 0 else []))) for d in range(800)]
    docs += [(900, ""), (901, None), (902, docs[0][1]), (903, docs[0][1])]
    asked, held = spark.createDataFrame(claims, "c long, text string"), spark.createDataFrame(docs, "d long, text string")
    index, idf = evidence.tfidf(held, "d", "text")
    raw = evidence.terms(asked, "c", "text").join(idf, "term").select(F.col("key").alias("claim"), "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = raw.groupBy("claim").agg(F.sqrt(F.sum(F.col("raw") ** 2)).alias("norm"))
    q = raw.join(norm, "claim").select("claim", "term", (F.col("raw") / F.col("norm")).alias("q"))
    sums = q.join(index, "term").groupBy("claim", "key").agg(F.round(F.sum(F.col("q") * F.col("weight")), 4).alias("score")).collect()
    want = {}
    for r in sorted(sums, key=lambda r: (r["claim"], -r["score"], r["key"])):
        want.setdefault(r["claim"], []).append((r["key"], r["score"]))
    got = {}
    for r in evidence.search(asked, "c", "text", held, "d", "text", k=8).orderBy("claim", "rank").collect():
        got.setdefault(r["claim"], []).append((r["key"], r["score"]))
    assert got == {c: rows[:8] for c, rows in want.items()}
    assert evidence.pruned(q, index, 8).count() < 0.65 * len(sums)
    few = evidence.search(asked.where("c = 1"), "c", "text", held.where("d < 4"), "d", "text", k=8)
    assert few.count() == 4 and evidence.search(asked.limit(0), "c", "text", held, "d", "text").count() == 0


def test_passages_are_found_word_for_word(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: rng.choice(["aa", "b", "ccc", "d.", "Éa", "x"])
    passages = [" ".join(word() for _ in range(n)) for n in (1, 2, 5, 8, 9, 9, 12, 20, 20)] + ["", "b", "a\nb  c"]
    texts = ["".join(rng.choice(passages + [" ", " zz ", "q"]) for _ in range(rng.randint(0, 6))) for _ in range(80)] + ["", None, passages[7] + "tail", "head" + passages[8]]
    items = spark.createDataFrame(list(enumerate(passages)) + [(99, None)], "i long, p string")
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    want = sorted((i, d) for i, p in enumerate(passages) for d, t in enumerate(texts) if t is not None and p in t)
    for few, listed in ((10_000, 200_000), (1, 1)):
        monkeypatch.setattr(contamination, "IN_PLACE", few)
        monkeypatch.setattr(contamination, "LISTED", listed)
        assert sorted(map(tuple, contamination.containments(items, "i", "p", docs, "d", "t").collect())) == want


def test_an_index_of_asked_terms_has_the_weights_of_the_whole_index(spark):
    held = spark.createDataFrame([(1, "pay late pay"), (2, "late iban"), (3, None)], "d int, t string")
    asked = spark.createDataFrame([("pay",), ("none",)], "term string")
    told = lambda index: sorted(map(tuple, index.select("key", "term", "weight").collect()))
    every, some = told(evidence.tfidf(held, "d", "t")[0]), told(evidence.tfidf(held, "d", "t", asked)[0])
    assert some == [r for r in every if r[1] == "pay"] and len(some) == 1


def test_claims_that_differ_in_what_no_triple_says_are_judged_once(spark):
    rows = [(1, "Rule", "REQUIRES", "Notice", ["mt103"]), (2, "Late", "CONFLICTS_WITH", "Date 20", [])]
    triples = spark.createDataFrame(rows, "id long, head string, relation string, tail string, aliases array<string>")
    texts = [f"Ledger message MT103 for {n}.50 USD with value date 1997-05-{d}" for n in range(100, 140) for d in (20, 23)] + ["nothing", ""]
    claims = spark.createDataFrame([(t,) for t in texts], "text string")
    form = claims.select("text", F.to_json(F.struct(evidence._forms(F.col("text"), evidence.said(triples)).alias("f"))).alias("form"))
    forms = {r["text"]: r["form"] for r in form.collect()}
    assert len(set(forms.values())) == 4
    judged = {r["claim"]: tuple(r)[1:] for r in evidence.gate(claims, "text", "text", triples).collect()}
    by_form: dict = {}
    for text, verdict in judged.items():
        by_form.setdefault(forms[text], set()).add(verdict)
    assert all(len(v) == 1 for v in by_form.values()) and len(judged) == len(texts)


def test_rules_meet_nulls_and_empty_texts(spark):
    rows = spark.createDataFrame([(0, "pay late"), (1, None), (2, "")], "id int, t string")
    got = rows.select("id", triggers.holding(F.col("t"), [["pay"], [], ["late", "pay"]]).alias("r"))
    assert {r["id"]: r["r"] for r in got.collect()} == {0: [0, 1, 2], 1: [1], 2: [1]}
