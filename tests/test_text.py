import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import hashing
from ledgerloom.functions import text as T
from ledgerloom.operators import evidence, repair


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word,stem", [("fees", "fees"), ("parties", "party"), ("booking", "book"), ("matched", "match"), ("added", "adde"), ("charges", "charg"), ("amounts", "amount")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem(F.col("w")), w=word) == stem


def test_names_and_shingles(spark):
    assert one(spark, T.split_name(F.col("x")), x="MTMessage103Type") == "MT Message 103 Type"
    assert sorted(one(spark, T.char_shingles(F.col("x"), 3), x="abcab")) == ["abc", "bca", "cab"]
    assert one(spark, T.char_shingles(F.col("x"), 5), x="abc") == ["abc"]


def test_universal_hash_is_exact(spark):
    a, b = hashing.MERSENNE_61 - 2, 12345
    x = int.from_bytes(__import__("hashlib").md5(b"q").digest()[:8], "big")
    assert int(one(spark, hashing.md5_64(F.col("q")), q="q")) == x
    assert int(one(spark, hashing.universal(hashing.md5_64(F.col("q")), a, b), q="q")) == (a * x + b) % hashing.MERSENNE_61


@pytest.mark.parametrize(
    "text,found",
    [('```json\n{"a": 1}\n```', '{"a": 1}'), ('{broken} then {"a": {"b": 2}} end', '{"a": {"b": 2}}'), ('{"a": {"b": "c', '{"a": {"b": "c"}}'), ("none", None), (None, None)],
)
def test_repair(text, found):
    assert repair.balanced(text) == found


def plain_chunks(text, tokens, overlap):
    """The rule, step by step over a string."""
    size, back = tokens * 4, overlap * 4
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while True:
        end = min(at + size, len(text))
        border = max(text.rfind("\n\n", at, end), text.rfind(". ", at, end))
        if end < len(text) and border > at + 0.25 * len(text):
            end = border + 1
        out.append(text[at:end])
        if end >= len(text):
            return out
        at = max(end - back, at + size - back if size > back else end)


def test_chunks_equal_the_rule_step_by_step(spark):
    import random

    from ledgerloom.functions.chunks import chunked

    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "é", "😀", ". ", "\n\n", "\n", " ", "word", "."]) for _ in range(rng.choice([0, 3, 30, 60, 120, 400]))) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "id int, text string")
    for tokens, overlap in ((8, 2), (8, 6), (8, 0), (5, 9), (200, 20)):
        got = {r["id"]: r["c"] for r in rows.select("id", chunked(F.col("text"), tokens, overlap).alias("c")).collect()}
        assert got.pop(999) == []
        assert got == {i: plain_chunks(t, tokens, overlap) for i, t in enumerate(texts)}, (tokens, overlap)
    plan = rows.select(chunked(F.col("text"), 8, 2))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_gate(spark):
    facts = evidence.facts_table(
        spark,
        [("BookedPayment", "Concept", "RESOLVED_BY", "LedgerEntry", "Concept", ["booked", "ledger"], 0.9, []), ("LatePayment", "Concept", "CONFLICTS_WITH", "ValueDate", "Concept", ["late payment"], 0.8, [])],
    )
    docs = spark.createDataFrame([(1, "A payment is booked in the ledger. Late payment breaks the value date."), (2, "Nothing here.")], "id long, text string")
    triples = evidence.extract(docs, facts, "id", "text")
    assert {(r["head"], r["evidence"]) for r in triples.collect()} == {("BookedPayment", "A payment is booked in the ledger."), ("LatePayment", "Late payment breaks the value date.")}
    held = triples.select(F.xxhash64("head").alias("id"), "head", "relation", "tail", "aliases")
    claims = spark.createDataFrame([(1, "booked payment resolved by ledger entry"), (2, "latepayment keeps value date"), (3, "weather tomorrow"), (4, "difference between latepayment and value date")], "c long, text string")
    got = {r["claim"]: r["verdict"] for r in evidence.gate(claims, "c", "text", held).collect()}
    assert got[1] == "SUPPORT" and got[2] == "CONTRADICT" and got[3] == "SILENT" and got[4] != "CONTRADICT"
