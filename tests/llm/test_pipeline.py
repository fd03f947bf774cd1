"""The corpus pipeline on a small table, stage by stage."""

import random

import corpus_pipeline
import numpy as np
from ledgerloom.llm import scratch


def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        docs = scratch.stage(step(spark, docs, sf_dir), f"test-{name}").df
        out.append(docs)
    return out


def test_stages(spark, sf_dir):
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named, near, cut, mixed, packed = stages(spark, sf_dir)
    for d in (named, near, cut, mixed):
        assert d.columns == first.columns
    assert named.count() == first.where("text <> ''").count()
    assert 0 < near.count() < named.count() and near.select("text").distinct().count() == near.count()
    assert cut.count() == near.count()
    seen: set = set()
    for r in sorted(cut.collect(), key=lambda r: r["doc_id"]):
        mine = {r["text"][i : i + 110] for i in range(len(r["text"]) - 109)}
        assert r["n_chars"] == len(r["text"]) and not mine & seen
        seen |= mine
    words = lambda d: {r["source"]: r["w"] for r in d.selectExpr("source", "size(split(trim(text), '\\\\s+')) w").groupBy("source").sum("w").withColumnRenamed("sum(w)", "w").collect()}
    got = words(mixed)
    assert len(got) > 10 and np.std(list(got.values())) > 0
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_awkward_rows(spark):
    text = "the cat and the dog are with a bird in the house of the old man " * 4
    rows = [(1, text, "en", "a", len(text)), (1, text, "en", "a", len(text)), (2, text, "en", "b", None), (3, None, None, None, None), (4, "", "en", "a", 0), (None, text + "more", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, step in corpus_pipeline.STAGES:
        docs = scratch.stage(step(spark, docs, ""), f"awkward-{name}").df
    assert docs.count() > 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, step in corpus_pipeline.STAGES:
        empty = scratch.stage(step(spark, empty, ""), f"empty-{name}").df
    assert empty.count() == 0


def test_extra_columns_of_any_name_and_type_are_carried_along(spark):
    """Columns named as the stages' own, in either case of letters, and maps come out as they went in."""
    names = ["copy", "first", "md5", "copies", "nth", "kept", "rows", "n_bytes", "key", "__row", "__Copy", "__kept_", "node", "minima", "bucket", "size", "a.b"]
    text = "the cat and the dog are with a bird in the house of the old man and the sea near the town "
    word = lambda i: " ".join(f"{w}{i}" for w in text.split())
    rows = [(i, (text + word(i)) if i < 8 else word(i) + " " + text * 2, "en", "ab"[i % 2], {"k": i}, *[f"{n} {i}" for n in names]) for i in range(12)] + [(20, text, "en", "a", None, *[None] * len(names))] * 2
    schema = "doc_id long, text string, lang string, source string, m map<string,int>, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = scratch.stage(step(spark, docs, ""), f"clash-{name}").df
        assert docs.columns == ["doc_id", "text", "lang", "source", "m", *names], name
        got = docs.collect()
        assert got, name
        for r in got:
            was = before[r["doc_id"]]
            assert tuple(r)[2:] == tuple(was)[2:], name
            if name != "suffix_array_dedup":
                assert r["text"] == was["text"]
    assert corpus_pipeline.packed(spark, docs, "").count() >= docs.count()


def test_equal_rows_are_mixed_as_often_as_all_of_them(spark):
    rows = [(1, "w " * 10, "a")] * 40 + [(i, "w " * 30, "b") for i in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got: dict = {}
    for r in corpus_pipeline.source_mix(spark, docs, "").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    # 700 words go 1 : 2, that is 233.3 words in texts of 10 and 466.7 in texts of 30
    assert got.pop(1) in (23, 24) and sum(got.values()) in (15, 16) and set(got.values()) == {1, 2}


def test_near_duplicates_go_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (9, a), (None, a), (None, c), (None, c), (7, c + " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == [(3, b), (5, a), (7, c + " ")]
    unlike = spark.createDataFrame([(5, " ".join(f"{x}{i}" for i in range(60))) for x in "abcdefgh"], docs.schema)
    assert corpus_pipeline.near_duplicates(spark, unlike, "").count() == 8


def test_near_copies_against_brute_force(spark):
    rng, texts = random.Random(1), []
    for g in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        for edits in (0, 1, 2, 4, 30) if g else [2] * 60:
            copy = list(base)
            for i in rng.sample(range(200), edits):
                copy[i] = f"w{rng.randrange(3000)}"
            texts.append(copy)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and len(a & b) >= 0.8 * len(a | b):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert len(set(group)) < 100 and kept == set(group)


def brute_groups(sets):
    """The least index of each text's group, by an inverted index and union-find."""
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if top(i) != top(j) and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(sets))]


def test_a_crowd_of_copies_of_copies(spark):
    """900 copies of one text with up to 3 edits, most of them unlike each other, chains that leave it, and texts that no copy is like."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(9000)}"
    edited = lambda words, n: [word() if i in at else w for at in [set(rng.sample(range(len(words)), n))] for i, w in enumerate(words)]
    base = [word() for _ in range(180)]
    texts = [edited(base, rng.randint(1, 3)) for _ in range(900)] + [base]
    for _ in range(25):
        chain = edited(base, 3)
        for _ in range(4):
            chain = edited(chain, 3)
            texts.append(chain)
    texts += [edited(base, 60) for _ in range(20)] + [[word() for _ in range(180)] for _ in range(30)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    want = set(brute_groups(sets))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert len(want) < 100 and kept >= want and len(kept - want) <= 1


def test_near_copies_are_looked_for_by_simhash(spark):
    """Nodes of equal fingerprints, and of fingerprints within three bits, come to the exact check as pairs."""
    from ledgerloom.llm import nearcopies

    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 0b111), (5, (1 << 40) - 1)], "node long, fp long")
    assert sorted(map(tuple, nearcopies.simhash_pairs(nodes).select("a", "b").collect())) == [(1, 2), (1, 3), (1, 4)]
