"""Each operator against brute force on small tables, and on tables with every awkward row."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import fingerprints, languages, licenses, mixing, packing, passages, quality, queries, sharding, simhash, topk

LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(30_000))
AWKWARD = [
    (1, "one two three four five six seven eight nine ten", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "   \n\t ", "fr", None),
    (5, LONG, "en", "b"),
    (6, LONG, "en", "b"),
    (6, LONG, "en", "b"),
    (7, "x", "en", "b"),
    (8, "é" * 40 + " ünïcode " * 12, "fr", "c"),
    (None, "a text without an id that is long enough to be cut by others, surely it is", "en", "a"),
    (9, "a text without an id that is long enough to be cut by others, surely it is", "en", "a"),
]
#: Columns that other tables may have and the operators use inside.
CLASHES = ["key", "id", "size", "copies", "at", "arc", "rank", "fp", "md5", "bucket", "block", "p", "length", "scores", "n", "shard", "label", "component"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    return rows.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


OPERATORS = {
    "op1": lambda d: sharding.assign_shards(d, 3),
    "op2": licenses.scan,
    "op3": passages.dedup_passages,
    "op4": fingerprints.edit_check,
    "op5": mixing.mix,
    "op6": simhash.simhash_components,
    "op7": lambda d: languages.identify(d, "doc_id", "text", declared="lang", host="source"),
    "op9": lambda d: quality.score(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality"))),
    "op10": lambda d: packing.pack(d, queries.vocabulary()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("op2", "op10")])
def test_every_awkward_row_has_a_result(awkward, name):
    assert OPERATORS[name](awkward).count() == len(AWKWARD)


def test_shards_differ_by_one_row(docs, texts, awkward):
    rows = sharding.assign_shards(docs, 24).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    assert sorted(by) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs.repartition(5), 24).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in rows}
    assert sum(r["size"] for r in sharding.assign_shards(awkward, 3).where("doc_id = 2").collect()) == 8


def test_a_new_shard_moves_few_rows(docs):
    before = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs, 8, slack=0.25).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs, 9, slack=0.25).collect()}
    moved = sum(before[k] != after[k] for k in before)
    assert moved <= 0.4 * len(before)


def test_ring_placement_equals_a_walk_over_single_rows(spark, monkeypatch):
    """Every key to the first place at or after its hash, clockwise past full shards, arc by arc and then round by round."""
    rows = spark.range(300).select((F.col("id") % 97).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 110).cast("string")).alias("text"))
    for slack in (0.0, 0.3):
        got = sharding.assign_shards(rows, 4, vnodes=8, slack=slack)
        places, owner = sharding._ring(rows, 4, 8)
        hashes = {r["doc_id"]: r["h"] for r in rows.select("doc_id", F.xxhash64(F.lit("key"), "doc_id").alias("h")).distinct().collect()}
        counts = [0] * 32
        for r in rows.collect():
            counts[next((i for i, p in enumerate(places) if p >= hashes[r["doc_id"]]), 0)] += 1
        total = int(300 * (1 + slack))
        room = [total // 4 + (s < total % 4) for s in range(4)]
        want, waiting = {}, {i: (i, c) for i, c in enumerate(counts) if c}
        while waiting:
            step = {i: next((at + k) % 32 for k in range(32) if room[owner[(at + k) % 32]] > 0) for i, (at, _) in waiting.items()}
            for i in sorted(waiting, key=lambda i: (waiting[i][0] - i) % 32):
                at, c = step[i], waiting[i][1]
                some = min(c, room[owner[at]])
                room[owner[at]] -= some
                want[i, owner[at]] = want.get((i, owner[at]), 0) + some
                waiting[i] = ((at + 1) % 32, c - some)
                if c == some:
                    del waiting[i]
        found: dict = {}
        for r in got.collect():
            arc = next((i for i, p in enumerate(places) if p >= hashes[r["doc_id"]]), 0)
            found[arc, r["shard"]] = found.get((arc, r["shard"]), 0) + 1
        assert found == {k: n for k, n in want.items() if n}
    monkeypatch.setattr(sharding, "ARC_ROWS", 3)
    slots = [(r["shard"], r["slot"]) for r in sharding.assign_shards(rows, 4, vnodes=8).collect()]
    assert len(set(slots)) == 300 and max(s for _, s in slots) == 74


def test_one_row_many_times(spark):
    """A row that is most of the table stays one range or one unit until it is written, in many tasks."""
    n = 200_000
    rows = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit("some words of a text").alias("text"), F.lit("a").alias("source")).union(spark.range(1000).select("id", F.lit("x y"), F.lit("b")))
    placed = sharding.assign_shards(rows, 5)
    sizes = {r["shard"]: (r["n"], r["top"], r["d"]) for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("top"), F.count_distinct("slot").alias("d")).collect()}
    assert len(sizes) == 5 and all(x == d == top + 1 == (n + 1000) // 5 for x, top, d in sizes.values())
    mixed = mixing.mix(rows).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()
    by = {r["source"]: r for r in mixed}
    assert by["a"]["n"] == n and abs(by["a"]["taken"] - by["a"]["target"]) <= 5 and by["a"]["most"] - by["a"]["least"] <= 1
    assert by["b"]["n"] == 1000 and by["b"]["taken"] == by["b"]["target"] == 6000


def test_fusion_equals_plain_bayes(spark):
    rng = np.random.default_rng(4)
    names = ["de", "en", "und"]
    rows = []
    for i in range(60):
        scores = [float(x) for x in rng.normal(0, 3, 3)]
        host = ["a.b.org", "c.b.org", "d.net", "plain", None][int(rng.integers(0, 5))]
        dotted = host is not None and "." in host
        n = int(rng.integers(0, 6))
        rows.append((i, [None, "en", "de", "xx"][int(rng.integers(0, 4))], host, ".".join(host.split(".")[-2:]) if dotted else None, host.split(".")[-1] if dotted else None, n, scores, scores.index(max(scores)) if n else None))
    table = spark.createDataFrame(rows, "key int, declared string, host string, domain string, suffix string, n_grams long, scores array<double>, best int")
    got = {r["key"]: r for r in languages.fuse(table, names).collect()}
    overall = [sum(r[7] == i for r in rows) for i in range(3)]
    base = [(x + 1) / (sum(overall) + 3) for x in overall]
    count = lambda place, value: [sum(r[place] == value and r[7] == i for r in rows) for i in range(3)]
    for key, declared, host, domain, suffix, n, scores, best in rows:
        own = [float(best == i) for i in range(3)]
        towards = base
        for place, value in ((3, domain), (2, host)):
            c = [max(0.0, x - o) for x, o in zip(count(place, value), own)] if value is not None else [0.0] * 3
            towards = [(x + 5 * t) / (sum(c) + 5) for x, t in zip(c, towards)]
        z = [s + np.log(max(t, 1e-9)) for s, t in zip(scores, towards)]
        for place, value in ((1, declared), (4, suffix)):
            if value is not None:
                z = [x + np.log((c + 0.5) / (o + 2.0)) for x, c, o in zip(z, count(place, value), overall)]
        p = np.exp(np.array(z) - max(z))
        p /= p.sum()
        top = int(p.argmax())
        assert got[key]["language"] == names[top] and got[key]["confidence"] == pytest.approx(p[top])
        assert got[key]["accepted"] == bool(names[top] != "und" and p[top] >= 0.5 and n > 0)


def test_rare_languages_share_a_model_and_keep_their_names(docs):
    """With two models for four languages the others are named by what they declare, and nothing of them is lost."""
    found = languages.identify(docs, "doc_id", "text", declared="lang", host="source", most=2).join(docs.select("doc_id", "lang", "text"), "doc_id").where("length(text) > 200")
    n = found.count()
    assert found.where("accepted").count() >= 0.97 * n
    assert found.where("language = lang").count() >= 0.9 * n
    undeclared = languages.identify(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), "doc_id", "text", declared="lang", most=2)
    assert {"mis"} <= {r["language"] for r in undeclared.where("doc_id % 2 = 1").select("language").distinct().collect()}


def test_licenses(spark):
    rows = [(1, "Some words. Released under the MIT License. And more."), (2, "Licensed  under the APACHE license, version 2.0"), (3, "nothing of the kind here at all"), (4, licenses.TEMPLATES["BSD"].replace("binary", "object")), (5, "ends so. all RIGHTS reserved"), (6, "// spdx-license-identifier: mit"), (7, "all rights are reserved")]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), least=0.7).collect()}
    assert got == {(1, "MIT"), (2, "Apache-2.0"), (4, "BSD"), (5, "All-rights-reserved"), (6, "SPDX-MIT")}


def brute_licenses(text, templates, least=0.8):
    """The best share of a template's shingles in any stretch a quarter longer than it, over all stretches."""
    w = re.findall(r"[a-z0-9]+", (text or "").lower())
    out = {}
    for name, t in templates.items():
        tw = re.findall(r"[a-z0-9]+", t.lower())
        size = min(5, len(tw))
        gram = lambda x, i: tuple(x[i : i + size])  # noqa: E731, B023
        want = {gram(tw, i) for i in range(len(tw) - size + 1)}
        n = len(tw) - size + 1
        mine = [gram(w, i) for i in range(len(w) - size + 1)]
        best = max((len(want & set(mine[i : i + n + n // 4])) / len(want) for i in range(len(mine))), default=0.0)
        if best >= least:
            out[name] = round(best, 6)
    return out


def test_licenses_equal_brute_force_on_edited_notices(spark):
    rng = np.random.default_rng(3)
    names, texts = sorted(licenses.TEMPLATES), []
    for k in range(120):
        words = re.findall(r"\S+", licenses.TEMPLATES[names[k % len(names)]])
        for _ in range(rng.integers(0, 2 + len(words) // 20)):
            at = int(rng.integers(0, len(words)))
            words[at : at + 1] = [[], ["new", "words"], ["other"]][rng.integers(0, 3)]
        around = lambda: [f"w{x}" for x in rng.integers(0, 400, rng.integers(0, 60))]
        texts.append(" ".join(around() + words + around()))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got: dict = {}
    for r in licenses.scan(rows).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = round(r["containment"], 6)
    want = {i: f for i, t in enumerate(texts) if (f := brute_licenses(t, licenses.TEMPLATES))}
    assert got == want and len(want) > 60


def test_licenses_in_awkward_rows(awkward, spark):
    notice = licenses.TEMPLATES["MIT"]
    rows = awkward.where("doc_id in (2, 3, 4, 7)").unionByName(awkward.where("doc_id = 5 OR doc_id IS NULL").withColumn("text", F.concat("text", F.lit(" " + notice))))
    rows = rows.unionByName(rows.where("doc_id = 5"))
    got = sorted((str(r["doc_id"]), r["license"], r["containment"], r["end_word"] - r["first_word"]) for r in licenses.scan(rows).collect())
    assert got == [("5", "MIT", 1.0, 5), ("5", "MIT", 1.0, 5), ("None", "MIT", 1.0, 5)]


def brute_passages(texts: dict) -> dict:
    seen, out = set(), {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        gone, mine = np.zeros(len(b), bool), [b[i : i + 50] for i in range(len(b) - 49)]
        for i, w in enumerate(mine):
            if w in seen:
                gone[i : i + 50] = True
        seen.update(mine)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[k] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_passages_equal_brute_force(docs, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in passages.dedup_passages(docs).collect()}
    assert got == brute_passages(texts)


def test_passages_with_shared_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 5))
    shared = [" ".join(word() for _ in range(n)) for n in (9, 10, 12, 40)]
    texts = {}
    for k in range(60):
        parts = [" ".join(word() for _ in range(rng.integers(0, 12))) for _ in range(4)]
        for _ in range(rng.integers(0, 4)):
            parts.insert(int(rng.integers(0, 4)), shared[rng.integers(0, 4)])
        texts[k] = "".join(parts) if k % 3 else " ".join(parts)
    texts[60], texts[61], texts[62] = "ab" * 100, "ba" * 90, "a" * 300
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_passages(texts)
    assert {r["doc_id"]: tuple(r)[1:] for r in passages.dedup_passages(rows).collect()} == want
    # owners that several buckets have are hot at once: each of their strings is settled by itself
    for bucket, hot in ((3000, 1), (400, 3), (3000, 0)):
        monkeypatch.setattr(passages, "BUCKET", bucket)
        cut = passages.cut_passages(rows, hot=hot).select("first", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert {r["first"]: tuple(r)[1:] for r in cut} == {k: want[k] for k in (r["first"] for r in cut)}


def test_owners_in_stretches_are_those_of_the_whole():
    rng = np.random.default_rng(6)
    body = rng.integers(97, 101, 9000).astype(np.uint8)
    offsets = np.array([0, 40, 4000, 4000, 9000])
    strings = lambda found: {(int(r), s): int(h) for h, r, a, b, _, _ in zip(*found) for s in range(a, b + 1)}
    whole = strings(passages.owners(body, offsets))
    assert whole == strings(passages.owners(body, offsets, stretch=333)) and len(whole) == 3960 - 49 + 5000 - 49
    single = passages.owners(body, offsets, lambda h: h % np.uint64(2) == 0)
    assert set(strings(single)) == set(whole) and len(single[0]) > len(passages.owners(body, offsets)[0])


def test_fingerprints(docs, texts, awkward):
    rows = {r["doc_id"]: r for r in fingerprints.edit_check(docs).collect()}
    ids = sorted(texts)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        k = len(texts[a]) // 4
        edited = texts[a][: len(texts[a]) - k] + texts[b][:k]
        assert rows[a]["n_chars"] == len(texts[a]) and rows[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    near, far = np.median([r["near_edited"] for r in rows.values()]), np.median([r["near_next"] for r in rows.values()])
    assert near > 0.4 and far < 0.1
    prints: dict = {}
    for i in ids:
        prints.setdefault(texts[i], set()).add(rows[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    own = {r["doc_id"]: r for r in fingerprints.edit_check(awkward.where("doc_id = 5")).collect()}
    assert own[5]["near_next"] == 1.0


def brute_sketch(b: bytes) -> tuple[list[int], list[int]]:
    """Places of the closed syncmers and the fingerprint's hashes, from the definition."""
    h = lambda x: xxhash.xxh64_intdigest(x, 42) & 0xFFFFFFFF
    at = []
    for i in range(len(b) - 11):
        inner = [h(b[i + j : i + j + 5]) for j in range(8)]
        if min(inner) in (inner[0], inner[-1]):
            at.append(i)
    if len(b) >= 24:
        hashes = {h(b[i : i + 12]) for i in at}
    else:
        hashes = {h(b[i : i + 4]) for i in range(len(b) - 3)} if len(b) >= 4 else {h(b)} if b else set()
    return at, sorted(hashes)[:48]


def test_fingerprints_are_closed_syncmers_by_definition(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9)))
    passage = " ".join(word() for _ in range(40))
    texts = ["", "ab", "abcdefg", "x" * 23, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "é" * 30, passage, word() + passage, " ".join(word() for _ in range(300)) + passage + word()]
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.edit_check(rows).collect()}
    for i, t in enumerate(texts):
        assert got[i] == "".join(f"{h:08x}" for h in brute_sketch(t.encode())[1]), t[:30]
    assert got[99] == ""
    places: dict = {}
    for r in fingerprints.anchors(rows).collect():
        places.setdefault(r["doc_id"], []).append(r["at"])
    assert {i: sorted(p) for i, p in places.items()} == {i: p for i, t in enumerate(texts) if (p := brute_sketch(t.encode())[0])}
    # a passage has the same anchors wherever it stands
    begin = texts[8].encode().index(passage.encode())
    assert [a - begin for a in sorted(places[8]) if begin <= a <= begin + len(passage) - 12] == sorted(places[6])


def test_merged_edited_fingerprint_is_that_of_the_edited_text(spark, docs, texts):
    rows = fingerprints.edit_check(docs).select("doc_id", "edited_fingerprint").collect()
    ids = sorted(texts)
    edited = []
    for a, b in zip(ids, ids[1:] + ids[:1]):
        k = len(texts[a]) // 4
        edited.append((a, texts[a][: len(texts[a]) - k] + texts[b][:k]))
    table = spark.createDataFrame(edited, "doc_id long, text string")
    direct = {r["doc_id"]: r["fingerprint"] for r in fingerprints.edit_check(table).select("doc_id", "fingerprint").collect()}
    assert {r["doc_id"]: r["edited_fingerprint"] for r in rows} == direct


def test_mix(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), ["b", "a", None, "c"][min(3, int(rng.integers(0, 8)))]) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(table).collect()
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(table.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in got}
    by: dict = {}
    for r in got:
        s = by.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        s[2] += r["size"] * r["copies"]
        s[3] = max(s[3], r["size"])
        assert 0 <= r["copies"] <= 3 and r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", dict((a, b) for a, b, _ in rows)[r["doc_id"]]))
    total = sum(s[0] for s in by.values())
    weights = dict(zip(["a", "b", "c", None], [1, 2, 3, 1]))
    want = dict.fromkeys(by, 0.0)
    open_, left = set(by), float(total)
    while open_:
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * by[s][0]}
        if not over:
            want.update(share)
            break
        for s in over:
            want[s] = 3.0 * by[s][0]
            left -= want[s]
        open_ -= over
    for s, (_, target, taken, largest) in by.items():
        assert target == pytest.approx(want[s]) and abs(taken - target) <= largest


def test_simhash_equals_brute_force(docs, texts):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

    def fp(t):
        w = t.encode().translate(lower).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    ids = sorted(texts)
    points = np.array([fp(texts[i]) for i in ids], np.uint64)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    comp, old = np.array(ids), None
    while old is None or (comp != old).any():
        old = comp
        comp = np.array([comp[row].min() for row in near])
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component"]) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (int(p), int(c)) for i, p, c in zip(ids, points, comp)}


def test_the_tree_of_a_shard_finds_all_pairs():
    """Beyond a leaf's size the vantage-point tree decides: all pairs within the radius, most distances never taken."""
    rng = np.random.default_rng(12)
    centres = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    points = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 63, 60).astype(np.uint64)) for c in centres]))
    rng.shuffle(points)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    want = {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
    got = {(min(a, b), max(a, b)) for x, y in simhash.near_pairs(points, 3) for a, b in zip(x.tolist(), y.tolist())}
    assert got == want and len(points) > 10 * simhash._LEAF


def test_crowded_shards_lose_no_link(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 62, 6)
    points = {int(b) ^ (1 << int(x)) ^ (1 << int(y)) ^ (1 << int(z)) for b in base for x, y, z in rng.integers(0, 62, (60, 3))}
    table = spark.createDataFrame([(p,) for p in points], "fp long")
    from ledgerloom.llm.components import components

    plain = {r["node"]: r["component"] for r in components(simhash.near_links(table)).collect()}
    split = {r["node"]: r["component"] for r in components(simhash.near_links(table, shard_rows=8)).collect()}
    assert plain == split and len(plain) > 50


def test_languages(docs, spark):
    got = languages.identify(docs, "doc_id", "text", declared="lang", host="source").join(docs.select("doc_id", "lang"), "doc_id")
    n = got.count()
    assert got.where("accepted AND language = lang").count() >= 0.97 * n
    nothing = languages.identify(docs.withColumn("text", F.lit("12 34 +++ 56")), "doc_id", "text", declared="lang", host="source")
    assert nothing.where("accepted").count() == 0


def test_language_of_pages(spark, sf_dir):
    pages = languages.page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    got = languages.identify(pages, "page_id", "text", declared="declared", host="url").join(pages, "page_id")
    assert got.where("language = declared").count() >= 0.9 * got.count()


def test_quality_on_held_out_labels(spark):
    rows = queries.op9_factorization_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    held = rows.where("held_out").join(labels, "doc_id")
    assert held.where("predicted = quality").count() >= 0.9 * held.count()
    assert rows.where("score < 0 OR score > 1").count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    ids, x = rng.integers(0, quality.SIZE, 12), rng.normal(size=12)
    model = {"w0": 0.3, "w": rng.normal(size=quality.SIZE), "v": rng.normal(size=(quality.SIZE, quality.FACTORS))}
    z, _ = quality.raw_scores(model, np.zeros(12, int), ids, x, 1)
    pairs = sum(model["v"][ids[i]] @ model["v"][ids[j]] * x[i] * x[j] for i in range(12) for j in range(i))
    assert z[0] == pytest.approx(0.3 + model["w"][ids] @ x + pairs)


def test_search_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x, ids = np.floor(256 * np.array([r["embedding"] for r in rows], float)).astype(int), np.array([r["vec_id"] for r in rows])
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        want += [(ids[i], k + 1, ids[j], s[j]) for k, j in enumerate([j for j in np.lexsort((ids, -s)) if j != i][:5])]
    assert sorted(map(tuple, queries.op8_ball_tree_topk(spark, sf_dir).collect())) == sorted(want)


def test_search_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.ORACLES['op8_ball_tree_topk']})").fetchall()
    assert sorted(map(tuple, queries.op8_ball_tree_topk(spark, sf_dir).collect())) == sorted(want) and want


def brute_search(rows, k=5):
    """Query rows by id % 50, candidates all other rows of the same length; rows are (id or None, vector)."""
    q = [(i, v, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, _, x) in enumerate(q):
        if i is not None and i % 50 == 0:
            found = sorted((-int(x @ y), j is None, j) for b, (j, _, y) in enumerate(q) if a != b and len(x) == len(y))[:k]
            out += [(i, n + 1, j, -s) for n, (s, _, j) in enumerate(found)]
    return sorted(out, key=str)


def test_search_over_many_shards(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 6))
    x[50:120] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (300, [float("nan")] * 6), (350, [])]
    rows += [(0, x[7].tolist()), (0, x[7].tolist()), (5, x[9].tolist()), (None, x[3].tolist()), (400, [1.0, 2.0]), (401, [3.0, 1.0]), (450, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit("x").alias("row"), F.lit(1).alias("shard"), F.lit(1).alias("v"))
    for sizes in ({}, {"shard_bytes": 40 * 48, "block_bytes": 3 * 48, "leaf": 4}):
        got = topk.top_k(table, F.col("vec_id") % 50 == 0, **sizes).collect()
        assert sorted(map(tuple, got), key=str) == brute_search(rows)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_scores_beyond_doubles_are_exact_and_beyond_longs_null(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(1e6 + int(c)) for c in rng.integers(0, 4, 6)]) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 50 == 0).collect()), key=str) == brute_search(rows)
    con = duckdb.connect()
    held = table.toPandas()  # noqa: F841
    con.execute("CREATE TABLE embeddings AS SELECT vec_id, embedding FROM held")
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.ORACLES['op8_ball_tree_topk']})").fetchall()
    assert sorted(want) == sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 50 == 0).collect()))
    huge = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [1e12, 3.0]), (3, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 2, None), (0, 2, 1, None), (0, 3, 3, None)]


def test_a_hot_id_is_one_row_of_the_fit(spark, monkeypatch):
    """400 ids, one of them on 20,000 rows: the fit takes 400 rows, and the same ones in any order of the table."""
    rows = spark.range(20_399).select(F.when(F.col("id") < 399, F.col("id")).otherwise(399).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    was = quality._trained
    seen = spark.sparkContext.accumulator(0)

    def trained(sample):
        seen.add(len(sample))
        return was(sample)

    monkeypatch.setattr(quality, "_trained", trained)
    one, two = (quality.train(t, labels, 400, "doc_id", "text", "n_chars", "quality") for t in (rows, rows.repartition(7)))
    assert seen.value == 800 and sorted(one) == sorted(two) and one["w0"] == pytest.approx(two["w0"], abs=0.2)


def test_inner_nodes_prune():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.05, (256, 8)) * 256 for c in rng.normal(0, 4, (16, 8))])
    q = np.floor(x[::64])
    search = topk.Search(np.floor(x), np.arange(len(x)), q, np.full(len(q), -1), np.full(len(q), -np.inf), 5, leaf=32)
    search.run()
    assert search.opened < 0.5 * len(q) * len(search.tree.leaves)
    score = q @ np.floor(x).T
    for j in range(len(q)):
        assert sorted(search.best_s[j]) == sorted(np.sort(score[j])[-5:])


def test_pack_round_trip(docs, texts, awkward):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.vocabulary())
    for table, held in ((docs, texts), (awkward, None)):
        rows = packing.pack(table, queries.vocabulary(), capacity=512).collect()
        by: dict = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 512
        bins: list = []
        for length in sorted((r["length"] for r in rows), reverse=True):  # first fit, longest first
            at = next((i for i, room in enumerate(bins) if room >= length), None)
            if at is None:
                bins.append(512 - length)
            else:
                bins[at] -= length
        assert -(-sum(r["length"] for r in rows) // 512) <= len(by) <= len(bins)
        if held:
            for k, t in held.items():
                ids = whole.encode(t, add_special_tokens=False).ids + [0]
                mine = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece"])
                assert [r["start"] for r in mine] == list(range(0, len(ids), 512)) and sum(r["length"] for r in mine) == len(ids)
                for r in mine:
                    part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
                    assert zlib.crc32(part) == r["ids_crc32"]
