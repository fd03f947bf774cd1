"""Whitening, encoding and fill-in-the-middle against plain versions, on the small tables and on awkward ones."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, middles, queries, whitening

from .test_operators import AWKWARD, CLASHES

VOCABULARY = queries.vocabulary()
sha = lambda data: hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def awkward(spark):
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    return rows.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHES if c not in ("n", "size")], F.lit("c").alias("form"), F.lit("c").alias("ids"), F.lit("c").alias("made"))


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# --- 11 ---------------------------------------------------------------------------------------------------------


def plain_whitening(vectors: dict, k: int = 8) -> dict:
    """key: (deviation, whitened up to sign, explained), in one matrix, with exact integers."""
    keys, x = list(vectors), np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors.values()])
    n, sums = len(x), [int(s) for s in x.astype(object).sum(axis=0)]
    d = [[n * int(v) - s for v, s in zip(row, sums)] for row in x.tolist()]
    centred = np.array(d, dtype=float) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    white = centred @ axes / np.sqrt(e)
    share = e / np.trace(centred.T @ centred / n)
    return {key: (sum(v * v for v in row), np.abs(w), share) for key, row, w in zip(keys, d, white)}


def test_whitening_equals_one_matrix(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = plain_whitening({r["vec_id"]: r["embedding"] for r in table.collect()})
    got = queries.op11_chan_whitening(spark, sf_dir)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.collect()
    assert len(rows) == 8 * len(want) and len({(r["vec_id"], r["component"]) for r in rows}) == len(rows)
    one = {r["identity_error"] for r in rows}
    assert len(one) == 1 and one.pop() < 1e-9
    for r in rows:
        deviation, white, share = want[r["vec_id"]]
        assert r["n"] == len(want) and r["deviation"] == deviation
        assert abs(r["whitened"]) == pytest.approx(white[r["component"] - 1], rel=1e-7, abs=1e-8)
        assert r["explained"] == pytest.approx(share[r["component"] - 1], rel=1e-9)
    again = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(table.repartition(7)).collect()}
    assert all(again[r["vec_id"], r["component"]] == pytest.approx(r["whitened"], rel=1e-6, abs=1e-7) for r in rows)


def test_chan_merge_of_any_parts_is_the_whole():
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (300, 5)) + 10**12
    whole = whitening.moments(5, x)[5]
    cuts = [0, 1, 7, 7, 120, 300]
    held: dict = {}
    for a, b in zip(cuts, cuts[1:]):
        held = whitening.merged(held, whitening.moments(5, x[a:b]))
    n, sums, scatter = held[5]
    exact = x - 10**12
    want = exact.T @ exact - np.outer(exact.sum(axis=0), exact.sum(axis=0)) / 300
    assert n == 300 and sums == whole[1] == [int(s) for s in x.astype(object).sum(axis=0)]
    assert np.allclose(scatter, want, rtol=1e-12) and np.allclose(whole[2], want, rtol=1e-12)


def test_whitening_of_awkward_vectors(spark):
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [1.0, float("inf")], [float("-inf"), 0.0]]
    two = [[float(a), float(b)] for a, b in [(0, 0), (1, 5), (2, 1), (2, 1), (-3, 2)]]
    rows = [(100 + i, v, "c") for i, v in enumerate(bad)] + [(i, v, "c") for i, v in enumerate(two)] + [(None, [9.0, 9.0], "c"), (50, [1.0, 2.0, 3.0], "c"), (51, [1.0, 2.0, 3.0], "c"), (60, [4.0], "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").withColumns({"n": F.lit("c"), "x": F.lit("c"), "key": F.lit("c")})
    got = whitening.whiten(table).collect()
    # equal vectors and a lone one have no component; the six of length two have both
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in got) == [(False, i, c) for i in range(5) for c in (1, 2)] + [(True, 0, 1), (True, 0, 2)]
    assert {r["n"] for r in got} == {6} and all(r["identity_error"] < 1e-9 for r in got)
    assert len({r["whitened"] for r in got if r["vec_id"] in (2, 3) and r["component"] == 1}) == 1
    assert whitening.whiten(table.limit(0)).collect() == [] and whitening.whiten(table.where("vec_id >= 100")).collect() == []


def test_deviation_beyond_a_long_is_null_and_below_exact(spark):
    big = [(0, [3e6, 0.0]), (1, [-3e6, 1.0]), (2, [0.0, 5.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()}
    want = plain_whitening({k: v for k, v in big}, 2)
    assert any(want[k][0] > 2**63 - 1 for k in got)
    assert got == {k: w[0] if w[0] < 2**63 else None for k, w in want.items()}
    huge = whitening.whiten(spark.createDataFrame([(0, [1e300]), (1, [-1e300])], "vec_id long, embedding array<double>")).collect()
    assert [r["deviation"] for r in huge] == [None, None]


# --- 12 ---------------------------------------------------------------------------------------------------------

TRICKY = [
    "it's we'll DON'T 12,345 a<|endoftext|>b \x1cq\x1fz é é ﬁ  x", "İSTANBUL ΣΑΣ naïve ªº µ ÷× ß", "", "  \n", "日本語 テキスト",
    "a" * 1000, "<|startoftext|><|endoftext|>x<|ENDOFTEXT|>", "aaaa aaab aab abab " * 3, "antidisestablishmentarianism antidote anti ant an a",
    "\x85x y　z\xa0w", "🙂🙃 👩‍👩‍👧 é ́", "the" * 500, "<| |> <|endoftext|", "\x00 \x7f �",
]


def random_text(rng: random.Random) -> str:
    return "".join(rng.choice(["a", "b", "th", "e", "in", "ing", " ", "s", "'", "1", ".", "é", "Z", "ss", "\n", "-", "日"]) for _ in range(rng.randint(0, 120)))


def test_ids_and_decoded_texts_equal_the_library():
    whole, rng = Tokenizer.from_file(VOCABULARY), random.Random(12)
    encoder = bpe.Encoder(VOCABULARY)
    texts = TRICKY + [random_text(rng) for _ in range(1500)]
    for part in (texts[:400], texts[400:]):
        for text, ids in zip(part, encoder.encode(part)):
            want = whole.encode(text, add_special_tokens=False).ids
            got = np.frombuffer(ids, "<u4").tolist()
            assert got == want, text
            assert " ".join(encoder.vocabulary.texts[i] for i in got) == whole.decode(want, skip_special_tokens=False)


def test_every_token_and_border_by_merging_plainly():
    """Random words of few letters, where merges compete: the trie against merging by rank, left to right."""
    v, rng = bpe.Vocabulary(VOCABULARY), random.Random(3)

    def merge(word: str) -> list[int]:
        ids = [v.ids[c] for c in word[:-1]] + [v.ids[word[-1] + v.end]]
        while True:
            ranks = [(v.ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in v.ranks]
            if not ranks:
                return ids
            _, i = min(ranks)
            ids[i : i + 2] = [v.ids[v.texts[ids[i]] + v.texts[ids[i + 1]]]]

    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for letters in ("ab", "aeinst", "!?.", "etaoinshrdlu") for _ in range(1500)}
    got = dict(bpe.Trie(words).encoded(v))
    assert set(got) == words and all(list(got[w]) == merge(w) for w in words)


def test_trie_computes_a_shared_prefix_once(monkeypatch):
    v = bpe.Vocabulary(VOCABULARY)
    asked = []
    last = v.last
    monkeypatch.setattr(v, "last", lambda path, n, states, final=False: asked.append((path[:n], final)) or last(path, n, states, final))
    words = ["international", "internationally", "internet", "interval", "in"]
    assert {w for w, _ in bpe.Trie(words).encoded(v)} == set(words)
    assert len(asked) == len(set(asked))
    prefixes = {w[:n] for w in words for n in range(1, len(w))}
    assert {p for p, final in asked if not final} <= prefixes and sum(final for _, final in asked) == len(words)


def test_words_are_forgotten_at_a_bound(monkeypatch):
    monkeypatch.setattr(bpe, "HELD", 2000)
    whole, encoder, rng = Tokenizer.from_file(VOCABULARY), bpe.Encoder(VOCABULARY), random.Random(1)
    for _ in range(30):
        texts = [random_text(rng) for _ in range(5)] + ["the cat"]
        assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoding_query_equals_the_library(spark, sf_dir, texts):
    whole = Tokenizer.from_file(VOCABULARY)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_trie_bpe(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for key, text in texts.items():
        ids = whole.encode(text, add_special_tokens=False).ids
        assert got[key] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(whole.decode(ids, skip_special_tokens=False)))


def test_encoding_of_awkward_rows(spark, awkward):
    whole = Tokenizer.from_file(VOCABULARY)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r["doc_id"], r["n_tokens"], sha(bytes(r["ids"]))) for r in bpe.encode(awkward, VOCABULARY).collect()), key=key)
    ids = [(k, whole.encode(t or "", add_special_tokens=False).ids) for k, t, *_ in AWKWARD]
    assert got == sorted(((k, len(i), sha(np.array(i, "<u4").tobytes())) for k, i in ids), key=key)
    assert bpe.encode(awkward.limit(0), VOCABULARY).collect() == []
    some = spark.createDataFrame([(1, np.array([320, 49406, 999999, 49407], "<u4").tobytes()), (2, None), (3, b"")], "row long, ids binary")
    assert [tuple(r) for r in bpe.decode(some, VOCABULARY).collect()] == [(1, "a</w> <|startoftext|> <|endoftext|>"), (2, ""), (3, "")]


# --- 13 ---------------------------------------------------------------------------------------------------------


def plain_middle(key, text: str) -> tuple:
    """The contract, with lists of lines; restored is the text itself."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        return key, n, "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 50:
        return key, n, "spm", len(pre), len(mid), sha(f"<S>{suf}<P>{pre}<M>{mid}"), sha(text)
    return key, n, "psm", len(pre), len(mid), sha(f"<P>{pre}<S>{suf}<M>{mid}"), sha(text)


def test_fill_in_middle_equals_the_plain_version(spark, sf_dir, texts):
    got = sorted(tuple(r) for r in queries.op13_fill_in_middle(spark, sf_dir).collect())
    assert got == sorted(plain_middle(k, t) for k, t in texts.items())
    assert {g[2] for g in got} >= {"psm", "spm"}


def test_fill_in_middle_of_awkward_rows(spark, awkward):
    more = ["\n", "\n\n\n", "a\nb", "a\nb\n", "😀é\n日本\n" * 50, "x <P> y\nz", "<M>", "<", "<P\n<S\n<M\n>\n", "\r\n\x85 \n", "<P<S>\nq"]
    rows = [(k, t) for k, t, *_ in AWKWARD] + [(k * 31 + s, t) for k, t in enumerate(more, 100) for s in range(9)]
    table = awkward.select("doc_id", "text").limit(0).union(spark.createDataFrame(rows, "doc_id long, text string")).withColumns({c: F.lit("clash") for c in ("n", "form", "output", "made", "middle_chars")})
    made = middles.fill_in_middle(table)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    back = made.withColumn("restored", middles.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    got = sorted(((*tuple(r)[:5], r["output_sha256"], sha(r["restored"])) for r in back), key=key)
    assert got == sorted((plain_middle(k, t or "") for k, t in rows), key=key)
    assert middles.fill_in_middle(table.limit(0)).collect() == []


def test_rate_share_and_marks(spark):
    table = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("one\ntwo\nthree\n").alias("text"))
    forms = {r["form"]: r["count"] for r in middles.fill_in_middle(table, rate=40, spm=25, marks=("[p]", "[s]", "[m]")).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 1200) < 120 and abs(forms["spm"] - 200) < 60 and sum(forms.values()) == 2000
    for marks in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "x"), ("aa", "b", "c"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            middles.restore(F.lit("x"), F.lit("psm"), marks)
