"""Helpers against brute force, without Spark."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import bytestext, collection_bwt, licenses, mixing, packing, passages, sharding, simhash, topk
from ledgerloom.llm.queries import vocabulary


def test_span_hashes_depend_on_the_bytes_alone():
    body = np.frombuffer(b"abcab" * 40, np.uint8)
    sums = bytestext.prefix_sums(body)
    h = bytestext.span_hashes(sums, np.array([0, 3, 5, 1]), np.array([2, 5, 7, 3]))
    assert h[0] == h[1] == h[2] != h[3]


def test_tokens_stop_at_text_edges():
    body, offsets = bytestext.as_bytes(pa.array(["ab c", None, "", "de"]))
    starts, ends, rows = bytestext.tokens(~bytestext.BLANK[body], offsets)
    assert [(body[a:b].tobytes(), r) for a, b, r in zip(starts, ends, rows)] == [(b"ab", 0), (b"c", 0), (b"de", 3)]


@pytest.mark.parametrize("seed", range(40))
def test_column_wise_order_and_owners(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 12))]
    size, owners = rng.randint(1, 5), np.array([rng.randint(0, 30) for _ in strings])
    sid, length, common = collection_bwt.suffixes(strings, 50)
    tails = [strings[i][len(strings[i]) - n :] for i, n in zip(sid, length)]
    assert tails == sorted(tails)
    for a, b, c in zip(tails, tails[1:], common[1:]):
        assert c == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    best: dict = {}
    for s, o in zip(strings, owners):
        for i in range(len(s) - size + 1):
            best[s[i : i + size]] = min(best.get(s[i : i + size], 99), o)
    for s, got in zip(strings, collection_bwt.least_owner(strings, owners, size)):
        assert got.tolist() == [best[s[i : i + size]] for i in range(max(0, len(s) - size + 1))]


def test_equal_strings_have_equal_owners():
    rng = random.Random(1)
    shared = bytes(rng.choice(b"abcd ") for _ in range(70))
    texts = [bytes(rng.choice(b"abcd ") for _ in range(30)) + shared + bytes(rng.choice(b"abcd ") for _ in range(40)) for _ in range(2)]
    body = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.array([0, len(texts[0]), len(body)])
    h, row, first, last, _, _ = passages.owners(body, offsets)
    of = {int(q): int(h[i]) for i in range(len(h)) for q in range(first[i], last[i] + 1)}
    assert len(of) == sum(len(t) - 49 for t in texts)
    for k in range(21):
        assert of[30 + k] == of[len(texts[0]) + 30 + k]


@pytest.mark.parametrize("seed", range(8))
def test_plan_packs_everything_within_capacity(seed):
    rng = random.Random(seed)
    histogram: dict = {}
    for _ in range(500):
        n = rng.choice([rng.randint(1, 100), rng.randint(1, 30), 100])
        histogram[n] = histogram.get(n, 0) + 1
    patterns = packing.plan_patterns(dict(histogram), 100)
    used: dict = {}
    for lengths, times in patterns:
        assert sum(lengths) <= 100 and times > 0
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == histogram
    least = -(-sum(k * n for k, n in histogram.items()) // 100)
    assert sum(t for _, t in patterns) <= least + 2


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    ids = packing._ids(vocabulary())
    for text in ["it's we'll DON'T 12,345 a<|endoftext|>b \x1cq\x1fz é é ﬁ  x", "İSTANBUL ΣΑΣ naïve ªº µ ÷× ß", "", "  \n", "日本語 テキスト", "a" * 100]:
        got = b"".join(map(ids.__getitem__, packing._words(text)))
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    x, p = rng.integers(1, 500, 400).astype(float), np.full(400, 0.37)
    out = mixing.fly(x, p, np.random.default_rng(1))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * x).sum() - (p * x).sum()) < 1e-5
    done = mixing.land(x, out)
    assert set(np.unique(done)) <= {0.0, 1.0} and abs((done * x).sum() - (p * x).sum()) <= 500


def test_deal_fills_every_shard():
    rng = random.Random(2)
    owner = [rng.randrange(5) for _ in range(60)]
    owner[:5] = range(5)
    counts = [rng.randrange(40) for _ in owner]
    total = sum(counts)
    bounds = [total // 5 + (s < total % 5) for s in range(5)]
    plan = sharding.deal(counts, owner, bounds)
    loads = [sum(p["high"] - p["low"] for p in plan if p["shard"] == s) for s in range(5)]
    assert loads == bounds
    for arc, n in enumerate(counts):
        ranks = sorted((p["low"], p["high"]) for p in plan if p["arc"] == arc)
        assert [a for a, _ in ranks] == [0, *[b for _, b in ranks]][: len(ranks)] and (not n or ranks[-1][1] == n)


def test_vantage_tree_finds_every_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 64, (12, 2))]))
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if int(points[i] ^ points[j]).bit_count() <= 3}
    got = set()
    for a, b in simhash.near_pairs(points, 3):
        got.update((min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist()))
    assert got == want and len(want) > 40


def test_fingerprint_edges():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A b") == simhash.fingerprint("a  B") != simhash.fingerprint("a c")


@pytest.mark.parametrize("size", [1, 1 << 24, 1 << 30, 1 << 50])
def test_ball_tree_search_is_exact(size):
    """Also where scores are beyond what doubles, or longs, hold exactly: many of them differ by a few units only."""
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(0, 40, (900, 8))).astype(np.int64) + (size if size > 1 else 0)
    x[300:500] = x[0]
    ids, own = rng.permutation(900), np.arange(0, 900, 90)
    search = topk.Search(x, ids, x[own], own, np.full(len(own), -np.inf), 5, leaf=32)
    search.run()
    got = sorted(search.found(), key=lambda f: (f[0], -f[2], ids[f[1]]))
    want = []
    for n, j in enumerate(own):
        s = [sum(int(a) * int(b) for a, b in zip(x[j], y)) for y in x]
        want += [(n, i, s[i]) for i in sorted((i for i in range(900) if i != j), key=lambda i: (-s[i], ids[i]))[:5]]
    assert got == want


def test_license_bands_find_what_containment_holds():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    docs, want = [], []
    for k in range(60):
        name = rng.choice(list(licenses.TEMPLATES))
        noise = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        docs.append(f"{noise()} {licenses.TEMPLATES[name].upper() if k % 2 else licenses.TEMPLATES[name]} {noise()}")
        want.append(name)
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(docs)], ["key", "text"])
    found = {(k, n) for b in licenses._scan(licenses.TEMPLATES, 0.8)(iter([batch])) for k, n in zip(b["key"].to_pylist(), b["license"].to_pylist())}
    assert {(k, n) for k, n in enumerate(want)} <= found


@pytest.mark.parametrize("seed", range(20))
def test_distinct_ahead_counts_each_stretch(seed):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.choice(200, rng.integers(1, 80), replace=False))
    ids, reach = rng.integers(0, 12, len(at)), int(rng.integers(1, 60))
    counts, last = licenses.distinct_ahead(at, ids, reach)
    for i in range(len(at)):
        inside = [j for j in range(i, len(at)) if at[j] < at[i] + reach]
        assert counts[i] == len({int(ids[j]) for j in inside}) and last[i] == inside[-1]


def test_a_bundle_of_licenses_takes_no_longer_than_its_words():
    """A megabyte of one license text in every row of words is looked at in one pass; it took a second and a half a kilobyte."""
    import time

    text = "\n".join([licenses.TEMPLATES["MIT-text"]] * 1000)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["key", "text"])
    began = time.perf_counter()
    found = {r["license"]: r["containment"] for b in licenses._scan(licenses.TEMPLATES, 0.8)(iter([batch])) for r in b.to_pylist()}
    assert found["MIT-text"] == 1.0 and time.perf_counter() - began < 60
