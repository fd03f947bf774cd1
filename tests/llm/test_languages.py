"""Trigram models against plain counting, and pages with every awkward row."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import languages

TEXTS = [
    ("en", "The cat, and the dog!  42 birds"), ("en", "a THE\tthe"), ("en", ""), ("en", None), ("fr", "Le chat été naïf là-bas"), ("fr", "et le chien"), ("de", "Der Hund über Ähren"), (None, "the le der"), ("de", "xy"),
]


def plain_grams(text):
    """Hashed trigrams of a text, one after the other."""
    kept = [b | 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
    kept = [b if 97 <= b <= 122 or b >= 128 else 32 for b in kept]
    for x, y, z in zip(kept, kept[1:], kept[2:]):
        if (x, y, z) != (32, 32, 32):
            yield ((x << 16 | y << 8 | z) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 49


def test_models_and_scores_equal_plain_counting(spark):
    rows = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(TEXTS)], "key long, declared string, text string").repartition(3)
    names, log = languages.fit(rows, train_rows=1000)
    assert names == ["de", "en", "fr", languages.UNKNOWN]
    counts = {n: Counter(g for lang, text in TEXTS if lang == n for g in plain_grams(text)) for n in names}
    plain = lambda n, g: -math.log(languages.GRAMS) if n == languages.UNKNOWN else math.log((counts[n][g] + 0.5) / (sum(counts[n].values()) + 0.5 * languages.GRAMS))
    for i, n in enumerate(names):
        for g in [*list(counts[n])[:20], 0, 5]:
            assert log[i, g] == pytest.approx(plain(n, g), rel=1e-12)
    held = spark.sparkContext.broadcast(log)
    scored = rows.select("text", "key").mapInArrow(languages._text_scores(held, 12, ["key"]), "key long, n_grams long, scores array<double>").collect()
    assert len(scored) == len(TEXTS)
    for r in scored:
        mine = list(plain_grams(TEXTS[r["key"]][1]))
        assert r["n_grams"] == len(mine)
        want = [sum(plain(n, g) for g in mine) * (min(len(mine), 12) / max(len(mine), 1)) for n in names]
        assert r["scores"] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_pages_with_awkward_rows(spark):
    text = "the cat and the dog are with a bird in the house of the old man and the sea " * 3
    html = lambda lang, body: f"<html{lang}><body><p>{body}</p></body></html>"
    pages = [(i, f"http://site{i % 3}.example.org/{i}", html(' lang="en"', text + str(i))) for i in range(30)]
    pages += [(100, None, html("", text)), (101, "http://x.org/", None), (102, "http://x.org/", ""), (103, "not an address", html(' lang=""', "")), (None, "http://x.org/", html(' lang="EN-us"', text)), (104, "http://x.org/", html("", text)), (104, "http://x.org/", html("", text)), (105, "", "<" * 2000)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").select("*", *[F.lit("clash").alias(c) for c in ("key", "text", "declared", "host", "scores", "language", "n_grams", "best", "domain")])
    found = languages.identify(languages.page_rows(table), "page_id", "text", declared="declared", host="url")
    got = [(r["page_id"], r["language"], r["accepted"]) for r in found.collect()]
    assert len(got) == len(pages)
    by = {k: (lang, ok) for k, lang, ok in got}
    assert all(by[k] == ("en", True) for k in [*range(30), 100, 104, None])
    assert not any(by[k][1] for k in (101, 102, 103))
    assert sum(k == 104 for k, _, _ in got) == 2
    assert languages.identify(languages.page_rows(table.limit(0)), "page_id", "text", declared="declared", host="url").collect() == []
