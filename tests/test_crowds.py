"""Crowded bands: every pair of one is decided, whatever the members' centre is like."""

import random

import pytest
from ledgerloom.llm import nearcopies, scratch
from ledgerloom.operators import contamination, crowds
from ledgerloom.operators.groups import components


def groups(links):
    return {r["node"]: r["group"] for r in components(links).collect()}


def brute(nodes, alike):
    label = {n: n for n in nodes}
    for a in nodes:
        for b in nodes:
            if label[a] != label[b] and alike(a, b):
                low, high = sorted((label[a], label[b]))
                label = {n: low if g == high else g for n, g in label.items()}
    return {n: g for n, g in label.items() if any(m != n and label[m] == g for m in nodes)}


def one_band(rng, places, band, clusters):
    """Sets and signatures that share the first band alone; each cluster is (a set of 100, how many of it are replaced in each member)."""
    sets, minima, shared = {}, {}, [rng.randrange(1 << 30) for _ in range(places)]
    for base, edits in clusters:
        for n in edits:
            node = len(sets)
            kept = rng.sample(sorted(base), len(base) - n)
            sets[node] = set(kept) | {rng.randrange(1 << 60) for _ in range(n)}
            # two thirds of all places in common, one place of each other band told apart
            minima[node] = [shared[p] if p < band or p % band else (node << 32 | p) % (1 << 31) for p in range(places)]
    return sets, minima


def crowd(rng):
    base = lambda: {rng.randrange(1 << 60) for _ in range(100)}
    # a centre's copies, links that leave from those, pairs that are alike though the centre is like neither
    return [(base(), [0, *[8] * 6, *[11] * 12]), *[(base(), [0, rng.choice((10, 11, 12, 25))]) for _ in range(20)]]


@pytest.mark.parametrize("members", [4, 1_024])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_of_a_crowded_band_are_linked_as_by_brute_force(spark, monkeypatch, seed, members):
    monkeypatch.setattr(crowds, "MEMBERS", members)
    rng = random.Random(seed)
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    sets, minima = one_band(rng, nearcopies.ROWS * nearcopies.BANDS, nearcopies.ROWS, crowd(rng))
    nodes = spark.createDataFrame([(i, minima[i], len(s), rng.getrandbits(62)) for i, s in sets.items()], "node long, minima array<int>, size int, fp long")
    held = scratch.stage(spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "node long, shingles array<long>"), "test-sets").df
    want = brute(list(sets), alike)
    assert len(want) > 30 and groups(nearcopies.near_links(nodes, lambda _: held)) == want

    sets, minima = one_band(rng, 128, contamination.BAND, crowd(rng))
    signed = spark.createDataFrame([(i, i, minima[i], len(s)) for i, s in sets.items()], "class long, row long, m array<int>, size int")
    held = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "row long, s array<long>")
    want = brute(list(sets), alike)
    assert len(want) > 30 and groups(contamination.near_links(signed, held)) == want


def test_a_crowd_without_likely_members_has_no_links(spark):
    rows = spark.createDataFrame([(0, i, 2) for i in range(20)], "crowd long, node long, size int")
    full = spark.createDataFrame([(i, [i] * 4, [i, i + 100]) for i in range(20)], "node long, m array<int>, s array<long>")
    keep = lambda df, name: scratch.stage(df, f"test-{name}").df
    assert crowds.crowd_links(rows, lambda some: some.join(full, "node"), keep, 3, 0.8).isEmpty()
    assert crowds.crowd_links(rows.limit(0), lambda some: some.join(full, "node"), keep, 3, 0.8).isEmpty()
