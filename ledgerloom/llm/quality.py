"""Quality scores by a factorisation machine.

Features of a whole text: hashed words, hashed word shapes (the kinds of its first and last bytes),
and statistics of structure and length (shares of capitals, digits, symbols, repeated words and
lines, ...), each as a number and as the bucket it falls into; the declared length is metadata.  The
score is  w0 + sum w x + 1/2 sum_f [(sum v x)^2 - sum v^2 x^2],  linear in the number of features.

The machine is fitted on at most ``train_rows`` labelled rows, one for each of the ids with the least hash (of rows
that share an id, the one of least hash, whatever their number);
the model's size is fixed by its tables and it is broadcast.  Every row is scored from its whole text
in one pass without a shuffle.

Nulls: a null text is an empty one and is scored from its (empty) statistics; a null id keeps its row.
Labels that are null are ignored; of
several labels for an id the lowest counts.  Without labels of both classes every score is the share
of label 1 (0.5 without any).  Equal texts of equal declared length have equal scores.  Empty tables
give empty results.  Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytestext import BLANK, LOWER, as_bytes, per_row, prefix_sums, slices, span_hashes, tokens

WORDS, SHAPES, BUCKETS, FACTORS = 1 << 14, 4096, 12, 4
_KIND = np.full(256, 5, np.int64)  # 5: other signs
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[44, 46]] = 4
STATS = 17
SIZE = WORDS + SHAPES + STATS * (BUCKETS + 1)


def _normed(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return values / np.sqrt(np.maximum(per_row(values**2, rows, n), 1e-12))[rows]


def _counted(rows: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both, counts = np.unique(rows * size + ids, return_counts=True)
    return both // size, both % size, counts


def features(texts: pa.Array, declared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of each feature, ordered by row."""
    body, offsets = as_bytes(texts)
    n, size = len(texts), np.maximum(np.diff(offsets), 1)
    starts, ends, row = tokens(~BLANK[body], offsets)
    words = per_row(np.ones(len(row)), row, n)
    hashes = span_hashes(prefix_sums(LOWER[body]), starts, ends)
    wr, wi, wc = _counted(row, (hashes % np.uint64(WORDS)).astype(np.int64), WORDS)
    kinds = _KIND[body] if len(body) else np.empty(0, np.int64)
    second, last_but = np.minimum(starts + 1, ends - 1), np.maximum(ends - 2, starts)
    shape = ((kinds[starts] * 8 + kinds[second]) * 8 + kinds[last_but]) * 8 + kinds[ends - 1]
    sr, si, sc = _counted(row, shape % SHAPES, SHAPES)
    at = np.repeat(np.arange(n), np.diff(offsets))
    share = lambda hit: per_row(hit.astype(float), at, n) / size
    ls, le, lr = tokens(body != 10, offsets)
    lines = per_row(np.ones(len(lr)), lr, n)
    line_kinds = per_row(np.ones(1), np.zeros(1, int), n) * 0
    if len(lr):
        ur, _, _ = _counted(lr, (span_hashes(prefix_sums(body), ls, le) % np.uint64(1 << 40)).astype(np.int64), 1 << 40)
        line_kinds = per_row(np.ones(len(ur)), ur, n)
    some = np.maximum(words, 1)
    kinds_of_words = per_row(np.ones(len(wr)), wr, n)
    shouted = (kinds[starts] == 2) & (kinds[last_but] == 2) if len(row) else np.empty(0, bool)
    noisy = kinds[ends - 1] == 5 if len(row) else np.empty(0, bool)
    lone = (ends - starts == 1) & (kinds[starts] == 5) if len(row) else np.empty(0, bool)
    stats = np.stack(
        [
            np.log1p(np.diff(offsets)) / 16,
            np.log1p(words) / 14,
            share(kinds == 2),
            share(kinds == 3),
            share((kinds == 5) & ~BLANK[body]),
            share(kinds == 6),
            share(BLANK[body]),
            np.minimum(per_row((ends - starts).astype(float), row, n) / some / 20, 1),
            kinds_of_words / some,
            np.minimum(lines / some, 1),
            line_kinds / np.maximum(lines, 1),
            per_row(shouted.astype(float), row, n) / some,
            per_row(noisy.astype(float), row, n) / some,
            per_row(lone.astype(float), row, n) / some,
            np.minimum(per_row((ends - starts > 24).astype(float), row, n) / some, 1),
            per_row((kinds[ends - 1] == 4).astype(float) if len(row) else np.empty(0), row, n) / some,
            np.log1p(np.maximum(declared, 0)) / 16,
        ],
        axis=1,
    )
    bucket = np.minimum((stats * BUCKETS).astype(np.int64), BUCKETS - 1) + np.arange(STATS) * BUCKETS + STATS
    sid = WORDS + SHAPES + np.concatenate([np.tile(np.arange(STATS), (n, 1)), bucket], axis=1)
    value = np.concatenate([stats, np.full((n, STATS), 0.5)], axis=1)
    rows = np.concatenate([wr, sr, np.repeat(np.arange(n), 2 * STATS)])
    ids = np.concatenate([wi, WORDS + si, sid.ravel()])
    values = np.concatenate([_normed(np.log1p(wc), wr, n), _normed(sc.astype(float), sr, n), value.ravel()])
    order = np.argsort(rows, kind="stable")
    return rows[order], ids[order], values[order]


def raw_scores(model: dict, rows: np.ndarray, ids: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The machine's sums before the logistic, by the sum-of-squares identity, and sum v x of each factor."""
    out = model["w0"] + per_row(model["w"][ids] * values, rows, n)
    sums = np.empty((n, FACTORS))
    for f in range(FACTORS):
        vx = model["v"][ids, f] * values
        sums[:, f] = per_row(vx, rows, n)
        out += 0.5 * (sums[:, f] ** 2 - per_row(vx**2, rows, n))
    return out, sums


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 1e-4) -> dict:
    """AdaGrad on the logistic loss; classes weigh alike."""
    rng, n = np.random.default_rng(7), len(y)
    model = {"w0": 0.0, "w": np.zeros(SIZE), "v": rng.normal(0, 0.02, (SIZE, FACTORS))}
    ones = y.mean() if n else 0.5
    if n == 0 or ones in (0.0, 1.0):
        share = min(max(ones, 1e-6), 1 - 1e-6)
        return {"w0": float(np.log(share / (1 - share))), "w": model["w"], "v": np.zeros((SIZE, FACTORS))}
    weight = np.where(y == 1, 0.5 / ones, 0.5 / (1 - ones))
    seen = {"w0": 1e-8, "w": np.full(SIZE, 1e-8), "v": np.full((SIZE, FACTORS), 1e-8)}
    edges = np.searchsorted(rows, np.arange(n + 1))
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, 128):
            part = order[k : k + 128]
            at = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in part])
            r = np.repeat(np.arange(len(part)), edges[part + 1] - edges[part])
            i, x = ids[at], values[at]
            z, sums = raw_scores(model, r, i, x, len(part))
            g = (logistic(z) - y[part]) * weight[part] / len(part)
            gw = np.bincount(i, g[r] * x, SIZE) + decay * model["w"] / len(part)
            seen["w"] += gw**2
            model["w"] -= rate * gw / np.sqrt(seen["w"])
            for f in range(FACTORS):
                gv = np.bincount(i, g[r] * x * (sums[r, f] - model["v"][i, f] * x), SIZE) + decay * model["v"][:, f] / len(part)
                seen["v"][:, f] += gv**2
                model["v"][:, f] -= 0.25 * rate * gv / np.sqrt(seen["v"][:, f])
            seen["w0"] += g.sum() ** 2
            model["w0"] -= rate * g.sum() / np.sqrt(seen["w0"])
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            rows, ids, values = features(part.column(1), part.column(2).to_numpy(zero_copy_only=False))
            edges = pa.array(np.searchsorted(rows, np.arange(part.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.ListArray.from_arrays(edges, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(edges, pa.array(values, pa.float32())),
                ],
                ["label", "ids", "values"],
            )


def _trained(sample: pd.DataFrame) -> pd.DataFrame:
    rows = np.repeat(np.arange(len(sample)), sample["ids"].str.len().to_numpy(int))
    model = fit(rows, np.concatenate(sample["ids"].to_list()).astype(np.int64), np.concatenate(sample["values"].to_list()).astype(float), sample["label"].to_numpy(float))
    small = {"w0": model["w0"], "w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32)}
    return pd.DataFrame({"model": [pickle.dumps(small)]})


def train(docs: DataFrame, labels: DataFrame, train_rows: int, key: str, text: str, declared: str, label: str) -> dict:
    """Fits on the train_rows labelled rows with the least hash of their id; labels holds the rows allowed."""
    chosen = (
        labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.min(label).cast("double").alias("label"))
        .orderBy(F.xxhash64(key), key).limit(train_rows)
    )
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("text"), _declared(docs, declared)).join(F.broadcast(chosen), key)
    # an id that many rows have counts as one: that of the least hash, found where the rows are and then among tasks
    rows = rows.groupBy(key).agg(F.min_by(F.struct("label", "text", "declared"), F.struct(F.xxhash64("text", "declared"), "declared")).alias("one")).select("one.*")
    featured = rows.select("label", "text", "declared").mapInArrow(_featured, "label double, ids array<int>, values array<float>")
    fitted = featured.groupBy(F.lit(0).alias("one")).applyInPandas(_trained, "model binary").collect()
    if not fitted:
        return fit(np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0))
    return pickle.loads(bytes(fitted[0]["model"]))


def _declared(docs: DataFrame, declared: str):
    known = F.coalesce(F.col(declared).cast("double"), F.lit(0.0)) if declared in docs.columns else F.lit(0.0)
    return known.alias("declared")


def score(
    docs: DataFrame, labels: DataFrame, train_rows: int = 8000, key: str = "doc_id", text: str = "text", declared: str = "n_chars", label: str = "quality"
) -> DataFrame:
    """key and score (0 to 1) of each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows, key, text, declared, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = features(part.column(1), part.column(2).to_numpy(zero_copy_only=False))
                z, _ = raw_scores(held.value, *found, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(logistic(z))], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _declared(docs, declared)).mapInArrow(run, f"key {kind}, score double")
    return scored.withColumnRenamed("key", key)
