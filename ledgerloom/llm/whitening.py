"""Whitening of vectors: integer components projected on their covariance's eigenvectors, each to unit variance.

Each component c becomes the integer x = floor(scale * c) + shift.  Every partition gives its count, its
mean (as exact sums) and the scatter about that mean; two such parts merge by Chan's formula,
M = Ma + Mb + (na nb / n) d d' with d the difference of the means, in a tree of tasks, so that neither
a great shift nor the number of rows costs digits and the driver takes one matrix of width x width.  The
eigenvectors are found there; they and the sums go out to all tasks (a few width x width doubles).  A second pass
whitens the rows and gathers the covariance of the result the same way, which must be the identity; a third
writes them out.  No pass shuffles a row.

Vectors that are null or empty, or hold a null, NaN or infinity, take no part.  Vectors of different lengths are
different populations: each length has a model of its own.  Components whose eigenvalue is no more than
``width * 1e-14`` of the greatest have no variance to be scaled and are left out, so a population of equal vectors
(or of one) has no rows.  Components that do not fit a long saturate; ``deviation`` is null where its exact
value does not fit one.  Null keys, repeated rows and ties are kept, each row with rows of its own; of tied
eigenvalues any basis is right and the one found is used for all rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows worked on at once: an Arrow batch is cut to so many doubles.
CELLS = 1 << 20
_LONG = (1 << 63) - 1

#: By the width of the vectors: count, sums of the columns (of integers exact: they stand for the mean), scatter about the mean.
Moments = dict[int, tuple[int, list, np.ndarray]]


def merged(a: Moments, b: Moments) -> Moments:
    """Moments of two disjoint sets of rows taken together, by Chan's formula."""
    out = dict(a)
    for width, (nb, sb, cb) in b.items():
        if width in out:
            na, sa, ca = out[width]
            d = np.array([(y * na - x * nb) / (na * nb) for x, y in zip(sa, sb)])  # of integers rounded once, by the division
            out[width] = (na + nb, [x + y for x, y in zip(sa, sb)], ca + cb + np.outer(d, d) * (na * (nb / (na + nb))))
        else:
            out[width] = (nb, sb, cb)
    return out


def _split(sums: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """sums / n as a whole part and the rest, so that integers can be centred without loss."""
    return np.array([s // n for s in sums]), np.array([s % n / n for s in sums])


def moments(width: int, x: np.ndarray) -> Moments:
    """Moments of the rows of one matrix made of vectors of some width."""
    if not len(x):
        return {}
    if x.dtype.kind == "i":
        sums = [(int(h) << 32) + int(w) for h, w in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
    else:
        sums = x.sum(axis=0).tolist()
    base, rest = _split(sums, len(x))
    centred = (x - base).astype(float) - rest
    return {width: (len(x), sums, centred.T @ centred)}


def _matrices(table: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lists = table.column(column)
    widths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        each = max(1, CELLS // width)
        for k in range(0, len(rows), each):
            part = rows[k : k + each]
            yield part, pc.list_flatten(lists.take(pa.array(part))).to_numpy(zero_copy_only=False).reshape(-1, width)


def integers(vector: Column, scale: int = 1024, shift: int = 100_000) -> Column:
    """floor(scale * c) + shift of each component, or null where the vector can take no part."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    top = F.lit(_LONG - abs(shift))
    moved = F.transform(vector, lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), -top), top) + F.lit(shift).cast("long"))
    return F.when(whole & (F.size(vector) > 0), moved)


class Whitener:
    """The model of one width: exact sums, eigenvectors by falling eigenvalue, and their scales."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray, most: int) -> None:
        values, vectors = np.linalg.eigh(scatter / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        k = min(most, int((values > max(values[0], 0.0) * len(values) * 1e-14).sum()))
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
        self.n, self.sums, self.axes = n, sums, (vectors * signs)[:, :k]
        self.scales, self.explained = np.sqrt(values[:k]), values[:k] / np.trace(scatter / n) if k else values[:0]
        self.base, self.rest = _split(sums, n)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part is taken off as an integer, so that nothing is lost to the shift."""
        return (x - self.base).astype(float) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / self.scales

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly; None beyond a long."""
        far = max((abs(int(v) * self.n - s) for row in (x.min(axis=0), x.max(axis=0)) for v, s in zip(row, self.sums)), default=0)
        if far * far * len(self.sums) <= _LONG and max(map(abs, self.sums)) + far <= _LONG:
            d = x * self.n - np.array(self.sums)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((int(v) * self.n - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [e if e <= _LONG else None for e in exact]


def _gathered(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> Moments:
    """Moments of what ``of`` makes of all rows: one part a partition, merged in a tree of tasks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Moments = {}
        for batch in batches:
            for _, x in _matrices(batch, 0):
                held = merged(held, moments(x.shape[1], of(x)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["part"])

    parts = rows.select("x").mapInArrow(part, "part binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return parts.treeReduce(merged) if parts.getNumPartitions() else {}


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    ``identity_error`` is the greatest entry, by size, of the whitened vectors' covariance minus the identity.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), integers(F.col(vector), scale, shift).alias("x")).where("x IS NOT NULL")
    models = {w: Whitener(n, sums, scatter, components) for w, (n, sums, scatter) in _gathered(rows, lambda x: x).items()}
    sent = spark.sparkContext.broadcast(models)
    after = _gathered(rows, lambda x: sent.value[x.shape[1]].whitened(x))
    errors = {w: float(np.abs(scatter / n - np.eye(len(scatter))).max(initial=0.0)) for w, (n, _, scatter) in after.items()}

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, 1):
                model = sent.value[x.shape[1]]
                k, m = len(model.scales), len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(model.explained, m)),
                        pa.array(np.full(m * k, errors[x.shape[1]])),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = vectors.schema[key].dataType.simpleString()
    out = rows.mapInArrow(written, f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("key", key)
