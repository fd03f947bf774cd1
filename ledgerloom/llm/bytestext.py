"""Texts of an Arrow batch as one byte array, cut into tokens and hashed without a loop over words.

Helpers for tasks: Spark deals the batches, these work on a slice of about a megabyte at a time so
that a worker's memory stays small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once (a longer text is worked on alone); an operator holds some hundred times as much.
SLICE = 1 << 18
#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15

BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: int = 1, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts come to about so many bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cut = np.cumsum(sizes) // size
    starts = np.flatnonzero(np.diff(cut, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts (null: none) and where each text begins, with the end last."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, so that any of their bits may be used."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (np.uint64(_BASE), np.uint64(inverse)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and their inverses, modulo 2**64."""
    size = SLICE * 2
    while size < n:
        size *= 2
    up, down = _powers(size)
    return up[: n + 1], down[: n + 1]


def prefix_sums(body: np.ndarray) -> np.ndarray:
    """s[i]: the polynomial of the first i bytes, from which any span's hash is one subtraction."""
    up, _ = powers(len(body))
    return np.concatenate([[np.uint64(0)], np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: len(body)])])


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    _, down = powers(len(sums) - 1)
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def tokens(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs where inside holds; no run crosses a text's edge."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(float)
