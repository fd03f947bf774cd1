"""Column-wise construction of a string collection's Burrows-Wheeler transform and common prefixes.

One symbol of every string is put in each round, from the last column to the first.  A round passes
once over the suffixes known so far: their preceding symbols are the transform, a stable sort by
symbol gives where each suffix goes when its preceding symbol is put before it, and the common prefix
of a new suffix and its neighbour is one more than the least common prefix between the places they
came from.  Nothing but the present round's columns is held.
"""

from __future__ import annotations

import numpy as np


def range_minima(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """min(values[s:e]) for each s < e."""
    if not len(starts):
        return np.empty(0, values.dtype)
    order = np.argsort(-starts, kind="stable")  # falling starts: what lies between two ranges is never scanned
    at = np.empty(2 * len(starts), np.int64)
    at[::2], at[1::2] = starts[order], ends[order]
    out = np.empty(len(starts), values.dtype)
    out[order] = np.minimum.reduceat(np.append(values, np.iinfo(values.dtype).max), at)[::2]
    return out


def suffixes(strings: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, length and common prefix with the one before (at most cap) of all suffixes in order."""
    m = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    body = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(sizes)
    sid, length, common = np.arange(m), np.zeros(m, np.int64), np.zeros(m, np.uint8)
    for column in range(1, int(sizes.max(initial=0)) + 1):
        open_ = np.flatnonzero(length < sizes[sid])
        symbol = body[ends[sid[open_]] - length[open_] - 1]
        order = np.argsort(symbol, kind="stable")
        symbol, came = symbol[order], open_[order]
        sid, grown = np.concatenate([np.arange(m), sid[came]]), length[came] + 1
        new = grown == column
        old = np.zeros(len(came), np.uint8)
        old[~new] = common[m:] if column > 1 else common[:0]
        touched = np.flatnonzero((new | np.concatenate([[False], new[:-1]])) & np.concatenate([[False], symbol[1:] == symbol[:-1]]))
        first = np.concatenate([[True], symbol[1:] != symbol[:-1]]) if len(symbol) else np.empty(0, bool)
        old[first] = 0
        least = range_minima(common, came[touched - 1] + 1, came[touched] + 1)
        old[touched] = np.minimum(least.astype(np.int64) + 1, cap)
        length, common = np.concatenate([np.zeros(m, np.int64), grown]), np.concatenate([np.zeros(m, np.uint8), old])
    return sid, length, common


def least_owner(strings: list[bytes], owners: np.ndarray, size: int) -> list[np.ndarray]:
    """For each string, the least owner of each of its substrings of the size, by start."""
    sid, length, common = suffixes(strings, size)
    long_ = length >= size
    begins = np.flatnonzero((common < size) | ~long_)
    least = np.minimum.reduceat(owners[sid], begins) if len(begins) else np.empty(0, owners.dtype)
    by = np.repeat(least, np.diff(np.append(begins, len(sid))))
    out = [np.empty(max(0, len(s) - size + 1), owners.dtype) for s in strings]
    sizes = np.array([len(s) for s in strings], np.int64)
    place = np.concatenate([[0], np.cumsum(np.maximum(0, sizes - size + 1))])
    flat = np.empty(place[-1], owners.dtype)
    s, n = sid[long_], length[long_]
    flat[place[s] + sizes[s] - n] = by[long_]
    for i in range(len(strings)):
        out[i] = flat[place[i] : place[i + 1]]
    return out
