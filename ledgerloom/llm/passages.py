"""Passages repeated across documents, by column-wise suffix arrays.

A byte goes if it is covered by a ``size``-byte string that also starts in a document with a smaller
id.  To find where those strings can be without moving all suffixes of the corpus, each string of
that size is owned by its least-hashed k-mer (a minimizer): equal strings have equal owners, at the
same place in them.  A maximal run of strings with one owner is a piece of at most 2 * size - k bytes.

1. Equal texts are folded to one text with its least id; texts are dealt to buckets of about
   ``BUCKET`` bytes and written, compressed, as a table that is read three more times without being moved.
2. Five bytes of each owner's hash go to the task of its hash group, which tells the buckets which
   owners occur in more than one text, and which of them in more than ``HOT`` buckets.  (Unequal owners
   that look alike cost later work only.)
3. For these, hashes of owner and piece and the least id meet.  Where all pieces of an owner are
   equal, the least id settles all their strings.
4. Where they differ, the distinct pieces themselves meet: a collection of short strings, whose
   Burrows-Wheeler transform and common prefixes are built column by column
   (``collection_bwt``); runs of common prefixes of ``size`` give the least id of each string.
5. Buckets mark the settled and the resolved strings and cut them out.

A hot text or owner is one entry for each bucket, however many documents hold it.  Around the edges of a
hot passage each holder adds pieces of its own to the same owners; there, in more than ``HOT`` buckets,
every string of 50 bytes is an owner by itself, so that no task and no collection holds all pieces of one
owner.  Groups of owners and buckets are sized by the corpus, so a task's work stays the same when the
corpus grows.  Long texts are searched in stretches of ``STRETCH`` bytes that overlap by a string.

Nulls: a null text is empty; a null id counts as larger than all.  Texts under ``size`` bytes keep all
bytes.  Rows that share an id do not cut each other, unless their texts start in a smaller id too;
repeated rows have equal results.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytestext import SLICE, mixed, powers, prefix_sums, span_hashes
from .collection_bwt import least_owner
from .scratch import only, stage, stage_by

#: Bytes of text in a bucket; owners' hashes in a group; pieces in a collection.
BUCKET, GROUP, COLLECTION = 4 << 20, 1 << 20, 4096
#: Buckets beyond which an owner is hot; bytes of a long text that are searched at once; most parts of the table of texts.
HOT, STRETCH, PARTS = 256, 1 << 20, 50_000
SIZE, K = 50, 24
_LAST_ID = (1 << 63) - 1
_MIXED = -1  # in place of the least id: the owner's pieces differ


def owners(body: np.ndarray, offsets: np.ndarray, hot: Callable | None = None, stretch: int = STRETCH) -> tuple[np.ndarray, ...]:
    """Of each run of strings with one owner: its hash, text, first and last start, piece's hash, and place in the piece.

    hot(hashes) says which owners are hot; each of their strings is a run and an owner of its own.
    """
    found = []
    for begin in range(0, max(1, len(body) - SIZE + 1), stretch):
        end = min(len(body), begin + stretch + SIZE - 1)
        h, row, first, last, piece, inner = _owners(body[begin:end], np.clip(offsets, begin, end) - begin, hot)
        found.append((h, row, first + begin, last + begin, piece, inner))
    return found[0] if len(found) == 1 else tuple(map(np.concatenate, zip(*found)))


def _owners(body: np.ndarray, offsets: np.ndarray, hot: Callable | None, size: int = SIZE, k: int = K) -> tuple[np.ndarray, ...]:
    n = len(body)
    if n < size:
        empty = np.empty(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty, empty.astype(np.uint64), empty
    sums = prefix_sums(body)
    _, down = powers(n)
    plain = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    least, width, span = _placed(plain), size - k + 1, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[step:], least[:-step])
        span += step
    place = (least & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[: len(least)]
    whole = np.arange(size, size + len(least)) <= offsets[1:][row]
    change = np.ones(len(least), bool)
    change[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(least)) - 1
    held = whole[first]
    first, last = first[held], last[held]
    h = mixed(plain[place[first]])
    single = np.flatnonzero(hot(h)) if hot else np.empty(0, np.int64)
    if len(single):
        many = (last - first + 1)[single]
        starts = np.repeat(first[single] - np.cumsum(many) + many, many) + np.arange(many.sum())
        rest = np.delete(np.arange(len(h)), single)
        own = mixed(span_hashes(sums, starts, starts + size) ^ _SINGLE)
        h, first, last = np.concatenate([h[rest], own]), np.concatenate([first[rest], starts]), np.concatenate([last[rest], starts])
    return h, row[first].astype(np.int64), first, last, span_hashes(sums, first, last + size), place[first] - first


#: Keeps the hash of a string that is its own owner apart from those of owners.
_SINGLE = np.uint64(0x5851F42D4C957F2D)
#: The low bits of an order value are a place, the high ones a k-mer's hash: equal hashes go to the left.
_PLACE = np.uint64((1 << 26) - 1)


def _placed(hashes: np.ndarray) -> np.ndarray:
    return (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)


def _unpack(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Packed 64-bit columns of several rows, one after the other."""
    return [np.frombuffer(b"".join(x.as_py() for x in c), np.uint64) for c in columns]


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).astype("<u8", copy=False).tobytes() if a.dtype != np.int64 else np.ascontiguousarray(a).tobytes()


def _mark(h: np.ndarray, groups: int) -> np.ndarray:
    """39 bits of an owner's hash beside its group."""
    return (h // np.uint64(groups)) & np.uint64((1 << 39) - 1)


def _five(v: np.ndarray) -> bytes:
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


class _Bucket:
    """The distinct texts of a bucket, in slices small enough for the byte arrays."""

    def __init__(self, table: pa.Table) -> None:
        found: dict[bytes, list] = {}
        for row in table.select(["md5", "id", "blob"]).to_pylist():
            held = found.setdefault(row["md5"], [row["id"], None])
            held[0] = min(held[0], row["id"])
            held[1] = held[1] or row["blob"]
        self.md5, self.ids, self.blobs = list(found), np.array([x[0] for x in found.values()], np.int64), [x[1] for x in found.values()]

    def slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First text, bytes and offsets of each slice."""
        unzip, first, held, size = zstandard.ZstdDecompressor().decompress, 0, [], 0
        whole = lambda: (first, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]))
        for i, blob in enumerate(self.blobs):
            text = unzip(blob)
            if held and size + len(text) > SLICE:  # a long text stands alone, so that its stretches are the same in every pass
                yield whole()
                first, held, size = i, [], 0
            held.append(text)
            size += len(text)
        if held:
            yield whole()


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct text of a task once, compressed, with its least id."""
    least: dict[bytes, int] = {}
    zipper = zstandard.ZstdCompressor(level=3)
    schema = pa.schema([("md5", pa.binary()), ("id", pa.int64()), ("blob", pa.binary())])
    for batch in batches:
        out: list[dict] = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = (t.as_py() or "").encode()
            md5 = hashlib.md5(text, usedforsecurity=False).digest()
            if md5 not in least:
                out.append({"md5": md5, "id": i, "blob": zipper.compress(text)})
                least[md5] = i
            elif i < least[md5]:
                least[md5] = i
                out.append({"md5": md5, "id": i, "blob": None})
        yield pa.RecordBatch.from_pylist(out, schema)


def _by_group(h: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    g = (h % np.uint64(groups)).astype(np.int64)
    order = np.argsort(g, kind="stable")
    edges = np.flatnonzero(np.diff(g[order], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(order))):
        yield int(g[order[a]]), order[a:b]


def _suspects(groups: int):
    """Of each bucket: its owners, by group, with the lowest bit set where several texts have one."""

    def run(table: pa.Table) -> pa.Table:
        bucket, held, out = _Bucket(table), [], []
        for first, body, offsets in bucket.slices():
            h, row, *_ = owners(body, offsets)
            held.append(np.stack([h, (row + first).astype(np.uint64)], axis=1))
        both = np.unique(np.concatenate(held), axis=0) if held else np.empty((0, 2), np.uint64)
        begins = np.flatnonzero(np.append(True, both[1:, 0] != both[:-1, 0])) if len(both) else np.empty(0, int)
        h, several = both[begins, 0], np.diff(np.append(begins, len(both))) > 1
        marks = (_mark(h, groups) << np.uint64(1)) | several.astype(np.uint64)
        for g, at in _by_group(h, groups):
            out.append({"g": g, "bucket": table["bucket"][0].as_py(), "marks": _five(marks[at])})
        return pa.Table.from_pylist(out, pa.schema([("g", pa.int64()), ("bucket", pa.int64()), ("marks", pa.binary())]))

    return run


def _shared(most: int):
    """Of a group: which of each bucket's owners occur in more than one text, and which of these in more than so many buckets."""

    def run(table: pa.Table) -> pa.Table:
        marks = [_from_five(x.as_py()) for x in table["marks"]]
        value, place = np.concatenate(marks), np.repeat(np.arange(len(marks)), [len(m) for m in marks])
        order = np.argsort(value, kind="stable")
        plain = value[order] >> np.uint64(1)
        begins = np.flatnonzero(np.append(True, plain[1:] != plain[:-1]))
        sizes = np.diff(np.append(begins, len(plain)))
        several = np.maximum.reduceat(value[order] & np.uint64(1), begins) > 0
        kept, hot = np.repeat((sizes > 1) | several, sizes), np.repeat(sizes > most, sizes)
        at, plain, hot = place[order][kept], plain[kept], hot[kept]
        by = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[by], np.arange(len(marks) + 1))
        rows = []
        for i, b in enumerate(table["bucket"].to_pylist()):
            mine = by[edges[i] : edges[i + 1]]
            if len(mine):
                crowded = plain[mine][hot[mine]]
                rows.append({"bucket": b, "g": table["g"][0].as_py(), "marks": _five(plain[mine]), "hot": _five(crowded) if len(crowded) else None})
        return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("marks", pa.binary()), ("hot", pa.binary())]))

    return run


def _whole_marks(told: pa.Table, column: str, groups: int) -> np.ndarray:
    """The marks in a column with their groups, ascending."""
    there = told.filter(pc.is_valid(told[column]))
    parts = [_from_five(m.as_py()) * np.uint64(groups) + np.uint64(g) for g, m in zip(there["g"].to_pylist(), there[column])]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _hot_test(told: pa.Table, groups: int) -> Callable | None:
    """What tells hot owners by their hashes, if the bucket has any."""
    known = _whole_marks(told, "hot", groups)
    return (lambda h: _lookup(known, _mark(h, groups) * np.uint64(groups) + h % np.uint64(groups))[1]) if len(known) else None


def _candidates(groups: int):
    """Of each bucket: hashes of owner and piece, least id, and whether several texts have the piece."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows and told.num_rows:
            known, hot = _whole_marks(told, "marks", groups), _hot_test(told, groups)
            bucket, held = _Bucket(texts), []
            for first, body, offsets in bucket.slices():
                h, row, start, end, piece, _ = owners(body, offsets, hot)
                hit = _lookup(known, _mark(h, groups) * np.uint64(groups) + h % np.uint64(groups))[1]
                if hot:
                    hit |= start == end
                held.append((h[hit], piece[hit], bucket.ids[row[hit] + first]))
            h, piece, ids = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((ids, piece, h))
            h, piece, ids = h[order], piece[order], ids[order]
            new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (piece[1:] != piece[:-1]))) if len(h) else np.empty(0, int)
            last = ids[np.append(new[1:], len(h)) - 1] if len(h) else ids
            h, piece, least = h[new], piece[new], ids[new]
            for g, at in _by_group(h, groups):
                out.append({"g": g, "bucket": texts["bucket"][0].as_py(), "h": _pack(h[at]), "piece": _pack(piece[at]), "least": _pack(least[at]), "last": _pack(last[at])})
        kinds = [("g", pa.int64()), ("bucket", pa.int64()), *((c, pa.binary()) for c in ("h", "piece", "least", "last"))]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    return run


def _settled(table: pa.Table) -> pa.Table:
    """Of a group: the least id of each owner whose pieces are all equal, or that they differ."""
    h, piece, least, last = _unpack(*(table[c] for c in ("h", "piece", "least", "last")))
    least, last = least.view(np.int64), last.view(np.int64)
    place = np.repeat(np.arange(table.num_rows), [len(x.as_py()) // 8 for x in table["h"]])
    order = np.lexsort((piece, h))
    ho, po = h[order], piece[order]
    begins = np.flatnonzero(np.append(True, ho[1:] != ho[:-1]))
    sizes = np.diff(np.append(begins, len(ho)))
    differ = np.append(False, (po[1:] != po[:-1]) & (ho[1:] == ho[:-1]))
    many = np.repeat(np.maximum.reduceat(differ, begins), sizes)
    low, high = np.repeat(np.minimum.reduceat(least[order], begins), sizes), np.repeat(np.maximum.reduceat(last[order], begins), sizes)
    useful = np.where(many, high > low, last[order] > low)
    verdict = np.where(many, _MIXED, low)
    rows, kept = [], np.flatnonzero(useful)
    by = kept[np.argsort(place[order][kept], kind="stable")]
    edges = np.searchsorted(place[order][by], np.arange(table.num_rows + 1))
    for i, b in enumerate(table["bucket"].to_pylist()):
        at = by[edges[i] : edges[i + 1]]
        at = at[np.append(True, ho[at][1:] != ho[at][:-1])] if len(at) else at
        if len(at):
            rows.append({"bucket": b, "mixed": bool((verdict[at] == _MIXED).any()), "h": _pack(ho[at]), "least": _pack(verdict[at])})
    return pa.Table.from_pylist(rows, _VERDICTS)


_VERDICTS = pa.schema([("bucket", pa.int64()), ("mixed", pa.bool_()), ("h", pa.binary()), ("least", pa.binary())])


def _lookup(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted known values each h is, and whether it is there."""
    if not len(known):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return at, known[at] == h


def _pieces(groups: int):
    """Of each bucket: the distinct pieces of owners whose pieces differ."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        mixed_ = told.filter(pc.is_valid(told["h"]))
        if texts.num_rows and mixed_.num_rows:
            h, least = _unpack(mixed_["h"], mixed_["least"])
            known, hot = np.sort(h[least.view(np.int64) == _MIXED]), _hot_test(told, groups)
            bucket, found = _Bucket(texts), {}
            for first, body, offsets in bucket.slices():
                h, row, start, end, piece, inner = owners(body, offsets, hot)
                for i in np.flatnonzero(_lookup(known, h)[1]).tolist():
                    key, who = (int(h[i]), int(piece[i])), int(bucket.ids[row[i] + first])
                    if key in found:
                        held = found[key]
                        held[0], held[1] = min(held[0], who), max(held[1], who)
                    else:
                        found[key] = [who, who, body[start[i] : end[i] + SIZE].tobytes(), int(inner[i])]
            keys = np.array(list(found), np.uint64).reshape(-1, 2)
            held = list(found.values())
            for g, at in _by_group(keys[:, 0], groups):
                mine = [held[i] for i in at.tolist()]
                out.append(
                    {
                        "g": g,
                        "bucket": texts["bucket"][0].as_py(),
                        "h": _pack(keys[at, 0]),
                        "piece": _pack(keys[at, 1]),
                        "least": _pack(np.array([x[0] for x in mine], np.int64)),
                        "last": _pack(np.array([x[1] for x in mine], np.int64)),
                        "inner": _pack(np.array([x[3] for x in mine], np.int64)),
                        "strings": [x[2] for x in mine],
                    }
                )
        kinds = [("g", pa.int64()), ("bucket", pa.int64()), *((c, pa.binary()) for c in ("h", "piece", "least", "last", "inner")), ("strings", pa.list_(pa.binary()))]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    return run


def _may_share(strings: list[bytes], h: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Pieces that share half of what a string has beside its owner, left or right of it, with another piece.

    Two equal strings agree in SIZE - K bytes around their owner, so in half of these on one side.
    """
    half = (SIZE - K) // 2
    body, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings], np.int64)
    sums, at = prefix_sums(body), np.concatenate([[0], np.cumsum(sizes)])
    place = at[:-1] + inner
    out = np.zeros(len(strings), bool)
    for start, fits in ((place - half, inner >= half), (place + K, inner + K + half <= sizes)):
        who = np.flatnonzero(fits)
        key = span_hashes(sums, start[who], start[who] + half) ^ mixed(h[who])
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        out[who[n[back] > 1]] = True
    return out


_RUNS = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("h", "piece", "low", "high", "least"))])


def _resolved(table: pa.Table) -> pa.Table:
    """Of a group: runs of each piece's strings that also start in a smaller id than some of its bucket's."""
    h, piece, least, last, inner = _unpack(*(table[c] for c in ("h", "piece", "least", "last", "inner")))
    least, last, inner = (c.view(np.int64) for c in (least, last, inner))
    strings = [s for row in table["strings"] for s in row.as_py()]
    place = np.repeat(np.arange(table.num_rows), [len(x.as_py()) // 8 for x in table["h"]])
    order = np.lexsort((least, piece, h))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (piece[order][1:] != piece[order][:-1]))
    firsts = order[new]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    owned: list[np.ndarray] = [np.full(len(strings[i]) - SIZE + 1, least[i]) for i in firsts]
    meets = np.flatnonzero(_may_share([strings[i] for i in firsts], h[firsts], inner[firsts]))
    of = h[firsts[meets]]
    cuts = [0]
    for e in np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)).tolist():
        if e - cuts[-1] >= COLLECTION or e == len(of) > cuts[-1]:
            cuts.append(e)
    for a, b in zip(cuts, cuts[1:]):
        mine = meets[a:b]
        for i, found in zip(mine.tolist(), least_owner([strings[i] for i in firsts[mine]], least[firsts[mine]], SIZE)):
            owned[i] = found
    held: list[list[tuple]] = [[] for _ in range(table.num_rows)]
    for i in range(len(h)):
        low = owned[which[i]]
        begins = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        for a, b in zip(begins.tolist(), np.append(begins[1:], len(low)).tolist()):
            if low[a] < last[i]:
                held[place[i]].append((h[i], piece[i], a, b - 1, low[a]))
    rows = []
    for b, runs in zip(table["bucket"].to_pylist(), held):
        if runs:
            hs, ps, lo, hi, who = zip(*runs)
            rows.append({"bucket": b, "h": _pack(np.array(hs, np.uint64)), "piece": _pack(np.array(ps, np.uint64)), "low": _pack(np.array(lo, np.int64)), "high": _pack(np.array(hi, np.int64)), "least": _pack(np.array(who, np.int64))})
    return pa.Table.from_pylist(rows, _RUNS)


_CUT = "md5 binary, first bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"


def _whole_characters(gone: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Of the bytes gone, those whose character goes as a whole."""
    head = (body & 0xC0) != 0x80
    head[:1] = True
    begins = np.flatnonzero(head)
    return np.repeat(np.minimum.reduceat(gone, begins), np.diff(np.append(begins, len(body)))) if len(body) else gone


def _cut(keep_text: bool, groups: int):
    """Of each bucket: its texts with the settled and resolved strings cut out."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows:
            hot = _hot_test(told, groups)
            simple = told.filter(pc.and_(pc.is_null(told["piece"]), pc.is_valid(told["h"])))
            h, least = _unpack(simple["h"], simple["least"])
            least = least.view(np.int64)
            order = np.argsort(h, kind="stable")
            known, least = h[order], least[order]
            runs = told.filter(pc.is_valid(told["piece"]))
            rh, rp, low, high, who = _unpack(*(runs[c] for c in ("h", "piece", "low", "high", "least")))
            pair = mixed(rh) ^ rp  # owner and piece as one value
            order = np.argsort(pair, kind="stable")
            pair, (low, high, who) = pair[order], (c[order].view(np.int64) for c in (low, high, who))
            bucket = _Bucket(texts)
            for first, body, offsets in bucket.slices():
                h, row, start, end, piece, _ = owners(body, offsets, hot)
                ids = bucket.ids[row + first] if len(row) else np.empty(0, np.int64)
                edges = np.zeros(len(body) + 1, np.int32)
                at, there = _lookup(known, h)
                hit = np.flatnonzero(there)
                hit = hit[(least[at[hit]] != _MIXED) & (least[at[hit]] < ids[hit])]
                np.add.at(edges, start[hit], 1)
                np.add.at(edges, end[hit] + SIZE, -1)
                key = mixed(h) ^ piece
                a, b = np.searchsorted(pair, key), np.searchsorted(pair, key, "right")
                some = np.flatnonzero(b > a)
                many = np.repeat(some, (b - a)[some])
                j = np.arange(len(many)) - np.repeat(np.cumsum((b - a)[some]) - (b - a)[some], (b - a)[some]) + a[many]
                good = who[j] < ids[many]
                np.add.at(edges, start[many[good]] + low[j[good]], 1)
                np.add.at(edges, start[many[good]] + high[j[good]] + SIZE, -1)
                gone = np.cumsum(edges[:-1]) > 0
                for i in range(len(offsets) - 1):
                    mine, text = gone[offsets[i] : offsets[i + 1]], body[offsets[i] : offsets[i + 1]]
                    row_out = {
                        "md5": bucket.md5[first + i],
                        "first": int(bucket.ids[first + i]),
                        "n_bytes": len(text),
                        "n_removed": int(mine.sum()),
                        "n_spans": int((np.diff(mine.astype(np.int8), prepend=0) == 1).sum()),
                        "kept_sha256": hashlib.sha256(text[~mine].tobytes()).hexdigest(),
                        "kept": text[~_whole_characters(mine, text)].tobytes().decode() if keep_text and mine.any() else None,
                    }
                    out.append(row_out)
        kinds = [("md5", pa.binary()), *((c, pa.int64()) for c in ("first", "n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), ("kept", pa.string())]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    return run


def cut_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row for each distinct text: md5, first (its least id), n_bytes, n_removed, n_spans, kept_sha256, kept.

    The counts are those of the least id's row; ``kept`` (with ``keep_text``, where anything went) is what
    stays when only whole characters go.
    """
    return only(docs.sparkSession, "passage-texts", lambda: _cut_passages(docs, key, text, keep_text, hot))


def _cut_passages(docs: DataFrame, key: str, text: str, keep_text: bool, hot: int) -> DataFrame:
    whole = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = whole // BUCKET + 1
    groups = whole // (GROUP * 13) + 1
    id_ = F.coalesce(F.col(key).cast("long"), F.lit(_LAST_ID))
    texts = docs.select(id_.alias("id"), F.col(text).alias("text")).mapInArrow(_zipped, "md5 binary, id bigint, blob binary")
    texts = texts.withColumn("bucket", F.pmod(F.xxhash64("md5"), F.lit(buckets)))
    by_bucket = stage_by(texts, "passage-zipped", "bucket", min(buckets, PARTS)).groupBy("bucket")
    suspects = by_bucket.applyInArrow(_suspects(groups), "g bigint, bucket bigint, marks binary")
    shared = stage(suspects.groupBy("g").applyInArrow(_shared(hot), "bucket bigint, g bigint, marks binary, hot binary"), "passage-shared").df
    packed = "h binary, piece binary, least binary, last binary"
    candidates = by_bucket.cogroup(shared.groupBy("bucket")).applyInArrow(_candidates(groups), f"g bigint, bucket bigint, {packed}")
    settled = stage(candidates.groupBy("g").applyInArrow(_settled, "bucket bigint, mixed boolean, h binary, least binary"), "passage-owners").df
    crowded = shared.where("hot IS NOT NULL")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    told = settled.where("mixed").select("bucket", "h", "least", *none("bigint", "g"), *none("binary", "hot"))
    told = told.union(crowded.select("bucket", *none("binary", "h", "least"), "g", "hot"))
    pieces = by_bucket.cogroup(told.groupBy("bucket")).applyInArrow(_pieces(groups), f"g bigint, bucket bigint, {packed}, inner binary, strings array<binary>")
    runs = stage(pieces.groupBy("g").applyInArrow(_resolved, "bucket bigint, h binary, piece binary, low binary, high binary, least binary"), "passage-runs").df
    told = settled.select("bucket", "h", *none("binary", "piece", "low", "high"), "least", *none("bigint", "g"), *none("binary", "hot"))
    told = told.union(runs.select("bucket", "h", "piece", "low", "high", "least", *none("bigint", "g"), *none("binary", "hot")))
    told = told.union(crowded.select("bucket", *none("binary", "h", "piece", "low", "high", "least"), "g", "hot"))
    return by_bucket.cogroup(told.groupBy("bucket")).applyInArrow(_cut(keep_text, groups), _CUT)


def dedup_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    cut = cut_passages(docs, key, text)
    rows = docs.select(F.col(key).alias("key"), F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))).alias("md5"))
    rows = rows.withColumn("id", F.coalesce(F.col("key").cast("long"), F.lit(_LAST_ID)))
    copy = (F.col("id") > F.col("first")) & (F.col("n_bytes") >= SIZE)
    return rows.join(cut, "md5").select(
        F.col("key").alias(key),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
