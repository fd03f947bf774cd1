"""Byte-pair encoding and decoding: the words of a task's texts are encoded together, in a trie.

A prefix of a word has one encoding, and only its last token matters for what follows: the encoding of a
longer prefix ends in the one token t, a suffix of it, whose border with the last token of what is before
t stands, that is, no merge ever joins across it.  So each node of a trie has one state, its last token,
found from its ancestors' states; a depth-first walk computes the states of a shared prefix once for all
words under it, and a word's ids are read off backwards.  Whether a border stands is decided by the pieces
that its two tokens go through while they are merged, and remembered for each pair of tokens.

Texts are cut at white space, each distinct word is normalized and cut further as the vocabulary's file
says (by the tokenizers library's own parts, or a pattern for plain words), and added tokens are taken
out of it first.  The pieces that a task does not know go into a trie, for each slice of about a megabyte;
a worker keeps words' ids up to ``HELD`` bytes and then begins anew, so its memory is bounded and nothing depends
on how often a word comes.  Encoding and decoding are one pass each and shuffle nothing.

Nulls: a null text is an empty one and has no ids; null ids decode to an empty text; a null key is kept.  Repeated
rows each have a result.  An id that the vocabulary does not have is skipped by decode.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .bytestext import slices
from .packing import _PARTS, _PLAIN, _byte_letters, _words

#: Bytes of text in a slice; bytes of words and ids that a worker keeps; borders that it remembers.
PART, HELD, BORDERS = 1 << 20, 128 << 20, 1_000_000
#: Bytes that a table's entry has beside its letters and ids.
ENTRY, _SWAP = 180, sys.byteorder == "big"
_NEVER = 1 << 62
#: Letters of an ending by which the lengths of possible last tokens are known, and the lengths below it.
ENDING, _SHORT = 3, (2, 1)


class Vocabulary:
    """Tokens and merges of a vocabulary file, and what a border between two tokens does."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            self.file = json.load(file)
        model = self.file["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain byte-pair models are read")
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.made: dict[int, tuple[int, int, int]] = {}  # token: the rank of the merge that makes it, and its halves
        self.ranks: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = self.ids[a], self.ids[b]
            self.ranks[pair] = rank
            if self.made.setdefault(self.ids[a + b], (rank, *pair)) != (rank, *pair):
                raise ValueError("a token has two merges")
        self.edges: tuple[dict, dict] = {}, {}
        self.stands: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        usable = {t: i for t, i in self.ids.items() if self.is_whole(i)}
        self.inner = _by_ending({t: i for t, i in usable.items() if not self.end or not t.endswith(self.end)})
        self.final = _by_ending({t.removesuffix(self.end): i for t, i in usable.items() if t.endswith(self.end)}) if self.end else self.inner
        self.added: dict[str, int] = {}
        for token in self.file.get("added_tokens", []):
            if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"]:
                raise ValueError("added tokens that take in what is around them are not read")
            self.added[token["content"]] = token["id"]
        size = 1 + max([*self.ids.values(), *self.added.values()])
        self.texts: list[str | None] = [None] * size
        for text, i in [*self.ids.items(), *self.added.items()]:
            self.texts[i] = text

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The pieces at one edge of a token while it is made, each with the rank of the merge that ends it."""
        found = self.edges[right].get(token)
        if found is None:
            found, at, until = [], token, _NEVER
            while True:
                found.append((at, until))
                if at not in self.made:
                    break
                until = self.made[at][0]
                at = self.made[at][2 if right else 1]
            found.reverse()
            self.edges[right][token] = found
        return found

    def crossed(self, left: int, right: int) -> int | None:
        """The rank of the first merge across the border of two tokens, both made whole on their own; None if there is none.

        Of merges of one rank the leftmost comes first, so the left piece's own merge wins a tie and the right one's loses it.
        """
        a, b = self.edge(left, True), self.edge(right, False)
        i = j = 0
        while i < len(a) and j < len(b):
            (x, x_ends), (y, y_ends) = a[i], b[j]
            rank = self.ranks.get((x, y), _NEVER)
            if rank < x_ends and rank <= y_ends and rank != _NEVER:
                return rank
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
        return None

    def is_whole(self, token: int) -> bool:
        """Whether merging the token's own text gives the token."""
        found = self.whole.get(token)
        if found is None:
            if token in self.made:
                rank, a, b = self.made[token]
                found = self.is_whole(a) and self.is_whole(b) and self.crossed(a, b) == rank
            else:
                found = True
            self.whole[token] = found
        return found

    def follows(self, border: int) -> bool:
        """Whether the border of two tokens (left << 32 | right) stands; remembered."""
        if len(self.stands) >= BORDERS:
            self.stands.clear()
        found = self.stands[border] = self.crossed(border >> 32, border & 0xFFFFFFFF) is None
        return found

    def last(self, path: str, n: int, states: array, final: bool = False) -> tuple[int, int]:
        """The last token of the first n letters of a path, and its length, from the states of what is before it."""
        tokens, sizes = self.final if final else self.inner
        stands = self.stands
        for size in sizes.get(path[n - ENDING : n], _SHORT) if n >= ENDING else range(n, 0, -1):
            token = tokens.get(path[n - size : n]) if size <= n else None
            if token is not None:
                if size == n:
                    return token, size
                border = states[n - size] << 32 | token
                found = stands.get(border)
                if found is None:
                    found = self.follows(border)
                if found:
                    return token, size
        raise KeyError(f"the vocabulary has no token for {path[n - 1]!r}")


def _by_ending(tokens: dict[str, int]) -> tuple[dict[str, int], dict[str, tuple[int, ...]]]:
    """Tokens, and for each ending of ENDING letters the lengths, falling, that tokens with this ending can have."""
    sizes: dict[str, set[int]] = {}
    for token in tokens:
        if len(token) >= ENDING:
            sizes.setdefault(token[-ENDING:], set(_SHORT)).add(len(token))
    return tokens, {ending: tuple(sorted(held, reverse=True)) for ending, held in sizes.items()}


class Trie:
    """A trie of distinct words, kept as the words in order and the letters that each shares with the one before.

    That is the trie in depth-first order: a word's nodes are its prefixes, those that it shares with the word before it
    are there already, and the others come with it.
    """

    def __init__(self, words: Iterable[str] = ()) -> None:
        self.words = sorted(set(words))
        self.shared = array("I", [0])
        for before, word in zip(self.words, self.words[1:]):
            n, most = 0, min(len(before), len(word))
            while n < most and before[n] == word[n]:
                n += 1
            self.shared.append(n)

    def encoded(self, vocabulary: Vocabulary) -> Iterator[tuple[str, array]]:
        """Each word and its ids, in one depth-first walk; a state is a last token and its length.

        A node's state is computed once it is needed: a word's last letter has one of its own, as the word ends there.
        """
        states, sizes, last = array("i", [-1]), array("H", [0]), vocabulary.last
        for word, shared in zip(self.words, self.shared):
            del states[shared + 1 :], sizes[shared + 1 :]
            for n in range(len(states), len(word)):
                token, size = last(word, n, states)
                states.append(token)
                sizes.append(size)
            token, size = last(word, len(word), states, True)
            ids, at = array("I", [token]), len(word) - size
            while at:
                ids.append(states[at])
                at -= sizes[at]
            ids.reverse()
            yield word, ids


#: Fixed: normalizer and pre-tokenizer of vocabularies whose words white space separates and no id shows.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]


def _known(file: dict) -> bool:
    """Whether the file cuts words as ``_PLAIN`` and ``_PARTS`` do, and joins tokens by a space."""
    normal, cut = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    split, level = [*cut.get("pretokenizers", []), {}, {}][:2]
    return (
        [n["type"] for n in normal.get("normalizers", [])] == _NORMAL
        and split.get("pattern") == {"Regex": _SPLIT}
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
        and not file.get("decoder")
    )


class Encoder:
    """A worker's words and pieces with their ids as little-endian bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.vocabulary, self.parts = _vocabulary(path), Tokenizer.from_file(path)
        if not _known(self.vocabulary.file):
            raise ValueError("only vocabularies of words that white space separates are read")
        self.letters = _byte_letters()
        self.added = re.compile("(" + "|".join(map(re.escape, self.vocabulary.added)) + ")") if self.vocabulary.added else None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        """Begins anew; added tokens are pieces with a blank before them, which no other piece has."""
        self.words.clear()
        self.pieces.clear()
        self.pieces.update({f" {t}": i.to_bytes(4, "little") for t, i in self.vocabulary.added.items()})
        self.held = 0

    def cut(self, word: str) -> list[str]:
        """The pieces of a word in byte letters."""
        if _PLAIN.fullmatch(word) and "<|" not in word:
            found = _PARTS.findall(word.lower())
            return found if word.isascii() else [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in found]
        out: list[str] = []
        for k, part in enumerate(self.added.split(word) if self.added else [word]):
            if k % 2:
                out.append(f" {part}")
            elif part:
                out += [p for p, _ in self.parts.pre_tokenizer.pre_tokenize_str(self.parts.normalizer.normalize_str(part))]
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Adds the ids of new words: what is new of their pieces goes into one trie."""
        new, known = [(w, self.cut(w)) for w in words], self.pieces
        unknown = {p for _, pieces in new for p in pieces}.difference(known)
        for piece, ids in Trie(unknown).encoded(self.vocabulary):
            if _SWAP:
                ids.byteswap()
            known[piece] = ids.tobytes()
            self.held += len(piece) + 4 * len(ids)
        for word, pieces in new:
            self.words[word] = found = known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces])
            self.held += len(word) + len(found)
        self.held += ENTRY * (len(unknown) + len(new))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.held > HELD:
            self.forget()
        cut = [_words(t or "") for t in texts]
        self.learn(set(chain.from_iterable(cut)).difference(self.words))
        of = self.words.__getitem__
        return [b"".join(map(of, words)) for words in cut]


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One a Python worker, kept from task to task."""
    return Encoder(path)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for part in slices(batch, size=PART):
                ids = encoder.encode(part.column(1).to_pylist())
                n = pa.array([len(i) // 4 for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _vocabulary(path).texts
        known = np.array([t is not None for t in texts])
        for batch in batches:
            for part in slices(batch, size=PART):
                out = []
                for value in part.column(1):
                    ids = np.frombuffer(value.as_py() or b"", "<u4")
                    ids = ids[ids < len(texts)]
                    out.append(" ".join(map(texts.__getitem__, ids[known[ids]].tolist())))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["row", "text"])

    return run


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (little-endian unsigned 32-bit integers) of each row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_encoded(vocabulary), f"key {kind}, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The other columns of each row, and its tokens as the vocabulary writes them, with a space between two."""
    rest = encoded.drop(ids)
    rows = encoded.select(F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("row"), F.col(ids).alias("ids"))
    done = rows.mapInArrow(_decoded(vocabulary), StructType([rows.schema["row"], StructField("text", StringType())]))
    return done.select("row.*", F.col("text").alias(out))
