"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece of text starts as one token per byte. A leaf of the tree holds the rank of the pair that
starts at its position, joined with the position, so the root is the leftmost pair of least rank.
A merge changes three leaves - the pair itself, the pair to its left, and the one that vanished -
each in log2(length) steps along live neighbours. Short pieces of a batch are worked on together,
one tree per row of an array; long pieces one by one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from convoy.llm.common import Shared

#: Pieces up to this many bytes share an array of trees.
TOGETHER = 64
#: Distinct pieces whose ids a worker remembers.
REMEMBERED = 150_000
NONE = np.int64(1 << 60)
MARKS = ".,;:!?|*$%&#"
#: A pattern that splits these so takes a word and the marks behind it as one piece each.
PLAIN = ((" Ab,", [" Ab", ","]), ("é!!", ["é", "!!"]), (" ß" + MARKS, [" ß", MARKS]))
DOUBLE_SPACE = re.compile(r"\s\s").search
CUT = re.compile(r"(?<=\S)(?= \S)").split


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    return ((key * np.int64(0x9E3779B97F4A7C1)) >> 20) & (slots - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BytePairEncoder:
    """Encodes pieces of text and decodes ids by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.plain = all(self.find(x) == y for x, y in PLAIN)
        self.tokens = dict(zip(ranks.values(), ranks, strict=True))
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {
            (ranks[t[:i]] << 32) | ranks[t[i:]]: r
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        self.pairs = pairs
        self.slots = 4 << len(pairs).bit_length()
        self.slot_keys = np.full(self.slots, -1, np.int64)
        self.slot_ranks = np.full(self.slots, NONE, np.int64)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for key, at in zip(keys.tolist(), _slot(keys, self.slots).tolist(), strict=True):
            while self.slot_keys[at] >= 0:
                at = (at + 1) & (self.slots - 1)
            self.slot_keys[at], self.slot_ranks[at] = key, pairs[key]
        self.known: dict[str, bytes] = {}  # pieces
        self.words: dict[str, bytes] = {}  # stretches between single spaces, each with the space before it

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair by open addressing in a table that is at most a quarter full."""
        key = (left << 32) | right
        at = _slot(key, self.slots)
        found = self.slot_keys.take(at)
        rank = np.where(found == key, self.slot_ranks.take(at), NONE)
        again = np.flatnonzero((found != key) & (found >= 0))
        while len(again):
            at = (at.take(again) if len(at) != len(again) else at) + 1 & (self.slots - 1)
            found = self.slot_keys.take(at)
            hit = found == key[again]
            rank[again[hit]] = self.slot_ranks.take(at[hit])
            more = ~hit & (found >= 0)
            again, at = again[more], at[more]
        return rank

    def _merge_together(self, words: list[bytes], width: int) -> list[bytes]:
        """Words of at most ``width`` bytes, a power of two: one tree per word, merged in step.

        The arrays are flat; ``at`` holds each live word's offset. One column past the last byte
        stands for "nothing on this side".
        """
        n, shift, wide = len(words), width.bit_length() - 1, width + 1
        size = np.fromiter(map(len, words), np.int64, n)
        live = np.arange(width) < size[:, None]
        ids = np.full((n, wide), -1, np.int64)
        ids[:, :width][live] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((n, 2 * width), NONE, np.int64)
        ranks = self._rank(ids[:, :width].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        tree[:, width:] = np.where(ranks < NONE, (ranks << shift) | np.arange(width), NONE)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        after = np.tile(np.arange(1, wide + 1), (n, 1))
        after[np.arange(n), size - 1] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        before[:, 0] = width
        ids, tree, after, before = ids.ravel(), tree.ravel(), after.ravel(), before.ravel()
        row = np.arange(n)
        while True:
            best = tree.take(row * (2 * width) + 1)
            more = best < NONE
            row, best = row[more], best[more]
            if not len(row):
                break
            at, top = row * wide, row * (2 * width)
            i, merged = best & (width - 1), best >> shift
            j = after.take(at + i)
            k = after.take(at + j)
            p = before.take(at + i)
            ids[at + i], ids[at + j], after[at + i], before[at + k] = merged, -1, k, i
            right = self._rank(merged, ids.take(at + k))
            left = self._rank(ids.take(at + p), merged)
            tree[top + width + j] = NONE
            tree[top + width + i] = np.where(right < NONE, (right << shift) | i, NONE)
            p = np.where(p < width, p, i)
            tree[top + width + p] = np.where(left < NONE, (left << shift) | p, tree.take(top + width + p) * (p == i) + NONE * (p != i))
            nodes = [i + width, j + width, p + width]
            while width > 1 and nodes[0][0] > 1:
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    under = top + 2 * x
                    tree[top + x] = np.minimum(tree.take(under), tree.take(under + 1))
        left = ids.reshape(n, wide)[:, :width]
        counts = (left >= 0).sum(1)
        flat = left[left >= 0].astype("<u4").tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_alone(self, word: bytes) -> bytes:
        """The same for one long word, whose tree is a flat list."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        shift = width.bit_length() - 1
        none, pairs = int(NONE), self.pairs
        ids = [*self.byte_id[np.frombuffer(word, np.uint8)].tolist(), -1]
        after, before = [*range(1, n + 1), n], [*range(-1, n)]
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = pairs.get((ids[i] << 32) | ids[i + 1])
            if r is not None:
                tree[width + i] = (r << shift) | i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            i, merged = tree[1] & (width - 1), tree[1] >> shift
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i], before[k] = merged, -1, k, i
            changed = [(j, -1, -1), (i, merged, ids[k] if k < n else -1)]
            if before[i] >= 0:
                changed.append((before[i], ids[before[i]], merged))
            for at, left, right in changed:
                r = pairs.get((left << 32) | right) if left >= 0 and right >= 0 else None
                node = width + at
                tree[node] = none if r is None else (r << shift) | at
                while node > 1:
                    node >>= 1
                    a, b = tree[2 * node], tree[2 * node + 1]
                    tree[node] = a if a < b else b
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _learn(self, pieces: set[str]) -> None:
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > TOGETHER:
                self.known[piece] = self._merge_alone(raw)
            else:
                groups.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for width, group in groups.items():
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                self.known.update(zip((p for p, _ in part), self._merge_together([raw for _, raw in part], width), strict=True))

    def _stretches(self, text: str) -> list[str]:
        """The text cut before every space that stands alone between other characters.

        No piece has a space after another character, so pieces never cross such a cut and a
        stretch is encoded alike wherever it occurs.
        """
        if DOUBLE_SPACE(text):
            return CUT(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)] if first else [" " + x for x in rest]

    def _pieces(self, stretch: str) -> list[str]:
        """Matches of the pattern; a word with plain marks behind it needs no search."""
        word = stretch.rstrip(MARKS)
        if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()) and self.plain:
            return [word, stretch[len(word) :]] if len(word) < len(stretch) else [word]
        return self.find(stretch)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text is empty."""
        split = [self._stretches(t) if t else [] for t in texts]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(chain.from_iterable(split)).difference(self.words))
        pieces = list(map(self._pieces, new))
        self._learn(set(chain.from_iterable(pieces)).difference(self.known))
        find = self.known.__getitem__
        self.words.update(zip(new, [b"".join(map(find, x)) for x in pieces], strict=True))
        return [b"".join(map(self.words.__getitem__, x)) for x in split]

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that the ids stand for; null is empty."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


class Codec:
    """Column functions for one vocabulary file; its ranks go to the executors once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = Shared(spark, read_ranks(path))

        def encoder() -> BytePairEncoder:
            return ranks.built(lambda value: BytePairEncoder(value, pattern))

        @F.arrow_udf("binary")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield pa.array(encoder().encode(texts.to_pylist()), pa.binary())

        @F.arrow_udf("binary")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for ids in batches:
                yield pa.array([encoder().decode(x) for x in ids.to_pylist()], pa.binary())

        self._encode, self._decode = encode, decode

    def ids(self, text: str | Column) -> Column:
        """Ids of a text column, packed as little-endian unsigned 32-bit integers."""
        return self._encode(text)

    def bytes_of(self, ids: str | Column) -> Column:
        """The bytes that packed ids stand for."""
        return self._decode(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (packed), decoded (bytes, equal to the text's UTF-8).

    Each match of ``pattern`` is encoded on its own and no special tokens exist. A null or empty text
    has no tokens; other columns are neither read nor returned; repeated rows are each encoded.
    No shuffle: a row's work depends on that row alone.
    """
    codec = Codec(docs.sparkSession, path, pattern)
    coded = docs.select("doc_id", codec.ids("text").alias("ids"))
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", codec.bytes_of("ids").alias("decoded")
    )
