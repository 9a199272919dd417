"""Removal of repeated byte strings: a sorted sample of suffixes from which all others are induced.

Every string of LENGTH bytes has an anchor, the GRAM bytes in it with the least hash (the first of equals), so
equal strings have equal anchors at equal places. Anchors are the sampled suffixes, one in fourteen
bytes. Shards of documents send them, packed, to buckets that tell which occur in several documents;
for those alone the bytes around them are sent, once per shard and content, to the bucket of the anchor. There
the strings they stand in are ordered, the least doc_id of each distinct string is found, and the
answer goes back as runs of strings, from which each shard induces the bytes to remove. An anchor that
occurs more than HOT times may have as many contents; its strings are sent singly, each to the bucket of its
own hash, once per shard. Shards and buckets are groups of a Spark shuffle, sized in bytes, so any number
of them fits bounded tasks.

This replaces the induced sorting of all suffixes through disk-backed queues; see the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from convoy.llm.common import mix, text_key

#: Bytes of a repeated string and of an anchor in it.
LENGTH, GRAM = 50, 24
#: Bytes of documents in a shard, and bytes hashed at a time.
SHARD_BYTES, CHUNK = 8 << 20, 1 << 18
#: Occurrences up to which an anchor's contents meet in its bucket; they are rounded up to powers of two per shard.
HOT = 4096
#: Order of a null doc_id: after all others.
LAST = (1 << 63) - 1

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LOW = np.uint64((1 << 20) - 1)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _doubled(data: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Hashes of the 1, 2, 4, ... ``most`` bytes from each place on."""
    power = {1: _TABLE.take(data)}
    with np.errstate(over="ignore"):
        for k in range(most.bit_length() - 1):
            h = power[1 << k]
            power[2 << k] = h[: max(len(h) - (1 << k), 0)] * _ODD[k] + h[1 << k :]
    return power


def _join(left: np.ndarray, right: np.ndarray, at: int, by: np.uint64) -> np.ndarray:
    m = max(min(len(left), len(right) - at), 0)
    with np.errstate(over="ignore"):
        return left[:m] * by + right[at : at + m]


def _filled(h: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([mix(h), np.zeros(n - len(h), np.uint64)])


def gram_hashes(power: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Hashes of the GRAM (16 + 8) bytes from each of n places on, 0 where they do not fit."""
    return _filled(_join(power[16], power[8], 16, _ODD[1]), n)


def whole_hashes(power: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Hashes of the LENGTH (32 + 16 + 2) bytes from each of n places on, 0 where they do not fit."""
    return _filled(_join(_join(power[32], power[16], 32, _ODD[2]), power[2], 48, _ODD[3]), n)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` neighbours from each place on; places too near the end see fewer."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out, np.concatenate([out[step:], np.full(step, NONE)]))
        have += step
    return out


class Chunk:
    """Pieces of documents end to end: their bytes, anchors, and the run of strings each anchor stands for.

    An anchor's run is ``first`` to ``last``, the places where its strings begin; ``gram`` is its
    hash, and ``content`` names the bytes from the first string to the end of the last.
    After ``split`` the strings of hot anchors are runs of their own.
    """

    def __init__(self, pieces: list[tuple[int, int, bytes]], named: bool = True):
        self.pieces = pieces
        size = np.array([len(p[2]) for p in pieces], np.int64)
        self.ends = np.cumsum(size)
        self.data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        place = np.arange(len(self.data))
        left = np.repeat(self.ends, size) - place
        power = _doubled(self.data, 32 if named else 16)
        gram = gram_hashes(power, len(place))
        key = (gram & ~_LOW) | place.astype(np.uint64)
        key[left < GRAM] = NONE
        begins = np.flatnonzero(left >= LENGTH)
        anchor = (sliding_min(key, LENGTH - GRAM + 1)[begins] & _LOW).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(begins) else np.zeros(0, np.int64)
        self.first = begins[at]
        self.last = begins[np.append(at[1:], len(begins)) - 1] if len(at) else at
        self.gram = gram[anchor[at]]
        if named:
            self.whole = whole_hashes(power, len(place))
            self._name()
        self.owner = np.repeat(np.array([p[0] for p in pieces], np.int64), size)[self.first]

    def _name(self) -> None:
        with np.errstate(over="ignore"):
            edge = self.whole[self.first] * _ODD[0] + self.whole[self.last] * _ODD[4]
            self.content = mix(edge + (self.last - self.first).astype(np.uint64)).view(np.int64)

    def split(self, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Cuts the runs of ``hot`` anchors (sorted keys) into single strings; the bucket and the anchor's key of each run."""
        bucket, name = _place(self.gram, buckets)
        key = bucket << 32 | name
        if not len(hot):
            return bucket, key
        many = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        n = np.where(many, self.last - self.first + 1, 1)
        run = np.repeat(np.arange(len(n)), n)
        first = self.first[run] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        single = many[run]
        self.first, self.last, self.owner = first, np.where(single, first, self.last[run]), self.owner[run]
        self._name()
        return np.where(single, _place(self.whole[first], buckets)[0], bucket[run]), key[run]


def chunks_of(texts: list[bytes], named: bool = True) -> Iterator[Chunk]:
    """Documents in order, cut where they are long; a piece repeats the bytes a string across the cut needs."""
    held: list[tuple[int, int, bytes]] = []
    total = 0
    for doc, raw in enumerate(texts):
        for start in range(0, len(raw) - LENGTH + 1, CHUNK):
            held.append((doc, start, raw[start : start + CHUNK + LENGTH - 1]))
            total += len(held[-1][2])
            if total >= CHUNK:
                yield Chunk(held, named)
                held, total = [], 0
    if held:
        yield Chunk(held, named)


def _shard(rows: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Texts of a shard as bytes and the order of their documents, sorted so that every pass sees the same."""
    rows = rows.sort_by([("doc_id", "ascending"), ("key", "ascending")])
    return [(t or "").encode() for t in rows["text"].to_pylist()], rows["doc_id"].fill_null(LAST).to_numpy()


def _blobs(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """The arrays' rows of each bucket, packed; rows must be sorted by bucket."""
    if not len(bucket):
        return
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(at, [*at[1:], len(bucket)], strict=True):
        yield int(bucket[a]), [x[a:b].tobytes() for x in arrays]


def _joined(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Packed rows of a column end to end, and the length of each."""
    rows = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return (np.concatenate(rows) if rows else np.zeros(0, dtype)), np.array([len(x) for x in rows], np.int64)


def _place(gram: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit name of an anchor; names that coincide only send needless bytes."""
    return ((gram >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (gram & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _table(rows: list, names: list[str], types: list) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def anchor_names(rows: pa.Table, buckets: int) -> pa.Table:
    """Of a shard: for each bucket the names of its anchors, and a byte that tells how often each occurs.

    The byte's high bit says in several documents; the others are the power of two that the occurrences do not exceed.
    """
    texts, order = _shard(rows)
    found = [(np.int64(1 << 32) * bucket + name, order[c.owner]) for c in chunks_of(texts, False) for bucket, name in [_place(c.gram, buckets)]]
    key = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    doc = np.concatenate([f[1] for f in found]) if found else key
    # documents come in order, and a stable sort leaves them so within a name
    by = np.argsort(key, kind="stable")
    key, doc = key[by], doc[by]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else by
    several = doc[at] != doc[np.append(at[1:], len(doc)) - 1] if len(at) else np.zeros(0, bool)
    times = np.ceil(np.log2(np.diff(np.append(at, len(key))))).astype(np.uint8)
    bucket, name = key[at] >> 32, (key[at] & 0xFFFFFFFF).astype(np.uint32)
    shard = rows["shard"][0].as_py()
    out = [(b, shard, *blobs) for b, blobs in _blobs(bucket, name, several.astype(np.uint8) << 7 | times)]
    return _table(out, ["bucket", "shard", "names", "times"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])


def repeated_names(rows: pa.Table) -> pa.Table:
    """Of a bucket: for each shard its anchors that occur in several documents, here or elsewhere, and which are hot."""
    names, size = _joined(rows["names"], np.uint32)
    times, _ = _joined(rows["times"], np.uint8)
    value, place, count = np.unique(names, return_inverse=True, return_counts=True)
    many = count > 1
    many[place[times >= 128]] = True
    hot = np.bincount(place, np.exp2(times & 127), len(value)) > HOT
    chosen = many[place]
    out = []
    bucket, end = rows["bucket"][0].as_py(), np.cumsum(size)
    for shard, b, n in zip(rows["shard"].to_pylist(), end.tolist(), size.tolist(), strict=True):
        mine = np.flatnonzero(chosen[b - n : b]) + b - n
        if len(mine):
            out.append((shard, bucket, names[mine].tobytes(), hot[place[mine]].astype(np.uint8).tobytes()))
    return _table(out, ["shard", "bucket", "names", "hot"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])


def contents(rows: pa.Table, repeated: pa.Table, buckets: int) -> pa.Table:
    """Of a shard: the bytes around its repeated anchors, each content once with its least document.

    The keys of its hot anchors go to the bucket with the shard's number, which hands them back for ``cut``.
    """
    if not rows.num_rows or not repeated.num_rows:
        return _table([], CONTENT_NAMES, CONTENT_TYPES)
    texts, order = _shard(rows)
    names, size = _joined(repeated["names"], np.uint32)
    wanted = np.repeat(np.array(repeated["bucket"].to_pylist(), np.int64), size) << 32 | names
    hot = np.sort(wanted[_joined(repeated["hot"], np.uint8)[0] == 1])
    wanted = np.sort(wanted)
    parts = []
    for c in chunks_of(texts):
        bucket, key = c.split(hot, buckets)
        at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)
        # within the chunk each content once already, with its first and last document
        by = at[np.argsort(c.content[at], kind="stable")]
        new = np.flatnonzero(np.concatenate([[True], c.content[by][1:] != c.content[by][:-1]])) if len(by) else by
        one = by[new]
        last = order[c.owner[by[np.append(new[1:], len(by)) - 1]]] if len(by) else np.zeros(0, np.int64)
        length = c.last[one] - c.first[one] + LENGTH
        start = np.cumsum(length) - length
        body = c.data[np.repeat(c.first[one] - start, length) + np.arange(length.sum())]
        parts.append((bucket[one], c.content[one], order[c.owner[one]], last, length, body))
    bucket, content, low, high, length, body = (np.concatenate([p[k] for p in parts]) for k in range(6))
    start = np.cumsum(length) - length
    by = np.argsort(content, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], content[by][1:] != content[by][:-1]])) if len(by) else by
    one = by[new]
    if not len(one):
        return _table([], CONTENT_NAMES, CONTENT_TYPES)
    several = (np.maximum.reduceat(high[by], new) != low[one]).astype(np.uint8)
    to_bucket = np.argsort(bucket[one], kind="stable")
    one, several = one[to_bucket], several[to_bucket]
    length = length[one]
    place = np.cumsum(length) - length
    body = body[np.repeat(start[one] - place, length) + np.arange(length.sum())]
    shard, out, at = rows["shard"][0].as_py(), [], 0
    for b, blobs in _blobs(bucket[one], content[one], low[one], several, (length - LENGTH).astype(np.uint8)):
        n = len(blobs[3])
        stop = int(length[at : at + n].sum()) + int(place[at])
        out.append((b, shard, *blobs, body[int(place[at]) : stop].tobytes(), b""))
        at += n
    if len(hot):
        out.append((shard, shard, *[b""] * 5, hot.tobytes()))
    return _table(out, CONTENT_NAMES, CONTENT_TYPES)


CONTENT_NAMES = ["bucket", "shard", "content", "doc", "several", "more", "body", "hot"]
CONTENT_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 6]


def earliest(rows: pa.Table) -> pa.Table:
    """Of a bucket: runs of strings in contents with the least document that has them.

    Left out are runs for which the shard that sent the content has no later document.
    Keys of hot anchors go back as they came.
    """
    back = [(s, *[b""] * 4, hot) for s, hot in zip(rows["shard"].to_pylist(), rows["hot"].to_pylist(), strict=True) if hot]
    content, size = _joined(rows["content"], np.int64)
    doc, _ = _joined(rows["doc"], np.int64)
    several, _ = _joined(rows["several"], np.uint8)
    more, _ = _joined(rows["more"], np.uint8)
    body, _ = _joined(rows["body"], np.uint8)
    strings = more.astype(np.int64) + 1
    length = strings + LENGTH - 1
    start, place = np.cumsum(length) - length, np.cumsum(strings) - strings
    offset = np.arange(strings.sum()) - np.repeat(place, strings)
    h = np.empty(len(offset), np.uint64)
    cuts = np.searchsorted(start, np.arange(CHUNK, len(body) + CHUNK, CHUNK))  # contents that begin in each stretch
    for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
        if a < b:
            part = body[start[a] : start[b - 1] + length[b - 1]]
            whole = whole_hashes(_doubled(part, 32), len(part))
            x, y = place[a], place[b - 1] + strings[b - 1]
            h[x:y] = whole[np.repeat(start[a:b] - start[a], strings[a:b]) + offset[x:y]]
    owner = np.repeat(np.arange(len(content)), strings)
    by = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]])) if len(by) else by
    least = np.empty(len(h), np.int64)
    if len(by):
        least[by] = np.repeat(np.minimum.reduceat(doc[owner[by]], new), np.diff(np.append(new, len(by))))
    use = np.flatnonzero((least < doc[owner]) | (several[owner] == 1))
    if not len(use):
        return _table(back, RUN_NAMES, RUN_TYPES)
    # neighbours in one content with one least document are a run
    cut = (use[1:] != use[:-1] + 1) | (owner[use[1:]] != owner[use[:-1]]) | (least[use[1:]] != least[use[:-1]])
    a = np.flatnonzero(np.concatenate([[True], cut]))
    b = np.append(a[1:], len(use)) - 1
    head, tail = use[a], use[b]
    shard = np.repeat(np.array(rows["shard"].to_pylist(), np.int64), size)[owner[head]]
    by = np.argsort(shard, kind="stable")
    arrays = (content[owner[head]], offset[head].astype(np.uint8), offset[tail].astype(np.uint8), least[head])
    out = [(s, *blobs, b"") for s, blobs in _blobs(shard[by], *(x[by] for x in arrays))]
    return _table(back + out, RUN_NAMES, RUN_TYPES)


RUN_NAMES = ["shard", "content", "from", "to", "doc", "hot"]
RUN_TYPES = [pa.int32(), *[pa.binary()] * 5]


def cut(rows: pa.Table, runs: pa.Table, buckets: int) -> pa.Table:
    """Of a shard: every document without the bytes of strings that begin in an earlier document."""
    if not rows.num_rows:
        return _table([], CUT_NAMES, CUT_TYPES)
    texts, order = _shard(rows)
    content, start, stop, doc = (_joined(runs[c], t)[0] for c, t in zip(RUN_NAMES[1:5], (np.int64, np.uint8, np.uint8, np.int64), strict=True))
    by = np.argsort(content, kind="stable")
    content, start, stop, doc = content[by], start[by].astype(np.int64), stop[by].astype(np.int64), doc[by]
    hot = np.sort(_joined(runs["hot"], np.int64)[0])
    gone: dict[int, np.ndarray] = {}
    for c in chunks_of(texts) if len(content) else ():
        c.split(hot, buckets)
        a, b = np.searchsorted(content, c.content), np.searchsorted(content, c.content, "right")
        n = b - a
        anchor = np.repeat(np.arange(len(n)), n)
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        later = doc[run] < order[c.owner[anchor]]
        anchor, run = anchor[later], run[later]
        if not len(run):
            continue
        change = np.zeros(len(c.data) + 1, np.int32)
        np.add.at(change, c.first[anchor] + start[run], 1)
        np.add.at(change, c.first[anchor] + stop[run] + LENGTH, -1)
        covered = np.cumsum(change[:-1]) > 0
        for (owner, at, raw), end in zip(c.pieces, c.ends.tolist(), strict=True):
            mine = covered[end - len(raw) : end]
            if mine.any():
                mask = gone.setdefault(owner, np.zeros(len(texts[owner]), bool))
                mask[at : at + len(raw)] |= mine
    sorted_rows = rows.sort_by([("doc_id", "ascending"), ("key", "ascending")])
    removed, spans, kept = [], [], []
    for i, raw in enumerate(texts):
        mask = gone.get(i)
        removed.append(0 if mask is None else int(mask.sum()))
        spans.append(0 if mask is None else int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()))
        kept.append(raw if mask is None else np.frombuffer(raw, np.uint8)[~mask].tobytes())
    columns = [sorted_rows["doc_id"], sorted_rows["key"], pa.array([len(t) for t in texts], pa.int64())]
    return pa.table([*columns, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], CUT_NAMES)


CUT_NAMES = ["doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept"]
CUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def drop_repeated_strings(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, key (hash of the text), n_bytes, n_removed, n_spans, kept (bytes).

    A byte of the text's UTF-8 goes if a string of 50 bytes that covers it also begins in a document
    with a smaller doc_id; strings never cross documents and are judged on the input. n_spans counts
    the maximal removed stretches. Null and empty texts have no bytes. Rows of one doc_id, equal or not, remove
    nothing from each other; a null doc_id comes after all others. Strings count as equal when their 64-bit
    hashes are. Other columns are neither read nor returned.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // shard_bytes))
    shard = F.pmod(F.xxhash64("doc_id", text_key()), F.lit(groups)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text", shard.alias("shard"))
    by_shard = rows.groupBy("shard")
    names = by_shard.applyInArrow(lambda t: anchor_names(t, groups), "bucket int, shard int, names binary, times binary")
    repeated = names.groupBy("bucket").applyInArrow(repeated_names, "shard int, bucket int, names binary, hot binary")
    sent = by_shard.cogroup(repeated.groupBy("shard")).applyInArrow(
        lambda t, r: contents(t, r, groups),
        "bucket int, shard int, content binary, doc binary, several binary, more binary, body binary, hot binary",
    )
    runs = sent.groupBy("bucket").applyInArrow(earliest, "shard int, content binary, from binary, to binary, doc binary, hot binary")
    return by_shard.cogroup(runs.groupBy("shard")).applyInArrow(
        lambda t, r: cut(t, r, groups), "doc_id long, key long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
