"""Fill-in-middle transformation by displacement scatter.

The bytes of a batch of texts lie end to end. A document is cut at two token borders, and each of its three parts moves as a
whole: how far a byte moves from its place in the input to its place in the output is constant inside a
part. A difference array gets the change of that displacement at each part's first byte, a cumulative sum
gives every byte's own, and one scatter builds all outputs of the batch; the tags fill the places that no
byte falls on. Restoring finds the tags of each output, forms the same displacements from the lengths of the
parts, and gathers the bytes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Tags of the three parts; a text that holds one of them is never cut.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
TAG = len(PREFIX)
#: Of a hundred documents, those left plain, and of the cut ones those in suffix-first order.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Bytes of texts laid end to end; a longer text stands alone. Working arrays take some 40 times as much.
SLICE_BYTES = 1 << 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def _scan(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a code point, and which begin a token; texts begin at ``first``."""
    code_point = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    inside = np.zeros(len(data), bool)
    inside[1:] = letter[1:] & letter[:-1]
    inside[first[first < len(data)]] = False
    return code_point, code_point & ~inside


def _displaced(size: int, starts: list[np.ndarray], shifts: list[np.ndarray]) -> np.ndarray:
    """Every byte's displacement, from that of the parts that begin at ``starts`` (in order within a text).

    Of parts that begin at one place the last counts: those before it are empty.
    """
    at, shift = np.stack(starts, 1).ravel(), np.stack(shifts, 1).ravel()
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, at, np.diff(shift, prepend=0))
    return np.cumsum(change[:-1])


def _ends(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    end = np.cumsum(size)
    return end - size, end


def transform(data: np.ndarray, size: np.ndarray, form: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Outputs of texts laid end to end: their bytes and sizes, tokens, and code points of prefix and middle.

    ``size`` has each text's bytes, ``form`` its form, and ``cuts`` two numbers of which the remainders by n + 1 are the cuts.
    """
    begin, end = _ends(size)
    code_point, token = _scan(data, begin)
    borders = np.flatnonzero(token)
    head = np.searchsorted(borders, begin)
    n = np.searchsorted(borders, end) - head
    cut = np.sort(cuts % (n + 1)[:, None], axis=1)
    padded = np.append(borders, len(data))
    place = np.where(cut < n[:, None], padded[np.minimum(head[:, None] + cut, len(borders))], end[:, None])
    a, b = np.where(form == PLAIN, end, place[:, 0]), np.where(form == PLAIN, end, place[:, 1])
    prefix, middle, suffix = a - begin, b - a, end - b
    moved = np.where(form == PLAIN, 0, TAG)
    out_begin, _ = _ends(size + 3 * moved)
    spm = form == SPM
    # where each part's tag stands in the output; its bytes follow
    suffix_tag = np.where(spm, out_begin, out_begin + moved + prefix)
    prefix_tag = np.where(spm, suffix_tag + moved + suffix, out_begin)
    middle_tag = np.where(spm, prefix_tag + moved + prefix, suffix_tag + moved + suffix)
    shift = _displaced(
        len(data), [begin, a, b], [prefix_tag + moved - begin, middle_tag + moved - a, suffix_tag + moved - b]
    )
    out = np.zeros(int(size.sum() + 3 * moved.sum()), np.uint8)
    out[np.arange(len(data)) + shift] = data
    tagged = form != PLAIN
    for tag, at in ((PREFIX, prefix_tag), (SUFFIX, suffix_tag), (MIDDLE, middle_tag)):
        out[at[tagged][:, None] + np.arange(TAG)] = np.frombuffer(tag, np.uint8)
    before = np.concatenate([[0], np.cumsum(code_point)])
    return out, size + 3 * moved, n, before[a] - before[begin], before[b] - before[a]


def restore(data: np.ndarray, size: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that :func:`transform` made ``data`` of, and their sizes: outputs and forms are all it reads."""
    begin, end = _ends(size)
    tags = np.zeros(len(data), np.uint8)
    if len(data) >= TAG:
        open_, name, close = data[:-2], data[1:-1], data[2:]
        is_tag = (open_ == PREFIX[0]) & (close == PREFIX[2])
        for k, tag in enumerate((PREFIX, SUFFIX, MIDDLE), 1):
            tags[:-2][is_tag & (name == tag[1])] = k
    tagged = np.flatnonzero(form != PLAIN)
    # a tag across the border of two outputs is none: only those inside a tagged output are looked at
    found = np.flatnonzero(tags)
    owner = np.searchsorted(end, found, "right")
    found = found[(form[owner] != PLAIN) & (found + TAG <= end[owner])]
    if len(found) != 3 * len(tagged):
        raise ValueError("an output does not hold each tag once")
    at = {k: found[tags[found] == k] for k in (1, 2, 3)}
    p, s, m = end.copy(), end.copy(), end.copy()
    for start, k in ((p, 1), (s, 2), (m, 3)):
        start[tagged] = at[k] + TAG
    spm = form == SPM
    plain = form == PLAIN
    prefix = np.where(plain, size, np.where(spm, m, s) - TAG - p)
    suffix = np.where(plain, 0, np.where(spm, p, m) - TAG - s)
    middle = np.where(plain, 0, end - m)
    p = np.where(plain, begin, p)
    length = prefix + middle + suffix
    out_begin, _ = _ends(length)
    a, b = out_begin + prefix, out_begin + prefix + middle
    shift = _displaced(int(length.sum()), [out_begin, a, b], [p - out_begin, m - a, s - b])
    return data[np.arange(len(shift)) + shift], length


def _slices(size: np.ndarray) -> Iterator[slice]:
    """Neighbouring texts of SLICE_BYTES in all, or one that is longer."""
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > SLICE_BYTES:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if len(size):
        yield slice(start, len(size))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes end to end and each row's number of them; null has none."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return data, np.diff(ends) if len(column) else np.zeros(0, np.int64)


def _binary(data: list[np.ndarray], size: list[np.ndarray]) -> pa.Array:
    all_sizes = np.concatenate(size) if size else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(all_sizes)]).astype(np.int64)
    body = np.concatenate(data) if data else np.zeros(0, np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(all_sizes), [None, pa.py_buffer(ends), pa.py_buffer(body)]).cast(pa.binary())


_MADE = T.StructType([*(T.StructField(c, T.LongType()) for c in ("n", "prefix_chars", "middle_chars")), T.StructField("output", T.BinaryType())])


@F.arrow_udf(_MADE)
def _transformed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, form, first, second in batches:
        data, size = _bytes_of(text)
        forms = form.to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.stack([first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)], 1).astype(np.int64)
        begin, end = _ends(size)
        parts = [
            transform(data[begin[s.start] : end[s.stop - 1]], size[s], forms[s], cuts[s].reshape(-1, 2)) for s in _slices(size)
        ]
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (2, 3, 4)]
        plain = forms == PLAIN
        yield pa.StructArray.from_arrays(
            [
                pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64(), mask=plain), pa.array(columns[2], pa.int64(), mask=plain),
                _binary([p[0] for p in parts], [p[1] for p in parts]),
            ],
            ["n", "prefix_chars", "middle_chars", "output"],
        )


@F.arrow_udf(T.BinaryType())
def _restored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for output, form in batches:
        data, size = _bytes_of(output)
        forms = form.to_numpy(zero_copy_only=False).astype(np.int64)
        begin, end = _ends(size)
        parts = [restore(data[begin[s.start] : end[s.stop - 1]], size[s], forms[s]) for s in _slices(size)]
        yield _binary([p[0] for p in parts], [p[1] for p in parts])


def _number(form: Column) -> Column:
    return F.when(form == "psm", PSM).when(form == "spm", SPM).otherwise(PLAIN).cast("int")


def fill_in_middle(
    docs: DataFrame, seed: str = "1", plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """``docs`` with n (tokens), form, prefix_chars, middle_chars and output (bytes); all other columns as they were.

    A token is a run of ASCII letters or any other single code point. The four first 32-bit numbers of
    the SHA-256 of ``seed:doc_id`` choose the two cuts (each from 0 to n tokens), whether a document stays plain, and
    the order of the parts: prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each behind its tag.
    A null or empty text and one that holds a tag stay plain: the output is the text, and the numbers of
    code points are null. A null doc_id is read as an empty text. Rows of one doc_id draw the same numbers. Input columns
    named like an added one are replaced. No shuffle: a row's work depends on that row alone.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    text = F.coalesce(F.col("text"), F.lit(""))
    tagged = F.lit(False)
    for tag in (PREFIX, SUFFIX, MIDDLE):
        tagged = tagged | text.contains(tag.decode())
    plain = (text == "") | tagged | (h[2] % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    rest = [c for c in docs.columns if c not in added]
    made = docs.withColumn("form", form).withColumn("_made", _transformed(text.cast("binary"), _number(F.col("form")), h[0], h[1]))
    return made.select(*[F.col(f"`{c}`") for c in rest], "_made.n", "form", "_made.prefix_chars", "_made.middle_chars", "_made.output")


def restored(made: DataFrame, name: str = "restored") -> DataFrame:
    """``made`` with the texts (bytes) from which :func:`fill_in_middle` made ``output``, read off output and form alone."""
    return made.withColumn(name, _restored("output", _number(F.col("form"))))
