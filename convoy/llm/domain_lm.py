"""Cross-entropy difference of two n-gram language models that share one vocabulary.

The target model is estimated from trusted documents, the background model from all documents; both
are bigram models, interpolated with unigrams, of the same form over the same words. A document's
score is the mean over its tokens of the target model's loss minus the background model's: below 0
it reads more like the target.

Every word and every pair of neighbours of the corpus has its own counts. Shards of documents send the
names (64-bit hashes) and counts of their distinct words and pairs, packed, to buckets of names; a
bucket adds them up and answers each shard in the order it asked, and the shard reads its
documents again to score them. A shard sends a name once however frequent it is, so no bucket grows with a frequent pair.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from convoy.llm.common import flagged, mix, stage, text_key, word_hashes

#: Share of the bigram estimate; the rest goes to the unigram estimate.
BIGRAM_SHARE = 0.6
#: Bytes of documents in a shard; there are as many buckets as shards.
SHARD_BYTES = 16 << 20
WORD, PAIR = 0, 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def pair_names(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Names of pairs of words, given the words' names."""
    with np.errstate(over="ignore"):
        return mix(before * _ODD + mix(after))


class Tokens:
    """A shard's documents end to end.

    ``size`` has the tokens of each document and ``follows`` tells which tokens have one before them.
    ``names`` and ``buckets`` have the distinct words and the distinct pairs, ordered by bucket and name; ``of``
    has each token's place among the words, and each following token's place among the pairs.
    """

    def __init__(self, texts: pa.ChunkedArray, buckets: int):
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        found = []
        for chunk in texts.chunks:
            for text in chunk:
                words = words_of(text.as_py())
                found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        self.size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.concatenate(found) if found else np.zeros(0, np.int32)
        first = (np.cumsum(self.size) - self.size)[self.size > 0]
        self.follows = np.ones(len(ids), bool)
        self.follows[first] = False
        hashes = word_hashes(list(number))
        after = np.flatnonzero(self.follows)
        pairs, pair = np.unique(ids[after - 1].astype(np.int64) << 32 | ids[after], return_inverse=True)
        self.names, self.buckets, self.of = [], [], []
        for name, of in ((hashes, ids), (pair_names(hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF]), pair)):
            bucket = ((mix(name) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((name, bucket))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self.names.append(name[order])
            self.buckets.append(bucket[order])
            self.of.append(place[of])


def packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them all, after its width."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def unpacked(rows: pa.ChunkedArray) -> np.ndarray:
    """Packed counts of several rows end to end."""
    parts = [np.frombuffer(x, f"u{x[0]}", offset=1).astype(np.int64) for x in rows.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def shard_counts(rows: pa.Table, buckets: int) -> pa.Table:
    """Of a shard: for each bucket the names of its words, and of its pairs, with their counts in all and in trusted rows."""
    tokens = Tokens(rows["text"], buckets)
    good = np.repeat(rows["_trusted"].to_numpy(), tokens.size)
    shard, out = rows["shard"][0].as_py(), []
    for kind, trusted in ((WORD, good), (PAIR, good[tokens.follows])):
        name, bucket, of = tokens.names[kind], tokens.buckets[kind], tokens.of[kind]
        counts = [np.bincount(x, minlength=len(name)) for x in (of, of[trusted])]
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(at, [*at[1:], len(bucket)], strict=True):
            out.append((kind, int(bucket[a]), shard, name[a:b].tobytes(), *(packed(c[a:b]) for c in counts)))
    return _table(out, COUNT_NAMES, COUNT_TYPES)


COUNT_NAMES = ["kind", "bucket", "shard", "names", "every", "good"]
COUNT_TYPES = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 3]


def bucket_sums(rows: pa.Table) -> pa.Table:
    """Of a bucket: for each shard the corpus's counts of the names it sent, in its order.

    The first row also has the bucket's distinct names and the sums of their counts.
    """
    sent = [np.frombuffer(x, np.uint64) for x in rows["names"].to_pylist()]
    value, place = np.unique(np.concatenate(sent), return_inverse=True)
    sums = []
    for side in ("every", "good"):
        sums.append(np.zeros(len(value), np.int64))
        np.add.at(sums[-1], place, unpacked(rows[side]))
    end, out = np.cumsum([len(x) for x in sent]), []
    kind, bucket = rows["kind"][0].as_py(), rows["bucket"][0].as_py()
    for shard, a, b in zip(rows["shard"].to_pylist(), [0, *end[:-1]], end, strict=True):
        whole = (0, 0, 0) if out else (len(value), *(int(s.sum()) for s in sums))
        out.append((shard, kind, bucket, *(packed(s[place[a:b]]) for s in sums), *whole))
    return _table(out, SUM_NAMES, SUM_TYPES)


SUM_NAMES = ["shard", "kind", "bucket", "every", "good", "distinct", "n_every", "n_good"]
SUM_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 3]


def _table(rows: list, names: list[str], types: list) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def token_losses(tokens: Tokens, words: np.ndarray, pairs: np.ndarray, total: int, vocabulary: int, share: float) -> np.ndarray:
    """Loss of each token, in nats, under one model with ``total`` counted tokens."""
    count = words[tokens.of[WORD]]
    unigram = (count + 1.0) / (total + vocabulary)
    before, pair = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
    before[tokens.follows] = count[np.flatnonzero(tokens.follows) - 1]  # how often the context occurs; the start has none
    pair[tokens.follows] = pairs[tokens.of[PAIR]]
    weight = np.where(before > 0, share, 0.0)
    return -np.log(weight * (pair / np.maximum(before, 1)) + (1 - weight) * unigram)


def scores(rows: pa.Table, sums: pa.Table, buckets: int, totals: tuple[int, int], vocabulary: int, share: float) -> pa.Table:
    """Of a shard: each document's tokens and mean losses."""
    tokens = Tokens(rows["text"], buckets)
    sums = sums.sort_by([("kind", "ascending"), ("bucket", "ascending")])
    cut, owner, loss = len(tokens.names[WORD]), np.repeat(np.arange(len(tokens.size)), tokens.size), []
    for side, total in zip(("every", "good"), totals, strict=True):
        counts = unpacked(sums[side])
        if len(counts) != cut + len(tokens.names[PAIR]):
            raise RuntimeError("a shard's rows changed between two readings")
        each = token_losses(tokens, counts[:cut], counts[cut:], total, vocabulary, share)
        loss.append(np.bincount(owner, each, len(tokens.size)) / np.maximum(tokens.size, 1))
    return pa.table([rows["doc_id"], pa.array(tokens.size), pa.array(loss[1]), pa.array(loss[0])], ["doc_id", "n_tokens", "target_loss", "background_loss"])


def cross_entropy_difference(
    docs: DataFrame, trusted: DataFrame, size: int | None = None, bits: int | None = None, share: float = BIGRAM_SHARE, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, target_loss, background_loss (nats per token), difference.

    ``trusted`` has the ids (doc_id) of the target; all rows make up the background. Tokens are
    lower-cased words between ASCII white space. The vocabulary is all words of ``docs`` and one unknown word, which
    only smooths. A null or empty text has no tokens and losses 0.0.
    Without trusted documents the target model is uniform. Repeated rows count as often as they
    occur; extra columns are neither read nor returned. Words and pairs count as equal when their
    64-bit hashes are. ``size`` and ``bits`` once bounded the words and pairs told apart; they have no effect.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // shard_bytes))
    shard = F.pmod(F.xxhash64("doc_id", text_key()), F.lit(groups)).cast("int").alias("shard")
    marked = flagged(docs.select("doc_id", "text"), trusted, "_trusted").select(shard, "text", "_trusted")
    sent = marked.groupBy("shard").applyInArrow(
        lambda t: shard_counts(t, groups), "kind int, bucket int, shard int, names binary, every binary, good binary"
    )
    answers = "shard int, kind int, bucket int, every binary, good binary, distinct long, n_every long, n_good long"
    sums = stage(sent.groupBy("kind", "bucket").applyInArrow(bucket_sums, answers), "word-and-pair-counts")
    found = sums.where(F.col("kind") == WORD).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("distinct", "n_every", "n_good"))).first()
    vocabulary, totals = found[0] + 1, (found[1], found[2])
    back = sums.select("shard", "kind", "bucket", "every", "good").groupBy("shard")
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text", shard).groupBy("shard").cogroup(back).applyInArrow(
        lambda t, s: scores(t, s, groups, totals, vocabulary, share),
        f"doc_id {doc_id}, n_tokens long, target_loss double, background_loss double",
    )
    return scored.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
