"""Toxicity from bags of subwords: embeddings averaged into a linear softmax.

A word is the mean of the vectors of its hashed character n-grams and of its own hash, so a
misspelling never seen in training shares most of its vectors with the word it hides. A window of
neighbouring distinct words is the mean of its words; a linear softmax turns it into a probability, and a
document has that of its most toxic window, so that a few words weigh the same in a long text as in a
short one. Embeddings and softmax are trained together, on the windows that the model itself finds
most toxic in each document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from convoy.llm.common import Shared, label_sample, mix

BUCKET_BITS = 18
DIM = 8
NGRAMS = (3, 4, 5)
#: Words of a window, and words from one window's start to the next.
WINDOW, STEP = 16, 8
#: Bounds of the training sample: documents per label and characters of a document.
PER_CLASS, MAX_CHARS = 1500, 6000
#: Small samples go round more often, up to STEPS batches or MOST_EPOCHS.
EPOCHS, MOST_EPOCHS, STEPS, RATE, BATCH = 12, 50, 300, 0.5, 128
#: Buckets met in fewer documents of the sample keep a zero vector, so that no document is learnt by heart.
MIN_DOCUMENTS = 8
#: Share of the epochs in which toxic documents give random windows; random windows of every document.
WARM_SHARE, RANDOM_WINDOWS = 0.25, 4
#: Words cut into n-grams at a time: the arrays in between take some ten times what is kept.
WORDS_AT_ONCE = 10_000
#: Distinct words whose margins a worker remembers.
REMEMBERED = 150_000

WORDS = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    """A text's distinct lower-cased words in order of first occurrence, so that a repeated word weighs once."""
    return list(dict.fromkeys(WORDS(text.lower()))) if text else []


def subwords(words: list[str], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``<word>`` and of the word itself, end to end, and each word's first place."""
    if len(words) > WORDS_AT_ONCE:
        parts = [subwords(words[k : k + WORDS_AT_ONCE], bits) for k in range(0, len(words), WORDS_AT_ONCE)]
        before = np.cumsum([0] + [len(flat) for flat, _ in parts[:-1]])
        return np.concatenate([flat for flat, _ in parts]), np.concatenate([at + n for (_, at), n in zip(parts, before, strict=True)])
    raw = [b"<" + w.encode() + b">" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    joined = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(joined))  # bytes up to the word's end
    owners, buckets = [np.arange(len(raw))], [np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))]
    for n in NGRAMS:
        h = np.full(max(len(joined) - n + 1, 0), n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + joined[k : k + len(h)] + np.uint64(1)
        inside = left[: len(h)] >= n
        owners.append(owner[: len(h)][inside])
        buckets.append(mix(h[inside]))
    owners_all = np.concatenate(owners)
    order = np.argsort(owners_all, kind="stable")
    starts = np.searchsorted(owners_all[order], np.arange(len(raw)))
    return (np.concatenate(buckets)[order] >> np.uint64(64 - bits)).astype(np.int64), starts


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows over n words: every STEP words, and one that ends with the text."""
    last = max(n - WINDOW, 0)
    return np.unique(np.append(np.arange(0, last + 1, STEP), last))


def window_means(values: np.ndarray) -> np.ndarray:
    """Mean of each window of a document's word values (at least one word)."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    a = window_starts(len(values))
    b = np.minimum(a + WINDOW, len(values))
    return (total[b] - total[a]) / (b - a)


class SubwordModel:
    """Embeddings of the buckets and a softmax of two classes; scoring needs one number per bucket."""

    def __init__(self, bits: int = BUCKET_BITS, dim: int = DIM, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bits = bits
        self.vectors = np.zeros((1 << bits, dim), np.float32)
        self.out = np.zeros((dim, 2), np.float32)
        self.out[:, 1] = rng.uniform(-1, 1, dim)
        self.bias = np.zeros(2, np.float32)

    def margins(self) -> tuple[np.ndarray, float]:
        """What a bucket adds to the toxic logit minus the other, and the biases' difference."""
        return self.vectors @ (self.out[:, 1] - self.out[:, 0]), float(self.bias[1] - self.bias[0])

    def fit(self, sample: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> SubwordModel:
        """Joint training with Adagrad on windows: of a toxic document the one that scores highest, of
        another its highest and some at random. In the first epochs toxic documents give random ones."""
        number: dict[str, int] = {}
        docs = [(np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64), y) for t, y in sample]
        docs = [(ids, y) for ids, y in docs if len(ids)]
        if len({y for _, y in docs}) < 2:
            self.bias[1] = 4.0 if docs and docs[0][1] else -4.0
            return self
        flat, starts = subwords(list(number), self.bits)
        counts = np.diff(np.append(starts, len(flat)))
        met = np.zeros(1 << self.bits, np.int64)
        for ids, _ in docs:
            words = np.unique(ids)
            met[np.unique(flat[np.repeat(starts[words] - np.cumsum(counts[words]) + counts[words], counts[words]) + np.arange(counts[words].sum())])] += 1
        self.learnt = met >= MIN_DOCUMENTS
        rng = np.random.default_rng(seed)
        squares = [np.full(a.shape, 1e-6, np.float32) for a in (self.vectors, self.out, self.bias)]
        weight = {y: 0.5 * len(docs) / sum(1 for d in docs if d[1] == y) for y in (0, 1)}
        steps = sum(RANDOM_WINDOWS + 1 - y * RANDOM_WINDOWS for _, y in docs) / BATCH
        epochs = max(epochs, min(MOST_EPOCHS, int(STEPS / steps)))
        for epoch in range(epochs):
            bucket, bias = self.margins()
            margin = np.add.reduceat(bucket[flat], starts) / counts
            picked = []
            for ids, y in docs:
                a = window_starts(len(ids))
                top = a[np.argmax(window_means(margin[ids]))]
                some = rng.choice(a, min(RANDOM_WINDOWS, len(a)), replace=False)
                chosen = (some if epoch < WARM_SHARE * epochs else [top]) if y else {int(top), *some.tolist()}
                picked += [(ids[x : x + WINDOW], y, weight[y] / len(chosen)) for x in chosen]
            for at in range(0, len(picked), BATCH) if rng.shuffle(picked) is None else ():
                self._step(picked[at : at + BATCH], flat, starts, counts, squares, rate)
        return self

    def _step(self, batch, flat, starts, counts, squares, rate) -> None:
        size = np.array([len(x[0]) for x in batch])
        y = np.array([x[1] for x in batch])
        words, inverse = np.unique(np.concatenate([x[0] for x in batch]), return_inverse=True)
        n_sub = counts[words]
        first = np.concatenate([[0], np.cumsum(n_sub)[:-1]])
        sub = flat[np.repeat(starts[words] - first, n_sub) + np.arange(n_sub.sum())]
        word = np.add.reduceat(self.vectors[sub], first, axis=0) / n_sub[:, None]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        mean = np.add.reduceat(word[inverse], begin, axis=0) / size[:, None]
        logit = mean @ self.out + self.bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = p * np.array([x[2] for x in batch])[:, None] / len(batch)
        g_mean = g @ self.out.T / size[:, None]
        owner = np.repeat(np.arange(len(batch)), size)
        per_word = np.stack([np.bincount(inverse, g_mean[owner, d], len(words)) for d in range(word.shape[1])], 1) / n_sub[:, None]
        rows, place = np.unique(sub, return_inverse=True)
        spread = np.repeat(np.arange(len(words)), n_sub)
        g_rows = np.stack([np.bincount(place, per_word[spread, d], len(rows)) for d in range(word.shape[1])], 1)
        for value, square, at, grad in (
            (self.vectors, squares[0], rows, g_rows * self.learnt[rows, None]),
            (self.out, squares[1], slice(None), mean.T @ g),
            (self.bias, squares[2], slice(None), g.sum(0)),
        ):
            square[at] += grad**2
            value[at] -= rate * grad / np.sqrt(square[at])


class Scorer:
    """Scores texts in a worker, remembering the margins of words."""

    def __init__(self, bucket: np.ndarray, bias: float, bits: int):
        self.bucket, self.bias, self.bits = bucket, bias, bits
        self.known: dict[str, float] = {}

    def scores(self, texts: list[str | None]) -> list[float]:
        split = list(map(words_of, texts))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*split).difference(self.known))
        if new:
            flat, starts = subwords(new, self.bits)
            counts = np.diff(np.append(starts, len(flat)))
            self.known.update(zip(new, (np.add.reduceat(self.bucket[flat], starts) / counts).tolist(), strict=True))
        find = self.known.__getitem__
        best = [window_means(np.fromiter(map(find, x), np.float64, len(x))).max() if x else 0.0 for x in split]
        return (1 / (1 + np.exp(-np.clip(np.array(best) + self.bias, -50, 50)))).tolist()


def toxicity_column(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS):
    """Fits the model on a bounded sample of labelled rows; the column function gives a text's score.

    Labels come from rows that are not held out only. ``docs`` has doc_id and text, ``labels`` has
    doc_id and toxic (0, 1; others are ignored). Without both labels the score is a constant.
    """
    model = SubwordModel().fit(label_sample(docs, labels, "toxic", per_class, max_chars))
    shared = Shared(docs.sparkSession, (*model.margins(), model.bits))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.built(lambda value: Scorer(*value)).scores(texts.to_pylist()), pa.float64())

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id and score (0 to 1). A text without words, null included, has the
    score of the biases alone; repeated rows are each scored; extra columns are not returned."""
    return docs.select("doc_id", toxicity_column(docs, labels, per_class, max_chars)("text").alias("score"))
