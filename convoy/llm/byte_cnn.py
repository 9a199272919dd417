"""Quality from bytes: a small convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Every byte has a learned
vector; learned filters slide over each chunk, the best response of a filter is a chunk's feature, and
a document has the maximum and the mean of each feature over its chunks, which a logistic layer
combines into one probability. Filters and layer are trained together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from convoy.llm.common import label_sample

#: Bytes of a chunk and bytes that it shares with the next.
CHUNK, OVERLAP = 512, 32
#: Size of a byte's vector, bytes between filter positions (a filter spans two steps), filters.
DIM, STRIDE, FILTERS = 8, 4, 24
#: Bounds of the training sample: documents per label and characters of a document.
PER_CLASS, MAX_CHARS = 500, 4000
#: Small samples go round more often, up to STEPS batches.
EPOCHS, STEPS, RATE, BATCH = 16, 400, 0.004, 32
#: Chunks that go through the filters together.
TOGETHER = 256


def chunks_of(raw: bytes) -> np.ndarray:
    """Chunks as rows, zero-filled at the end; an empty text is one chunk of zeros."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.zeros(n * step + OVERLAP, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


class ByteCnn:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.filters = rng.normal(0, (2 * STRIDE * DIM) ** -0.5, (2 * STRIDE * DIM, FILTERS)).astype(np.float32)
        self.offset = np.zeros(FILTERS, np.float32)
        self.layer = np.zeros(2 * FILTERS, np.float32)
        self.bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.offset, self.layer, self.bias]

    def features(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best response of each filter in each chunk, at least 0, and the position where it is."""
        half = STRIDE * DIM
        best, where = [], []
        for at in range(0, len(chunks), TOGETHER):
            x = self.vectors.take(chunks[at : at + TOGETHER], axis=0).reshape(-1, CHUNK // STRIDE, half)
            r = x[:, :-1] @ self.filters[:half] + x[:, 1:] @ self.filters[half:] + self.offset
            top = r.argmax(1)
            best.append(np.maximum(np.take_along_axis(r, top[:, None], 1)[:, 0], 0))
            where.append(top)
        return np.concatenate(best), np.concatenate(where)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        parts = [chunks_of((t or "").encode()) for t in texts]
        if not parts:
            return np.zeros(0)
        best, _ = self.features(np.concatenate(parts))
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
        return self._probability(best, first, np.array([len(p) for p in parts]))[0]

    def _probability(self, best, first, size):
        pooled = np.hstack([np.maximum.reduceat(best, first, axis=0), np.add.reduceat(best, first, axis=0) / size[:, None]])
        return 1 / (1 + np.exp(-np.clip(pooled @ self.layer + self.bias, -50, 50).astype(np.float64))), pooled

    def fit(self, sample: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> ByteCnn:
        """Joint training with Adam on the weighted log loss; both labels weigh the same."""
        if len({y for _, y in sample}) < 2:
            self.bias[:] = 4.0 if sample and sample[0][1] else -4.0 if sample else 0.0
            return self
        docs = [(chunks_of(t.encode()), y) for t, y in sample]
        weight = {y: 0.5 * len(docs) / sum(1 for d in docs if d[1] == y) for y in (0, 1)}
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        step = 0
        for _ in range(max(epochs, -(-STEPS // -(-len(docs) // BATCH)))):
            order = rng.permutation(len(docs))
            for at in range(0, len(docs), BATCH):
                step += 1
                grads = self._gradients([docs[i] for i in order[at : at + BATCH]], weight)
                for p, g, (m, v) in zip(self.parameters(), grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, batch, weight) -> list[np.ndarray]:
        chunks = np.concatenate([c for c, _ in batch])
        size = np.array([len(c) for c, _ in batch])
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        best, where = self.features(chunks)
        p, pooled = self._probability(best, first, size)
        y = np.array([y for _, y in batch])
        g = ((p - y) * np.array([weight[k] for k in y.tolist()]) / len(batch)).astype(np.float32)
        g_pooled = g[:, None] * self.layer
        owner = np.repeat(np.arange(len(batch)), size)
        is_top = best == pooled[owner, :FILTERS]
        g_best = is_top * g_pooled[owner, :FILTERS] + (g_pooled[:, FILTERS:] / size[:, None])[owner]
        g_best *= best > 0
        # only the winning position of a filter in a chunk has a gradient
        span = 2 * STRIDE
        seen = np.take_along_axis(chunks[:, None, :], (where[:, :, None] * STRIDE + np.arange(span)), 2)
        window = self.vectors[seen].reshape(len(chunks), FILTERS, span * DIM)
        g_filters = np.einsum("cfk,cf->kf", window, g_best)
        g_window = (g_best[:, :, None] * self.filters.T).reshape(-1, DIM)
        flat = seen.reshape(-1)
        g_vectors = np.stack([np.bincount(flat, g_window[:, d], 256) for d in range(DIM)], 1)
        return [g_vectors.astype(np.float32), g_filters, g_best.sum(0), pooled.T @ g, np.array([g.sum()], np.float32)]


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id and score (0 to 1, higher: better).

    The network is fitted on a bounded sample of labelled rows that are not held out (``labels``:
    doc_id, quality 0 or 1) and then reads every whole text. A null or empty text is one chunk of
    zero bytes. Without both labels the score is a constant. Repeated rows are each scored; extra
    columns are not returned.
    """
    model = ByteCnn().fit(label_sample(docs, labels, "quality", per_class, max_chars))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = texts.to_pylist()
            found = [shared.value.probabilities(rows[at : at + 64]) for at in range(0, len(rows), 64)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return docs.select("doc_id", score("text").alias("score"))
