"""Quality rules: counts on words, and a log-likelihood ratio of hashed n-grams.

Two multinomials over the same hash buckets are estimated, one from trusted documents and one from
the whole corpus. A document's ratio is the mean over its n-grams of log p_trusted - log p_corpus;
it is kept when the ratio reaches a fixed threshold. Nothing is drawn at random.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from convoy.llm.common import flagged, mix, word_hashes

BUCKET_BITS = 16
#: Added to every bucket of both multinomials.
SMOOTHING = 1.0
#: Least mean log ratio of a kept document.
THRESHOLD = -0.12
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Runs of letters, digits and non-ASCII bytes, and runs of other marks, over UTF-8.
TOKENS = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+").findall
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

COUNTS = pa.struct([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def ngram_buckets(text: str, bits: int) -> np.ndarray:
    """Bucket of every token and of every pair of neighbouring tokens."""
    h = word_hashes(TOKENS(text.encode()))
    if not len(h):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (np.concatenate([mix(h), pairs]) >> np.uint64(64 - bits)).astype(np.int64)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, width):
        key = np.unique(key * len(number) + ids[k : n + k], return_inverse=True)[1]
    twice = np.flatnonzero(np.bincount(key)[key] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[twice + k] = True
    return int(covered.sum())


def base_counts(text: str) -> dict[str, int]:
    """The plain rules' counts; words are runs without ASCII white space, lines end at ``\\n``."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
    }


def count_buckets(docs: DataFrame, trusted: DataFrame, bits: int = BUCKET_BITS) -> np.ndarray:
    """Counts per bucket, of the corpus (row 0) and of the trusted documents (row 1), over all rows.

    Each task counts into two arrays of 2^bits and hands on its non-zero buckets, so neither the
    shuffle nor the driver's share depends on how rows are spread.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for text, good in zip(batch["text"].to_pylist(), batch["_trusted"].to_pylist(), strict=True):
                at = ngram_buckets(text or "", bits)
                np.add.at(seen[0], at, 1)
                if good:
                    np.add.at(seen[1], at, 1)
        at = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0][at]), pa.array(seen[1][at])], ["bucket", "n", "n_trusted"])

    marked = flagged(docs.select("doc_id", "text"), trusted, "_trusted").select("text", "_trusted")
    totals = (
        marked.mapInArrow(count, "bucket long, n long, n_trusted long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.sum("n_trusted").alias("n_trusted"))
        .toArrow()
    )
    out = np.zeros((2, 1 << bits))
    at = totals["bucket"].to_numpy()
    out[0, at], out[1, at] = totals["n"].to_numpy(), totals["n_trusted"].to_numpy()
    return out


def log_ratios(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p_trusted - log p_corpus of each bucket; 0 everywhere without trusted n-grams."""
    if not counts[1].sum():
        return np.zeros(counts.shape[1])
    p = (counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * counts.shape[1])
    return np.log(p[1]) - np.log(p[0])


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    bits: int = BUCKET_BITS,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, log_ratio and kept.

    ``trusted`` has the ids (doc_id) of the target. A null or empty text has no words: all counts 0,
    log_ratio 0.0, base_failed. A ratio equal to the threshold is kept. Repeated rows are counted and
    judged as often as they occur; extra columns are neither read nor returned.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(count_buckets(docs, trusted, bits)))

    @F.arrow_udf("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint>")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([base_counts(t or "") for t in texts.to_pylist()], COUNTS)

    @F.arrow_udf("double")
    def ratio(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = (ngram_buckets(t or "", bits) for t in texts.to_pylist())
            yield pa.array([float(ratios.value[x].mean()) if len(x) else 0.0 for x in found], pa.float64())

    scored = docs.select("doc_id", counts("text").alias("_c"), ratio("text").alias("log_ratio"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        scored.select("doc_id", "_c.*", "log_ratio")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))
    )
