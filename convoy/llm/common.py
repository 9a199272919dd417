"""What the operators of this subpackage share: tables, row keys, staging, word hashes, bounded label samples."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from convoy.session import configure, shared_dir

#: Rows in one Arrow batch; documents are large, so a batch stays at a few MB.
BATCH_ROWS = "500"
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the session gets the settings that the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: later steps survive lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark removes a query's shuffle files when it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def freed(df: DataFrame, name: str) -> DataFrame:
    """``stage``, and the shuffle files that the writing made go when it ends."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return stage(df, name)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)


_built: dict[str, object] = {}


class Shared:
    """A broadcast value, and what a worker makes of it once.

    Workers outlive queries, so what they keep goes by a name of its own and not by an object's address.
    """

    def __init__(self, spark: SparkSession, value):
        self.name = uuid.uuid4().hex
        self._broadcast = spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._broadcast.value

    def built(self, make):
        """``make(value)``, kept for later batches and tasks of this worker until another is made."""
        if self.name not in _built:
            _built.clear()
            _built[self.name] = make(self.value)
        return _built[self.name]


def text_key(text: str | Column = "text") -> Column:
    """Tells rows of one doc_id apart by their text; rows equal in both are one document."""
    return F.xxhash64(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values, so that their order is random."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """One hash per run of ``width`` words; the whole sequence if there are fewer; none without words."""
    h = word_hashes(words)
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels must not be learnt: crc32 of the id as text, modulo 3, is 1."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def label_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """A bounded, deterministic sample of labelled texts for fitting a classifier.

    Of the labelled rows that are not held out, ``per_class`` of each label at most, by hash of the
    id; texts over ``max_chars`` characters are left out of the sample, never cut. That bounds what
    comes to the driver by 2 * per_class * max_chars characters. Ids with two different labels are left out.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"), F.max(label).alias("y_max"))
        .where("y = y_max")
        .select("doc_id", "y", F.xxhash64("doc_id").alias("o"))
    )
    ids = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy("o", "doc_id").limit(per_class)
        ids = some if ids is None else ids.unionAll(some)
    short = docs.where(F.length("text") <= max_chars).select("doc_id", "text")
    # of several rows of an id the least text counts; they are put together before they are collected
    rows = short.join(F.broadcast(ids), "doc_id").groupBy("y", "o", "doc_id").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: (r.y, r.o, r.doc_id))]


#: Rows of ids up to which a side is broadcast (8 bytes each); larger sides are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def flagged(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` with a boolean column: is its doc_id among ``ids`` (one column, doc_id, distinct)?

    The ids are broadcast only if counting them shows that they fit; otherwise both sides shuffle.
    """
    marked = ids.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_hit"))
    if marked.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        marked = F.broadcast(marked)
    joined = docs.join(marked, F.col("doc_id") == F.col("_id"), "left")
    return joined.withColumn(name, F.col("_hit").isNotNull()).drop("_id", "_hit")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that ``labels`` marks as good and that are not held out."""
    good = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("q"))
    return good.where("q = 1").select("doc_id")
