"""Exact duplicates, duplicate accounting and keys seen before."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

EVENT_KEYS = ("vin", "seq", "ts")


def dedup_exact(
    df: DataFrame, keys: tuple[str, ...] = EVENT_KEYS, order: str | tuple[str, ...] = "arrival"
) -> DataFrame:
    """The first arrival of every key, by one or several columns. Copies collapse before the shuffle."""
    by = F.col(order) if isinstance(order, str) else F.struct(*order)
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), by).alias("_first"))
        .select(*keys, "_first.*")
        .select(*df.columns)
    )


def duplicate_report(
    df: DataFrame, by: str = "oem", keys: tuple[str, ...] = EVENT_KEYS
) -> DataFrame:
    """Rows, distinct keys and duplicates per label, by two partial aggregations."""
    per_key = df.groupBy(by, *keys).agg(F.count("*").alias("n"))
    return per_key.groupBy(by).agg(
        F.sum("n").alias("stored"),
        F.count("*").alias("distinct_keys"),
        (F.sum("n") - F.count("*")).alias("duplicates"),
    )


def seen_key_split(history: DataFrame, probe: DataFrame, keys: tuple[str, ...] = EVENT_KEYS) -> DataFrame:
    """``probe`` with ``seen``: whether the history holds the row's key, exactly; a key with a null is never seen.

    Copies in the history collapse before the shuffle, and AQE splits a key that holds too many probe rows. Pre-filtering
    the join by a run-time Bloom filter is Spark's own choice (``spark.sql.optimizer.runtime.bloomFilter.enabled``).
    """
    known = history.select(*keys).distinct().withColumn("_known", F.lit(True))
    return probe.join(known, list(keys), "left").withColumn("seen", F.col("_known").isNotNull()).drop("_known").select(*probe.columns, "seen")


def seen_report(history: DataFrame, probe: DataFrame, keys: tuple[str, ...] = EVENT_KEYS) -> DataFrame:
    """Rows of ``probe``, those whose key the history holds, and their share."""
    marked = seen_key_split(history, probe, keys)
    return marked.agg(
        F.count("*").alias("n"), F.count_if("seen").alias("n_seen"), F.avg(F.col("seen").cast("int")).alias("share")
    )


def false_positive_rate(n: int, bits: int = 1 << 25, k: int = 4) -> float:
    """Theoretical share of new keys that an n-key filter reports as maybe seen."""
    return (1 - math.exp(-k * n / bits)) ** k
