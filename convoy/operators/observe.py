"""Rates, latency, reconciliation and lateness of the pipeline itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from convoy.functions.plan import join_back
from convoy.schemas import LATENCY_BOUNDS


def rate(
    df: DataFrame, ts_col: str, by: list[str], window_s: int = 30, step_s: int = 5
) -> DataFrame:
    """Events per second over the trailing window, at every step that a window touches.

    Events are counted per step first; only those counts are spread over the windows they fall in.
    ``window_s`` must be a multiple of ``step_s``.
    """
    if window_s % step_s:
        raise ValueError("window must be a multiple of the step")
    seconds = F.unix_seconds(F.col(ts_col))
    slot = seconds - F.pmod(seconds, F.lit(step_s))
    counts = df.groupBy(*by, slot.alias("_slot")).agg(F.count("*").alias("_n"))
    ends = F.explode(F.sequence(F.col("_slot") + step_s, F.col("_slot") + window_s, F.lit(step_s)))
    return (
        counts.select(*by, "_n", ends.alias("window_end"))
        .groupBy(*by, "window_end")
        .agg((F.sum("_n") / window_s).alias("per_second"))
    )


def latency_histogram(
    df: DataFrame,
    by: list[str],
    event_col: str = "ts",
    stored_col: str = "received_at",
    bounds: tuple[float, ...] = LATENCY_BOUNDS,
) -> DataFrame:
    """Cumulative counts per upper bound in seconds; the last bound is infinite."""
    millis = F.greatest(
        F.lit(0), F.unix_millis(F.col(stored_col)) - F.unix_millis(F.col(event_col))
    )
    names = [f"_le_{i}" for i in range(len(bounds) + 1)]
    counts = [F.count_if(millis <= round(b * 1000)).alias(n) for b, n in zip(bounds, names)]
    totals = df.groupBy(*by).agg(*counts, F.count("*").alias(names[-1]))
    pairs = F.array(
        *[
            F.struct(F.lit(float(b)).alias("le"), F.col(n).alias("n"))
            for b, n in zip((*bounds, float("inf")), names)
        ]
    )
    return totals.select(*by, F.inline(pairs))


def histogram_quantile(h: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that reaches the wanted rank.

    A rank beyond the last finite bound yields that bound. A label has one row per bound.
    """
    w = Window.partitionBy(*by).orderBy("le")
    whole = Window.partitionBy(*by)
    rows = h.select(
        "*",
        F.lag("n", 1, 0).over(w).alias("_below"),
        F.lag("le", 1, 0.0).over(w).alias("_from"),
        (F.max("n").over(whole) * F.lit(q)).alias("_rank"),
    )
    inside = F.col("_from") + (F.col("le") - F.col("_from")) * (
        (F.col("_rank") - F.col("_below")) / (F.col("n") - F.col("_below"))
    )
    value = F.when(F.col("le") == float("inf"), F.col("_from")).otherwise(inside)
    return (
        rows.filter((F.col("n") >= F.col("_rank")) & (F.col("n") > F.col("_below")))
        .groupBy(*by)
        .agg(F.min_by(value, F.col("le")).alias("quantile"))
    )


def reconcile(
    accepted: DataFrame, stored: DataFrame, duplicates: DataFrame, dead: DataFrame, by: list[str]
) -> DataFrame:
    """accepted - (stored + duplicates + dead) per label; zero means every event is accounted for.

    Each input is counted on its own; the counts are stacked and added, so no join can lose a label.
    """
    parts = {"accepted": accepted, "stored": stored, "duplicates": duplicates, "dead": dead}
    stacked = reduce(
        DataFrame.unionByName,
        [
            df.groupBy(*by).agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
            for name, df in parts.items()
        ],
    )
    sums = [F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(p) for p in parts]
    return (
        stacked.groupBy(*by)
        .agg(*sums)
        .withColumn(
            "missing",
            F.col("accepted") - F.col("stored") - F.col("duplicates") - F.col("dead"),
        )
    )


def late_events(
    df: DataFrame,
    key: str = "vin",
    order: str = "arrival",
    received_col: str = "received_at",
    slice_s: int = 3600,
) -> DataFrame:
    """Add ``lateness_ms``: how far an event lies behind its vehicle's newest earlier arrival (0 if not).

    The running maximum is taken inside slices of arrival time; a slice starts from the maximum of
    the slices before it, which needs one row per vehicle and slice.
    """
    slot = F.floor(F.unix_seconds(F.col(received_col)) / F.lit(slice_s))
    rows = df.withColumn("_slot", slot)
    earlier = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(key, "_slot")
        .agg(F.max("ts").alias("_top"))
        .select(key, "_slot", F.max("_top").over(earlier).alias("_carry"))
    )
    inside = (
        Window.partitionBy(key, "_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    newest = F.greatest("_seen", "_carry")
    lateness = F.greatest(
        F.lit(0).cast("bigint"), F.unix_millis(newest) - F.unix_millis(F.col("ts"))
    )
    return (
        join_back(rows.withColumn("_seen", F.max("ts").over(inside)), carried, [key, "_slot"])
        .withColumn("lateness_ms", F.coalesce(lateness, F.lit(0).cast("bigint")))
        .drop("_slot", "_seen", "_carry")
    )


def lateness_profile(df: DataFrame, by: str = "vin", **options) -> DataFrame:
    """Events, out-of-order events, and mean and maximum lateness."""
    late: Column = F.col("lateness_ms") > 0
    return (
        late_events(df, **options)
        .groupBy(by)
        .agg(
            F.count("*").alias("events"),
            F.count_if(late).alias("out_of_order"),
            F.max("lateness_ms").alias("max_lateness_ms"),
            F.sum("lateness_ms").alias("total_lateness_ms"),
        )
    )
