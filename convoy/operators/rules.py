"""The five vehicle rules over a table of deduplicated events, in (ts, seq) order.

Nothing here sorts a whole vehicle: counts look back through fixed slices of event time, idle
episodes are joined across slices, the moving average and the cooldown chain slice summaries.
On input that arrives in order the results equal the streaming processor's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from convoy.functions.plan import join_back
from convoy.operators.cooldown import apply_cooldown
from convoy.operators.ewma import ewma_z
from convoy.operators.rule_columns import MINUTE
from convoy.operators.rule_pass import rule_hits
from convoy.schemas import RULE_SEVERITY
from convoy.session import staged


def sliding_count(
    df: DataFrame,
    keys: list[str],
    window_ms: int,
    order: tuple[str, ...] = ("ts", "seq"),
    name: str = "count",
    slice_ms: int | None = None,
) -> DataFrame:
    """Add the number of rows of the same keys in (t - window, t] up to and including each row.

    Rows meet in slices of event time; the end of a slice, one window long, is also shown to the next
    slice. The count is the row's position less the rows that have left the window, both running
    counts, so a burst costs no more than a sort.
    """
    width = max(slice_ms or 4 * window_ms, window_ms)
    t = F.unix_millis("ts")
    slot = F.floor(t / F.lit(width))
    shown = F.when(
        t > (slot + 1) * width - window_ms, F.array(slot, slot + 1)
    ).otherwise(F.array(slot))
    rows = df.withColumns({"_t": t, "_own": slot}).withColumn("_slot", F.explode(shown))
    group = Window.partitionBy(*keys, "_slot")
    position = group.orderBy("_t", *[c for c in order if c != "ts"])
    gone = group.orderBy("_t").rangeBetween(Window.unboundedPreceding, -window_ms)
    return (
        rows.withColumn("_rn", F.row_number().over(position))
        .withColumn(name, F.col("_rn") - F.count("*").over(gone))
        .filter(F.col("_slot") == F.col("_own"))
        .drop("_t", "_own", "_slot", "_rn")
    )


def idle_runs(df: DataFrame, moving_kmh: float = 1.0, slice_ms: int = 300_000) -> DataFrame:
    """Idle samples with ``idle_since`` (ts, seq), where their uninterrupted idling began.

    Runs are found inside slices of event time. A run that reaches a slice's end is handed on
    through a table of one row per vehicle and slice.
    """
    idle = F.coalesce(F.col("engine_on") & (F.col("speed_kmh") < moving_kmh), F.lit(False))
    inside = Window.partitionBy("vin", "_slice").orderBy("ts", "seq")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct("ts", "seq")
    slot = F.floor(F.unix_millis("ts") / F.lit(slice_ms))
    marked = (
        df.select("vin", "ts", "seq", idle.alias("_idle"), slot.alias("_slice"))
        .withColumn("_was", F.coalesce(F.lag("_idle").over(inside), F.lit(False)))
        .withColumn("_since", F.max(F.when(F.col("_idle") & ~F.col("_was"), at)).over(so_far))
        .withColumn("_broke", F.max(~F.col("_idle")).over(so_far))
    )
    ends = marked.groupBy("vin", "_slice").agg(
        F.bool_or(~F.col("_idle")).alias("_breaks"),
        F.max_by(F.when(F.col("_idle"), F.col("_since")), at).alias("_open"),
    )
    by_slice = Window.partitionBy("vin").orderBy("_slice")
    carried = (
        ends.withColumn("_run", F.count_if("_breaks").over(by_slice))
        .withColumn(
            "_open", F.min("_open").over(Window.partitionBy("vin", "_run").orderBy("_slice"))
        )
        .select("vin", "_slice", F.lag("_open").over(by_slice).alias("_carry"))
    )
    return (
        join_back(marked, carried, ["vin", "_slice"])
        .filter("_idle")
        .select(
            "vin",
            "ts",
            "seq",
            F.when(F.col("_broke"), F.col("_since"))
            .otherwise(F.coalesce("_carry", "_since"))
            .alias("idle_since"),
        )
    )


def _hit(code: str, detail: Column, pos: Column | None = None) -> list[Column]:
    return [
        F.col("vin"),
        F.lit(code).alias("code"),
        F.lit(RULE_SEVERITY[code]).alias("severity"),
        F.col("ts"),
        F.col("seq"),
        (F.lit(0) if pos is None else pos).alias("pos"),
        F.to_json(detail).alias("detail"),
    ]


def idle_episodes(
    df: DataFrame, idle_minutes: float = 10, moving_kmh: float = 1.0, slice_ms: int = 300_000
) -> DataFrame:
    """First sample of each idle episode that is ``idle_minutes`` after its start."""
    elapsed = F.unix_millis("ts") - F.unix_millis("idle_since.ts")
    due = (elapsed >= int(idle_minutes * MINUTE)) & (
        F.struct("ts", "seq") != F.col("idle_since")
    )
    first = (
        idle_runs(df, moving_kmh, slice_ms)
        .filter(due)
        .groupBy("vin", "idle_since")
        .agg(F.min(F.struct("ts", "seq")).alias("_at"))
        .select("vin", "idle_since", "_at.*")
    )
    minutes = F.floor(elapsed / F.lit(MINUTE) + 0.5)
    return first.select(*_hit("IDLING_EXCESSIVE", F.struct(minutes.alias("idle_minutes"))))


def harsh_brake_bursts(df: DataFrame, n: int = 3, minutes: float = 10) -> DataFrame:
    """Harsh brakes that are at least the n-th within the window."""
    brakes = df.filter(F.col("evt") == "HARSH_BRAKE").select("vin", "ts", "seq")
    counted = sliding_count(brakes, ["vin"], int(minutes * MINUTE), name="count_10min")
    return counted.filter(F.col("count_10min") >= n).select(
        *_hit("HARSH_BRAKE_BURST", F.struct("count_10min"))
    )


def repeated_fault_codes(df: DataFrame, n: int = 3, minutes: float = 60) -> DataFrame:
    """Fault codes listed at least n times within the window; each listing in an event counts."""
    listed = df.filter(F.size("dtc") > 0).select(
        "vin", "ts", "seq", F.posexplode("dtc").alias("pos", "dtc_code")
    )
    counted = sliding_count(
        listed, ["vin", "dtc_code"], int(minutes * MINUTE), ("ts", "seq", "pos"), "count_1h"
    )
    return counted.filter(F.col("count_1h") >= n).select(
        *_hit("DTC_REPEAT", F.struct(F.col("dtc_code").alias("code"), "count_1h"), F.col("pos"))
    )


def overspeed_anomalies(
    df: DataFrame,
    z: float = 4,
    min_kmh: float = 100,
    alpha: float = 0.05,
    warmup: int = 30,
    slice_ms: int = 300_000,
) -> DataFrame:
    """Samples far above the vehicle's own recent speed and above ``min_kmh``."""
    scored = ewma_z(df, "speed_kmh", "vin", alpha, warmup, slice_ms)
    return scored.filter((F.col("z") > z) & (F.col("speed_kmh") > min_kmh)).select(
        *_hit("OVERSPEED_ANOMALY", F.struct("speed_kmh", F.round("z", 1).alias("z")))
    )


def low_fuel(df: DataFrame, pct: float = 10) -> DataFrame:
    """Known fuel levels below ``pct``."""
    return df.filter(F.col("fuel_pct") < pct).select(*_hit("LOW_FUEL", F.struct("fuel_pct")))


def rule_candidates(
    df: DataFrame,
    idle_minutes: float = 10,
    moving_kmh: float = 1.0,
    brake_n: int = 3,
    brake_minutes: float = 10,
    code_n: int = 3,
    code_minutes: float = 60,
    z: float = 4,
    min_kmh: float = 100,
    alpha: float = 0.05,
    warmup: int = 30,
    low_pct: float = 10,
    slice_ms: int = 300_000,
) -> DataFrame:
    """Hits of all five rules before the cooldown."""
    return reduce(
        DataFrame.unionByName,
        [
            idle_episodes(df, idle_minutes, moving_kmh, slice_ms),
            harsh_brake_bursts(df, brake_n, brake_minutes),
            repeated_fault_codes(df, code_n, code_minutes),
            overspeed_anomalies(df, z, min_kmh, alpha, warmup, slice_ms),
            low_fuel(df, low_pct),
        ],
    )


def evaluate_rules(
    df: DataFrame,
    idle_minutes: float = 10,
    cooldown_minutes: float = 15,
    moving_kmh: float = 1.0,
    brake_n: int = 3,
    brake_minutes: float = 10,
    code_n: int = 3,
    code_minutes: float = 60,
    z: float = 4,
    min_kmh: float = 100,
    alpha: float = 0.05,
    warmup: int = 30,
    low_pct: float = 10,
    slice_ms: int = 60 * MINUTE,
) -> DataFrame:
    """Alerts of all five rules: ``vin, code, severity, ts, seq, pos, detail``.

    The events are shuffled once for all rules, and equal what the five functions above give one by one. The cooldown is per
    vehicle and rule; an idle episode silenced by it stays silent. It reads the hits three times, so these,
    far fewer than the events, are staged first.
    """
    params = {
        "idle_ms": int(idle_minutes * MINUTE), "moving_kmh": moving_kmh, "brake_n": brake_n, "brake_ms": int(brake_minutes * MINUTE),
        "code_n": code_n, "code_ms": int(code_minutes * MINUTE), "z": z, "min_kmh": min_kmh, "alpha": alpha, "warmup": warmup, "low_pct": low_pct,
    }
    return apply_cooldown(staged(rule_hits(df, params, slice_ms)), cooldown_minutes)
