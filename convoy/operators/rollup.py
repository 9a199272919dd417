"""Hourly vehicle rollup and its merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

ROLLUP_KEYS = ("fleet_id", "vin", "hour")
ROLLUP_COUNTS = (
    "event_count",
    "idle_events",
    "harsh_events",
    "dtc_events",
    "overspeed_events",
    "lowfuel_events",
)


def rollup_aggregates(idle_kmh: float, over_kmh: float, low_pct: float) -> list:
    """Mergeable aggregates. A missing fuel level counts as zero, as it is stored."""
    idle = F.col("engine_on").cast("boolean") & (F.col("speed_kmh") < idle_kmh)
    return [
        F.count("*").alias("event_count"),
        F.count_if(idle).alias("idle_events"),
        F.count_if(F.col("evt") == "HARSH_BRAKE").alias("harsh_events"),
        F.count_if(F.size("dtc") > 0).alias("dtc_events"),
        F.count_if(F.col("speed_kmh") > over_kmh).alias("overspeed_events"),
        F.count_if(F.coalesce("fuel_pct", F.lit(0.0)) < low_pct).alias("lowfuel_events"),
        F.min("odo_km").alias("odo_min"),
        F.max("odo_km").alias("odo_max"),
        F.max("speed_kmh").alias("max_speed"),
    ]


def hourly_rollup(
    t: DataFrame, idle_kmh: float = 1.0, over_kmh: float = 110.0, low_pct: float = 10.0
) -> DataFrame:
    """One row per fleet, vehicle and UTC hour; a plain map-side combined aggregation."""
    return t.groupBy("fleet_id", "vin", F.date_trunc("hour", "ts").alias("hour")).agg(
        *rollup_aggregates(idle_kmh, over_kmh, low_pct)
    )


def merge_rollups(*partials: DataFrame) -> DataFrame:
    """Partial rollups of several batches merged into one row per key."""
    stacked = reduce(DataFrame.unionByName, partials)
    return stacked.groupBy(*ROLLUP_KEYS).agg(
        *[F.sum(c).alias(c) for c in ROLLUP_COUNTS],
        F.min("odo_min").alias("odo_min"),
        F.max("odo_max").alias("odo_max"),
        F.max("max_speed").alias("max_speed"),
    )
