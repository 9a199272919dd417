"""Accept/reject split, vehicle enrichment and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from convoy.operators.normalise import normalise
from convoy.schemas import CANONICAL_COLUMNS


def vehicle_directory(vehicle: DataFrame, fleet: DataFrame) -> DataFrame:
    """vin, vehicle_id, fleet_id, tenant_id of every vehicle that belongs to a fleet."""
    return vehicle.join(fleet, "fleet_id").select(
        F.trim("vin").alias("vin"), "vehicle_id", "fleet_id", "tenant_id"
    )


def enrich_vehicle(df: DataFrame, vehicle: DataFrame, fleet: DataFrame) -> DataFrame:
    """Add vehicle, fleet and tenant ids; unknown vehicles get ``reason = unknown_vehicle``.

    No broadcast is forced: the planner broadcasts the directory while its measured size is below
    the threshold, and beyond it joins by shuffle, where AQE splits a VIN that holds too many rows.
    Rows already rejected carry no usable VIN; they get a spread-out key that matches nothing.
    """
    if "reason" not in df.columns:
        df = df.withColumn("reason", F.lit(None).cast("string"))
    plain = [n for n, t in df.dtypes if t in ("string", "bigint", "int", "timestamp", "double") and n != "reason"]
    # by the raw columns if there are any, so that nobody has to compute the canonical ones for it
    plain = [n for n in plain if n not in CANONICAL_COLUMNS] or plain
    spread = F.concat(F.lit("#"), F.xxhash64(*plain).cast("string"))
    directory = vehicle_directory(vehicle, fleet).withColumnRenamed("vin", "_vin")
    keyed = df.withColumn("_key", F.when(F.col("reason").isNull(), F.col("vin")).otherwise(spread))
    out = keyed.join(directory, F.col("_key") == F.col("_vin"), "left")
    return out.withColumn(
        "reason",
        F.coalesce(
            "reason", F.when(F.col("vehicle_id").isNull(), F.lit("unknown_vehicle"))
        ),
    ).drop("_key", "_vin")


def route(raw: DataFrame, mappings, vehicle: DataFrame, fleet: DataFrame) -> DataFrame:
    """Every raw row with its canonical columns, ids and ``reason`` (null = accepted).

    Reasons rank: envelope, mapping, reading and validation, unknown vehicle.
    """
    return enrich_vehicle(normalise(raw, mappings), vehicle, fleet)


def split_accept_reject(
    raw: DataFrame, mappings, vehicle: DataFrame, fleet: DataFrame
) -> tuple[DataFrame, DataFrame]:
    routed = route(raw, mappings, vehicle, fleet)
    return (
        routed.filter(F.col("reason").isNull()).drop("reason", "payload"),
        routed.filter(F.col("reason").isNotNull()),
    )


def dead_letter_counts(rejected: DataFrame) -> DataFrame:
    """Rejects per reason family: the reason's first two segments."""
    return (
        rejected.filter(F.col("reason").isNotNull())
        .groupBy(F.substring_index("reason", ":", 2).alias("reason"))
        .agg(F.count("*").alias("n"))
    )


def sample_dead_letters(
    rejected: DataFrame, ts_col: str = "received_at", per_second: int = 200, order: str = "arrival"
) -> DataFrame:
    """At most ``per_second`` rejects of each second, first come first kept.

    The rank filter is cut per task before the shuffle, so a crowded second ships few rows.
    """
    second = F.unix_seconds(F.col(ts_col))
    w = Window.partitionBy("_second").orderBy(order)
    return (
        rejected.withColumn("_second", second)
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= per_second)
        .drop("_second", "_rn")
    )


def sample_invalid_lines(
    invalid: DataFrame, batch_col: str = "batch_id", per_batch: int = 20, order: str = "line_no"
) -> DataFrame:
    """At most ``per_batch`` unreadable lines of each ingest batch."""
    w = Window.partitionBy(batch_col).orderBy(order)
    return (
        invalid.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= per_batch)
        .drop("_rn")
    )


def recent_rejects(
    rejected: DataFrame, ts_col: str = "received_at", limit: int = 10, tie: str = "arrival"
) -> DataFrame:
    return rejected.orderBy(F.desc(ts_col), F.desc(tie)).limit(limit)


def replay_dead_letters(
    rejected: DataFrame, mappings, vehicle: DataFrame, fleet: DataFrame
) -> DataFrame:
    """Route dead letters (``oem, payload, ...``) again, under mappings activated since."""
    derived = ("reason", "vehicle_id", "fleet_id", "tenant_id")
    return route(
        rejected.drop(*[c for c in derived if c in rejected.columns]), mappings, vehicle, fleet
    )
