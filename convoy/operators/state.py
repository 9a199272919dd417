"""Latest vehicle state, fleet lists, history pages, assignments, erasure and audit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from convoy.operators.numbering import numbered
from convoy.sources.sinks import since


def positive(value: int, name: str) -> int:
    """``value``, which must be 1 or more; there is no upper bound to what a caller may ask for."""
    if value < 1:
        raise ValueError(f"{name} must be at least 1, not {value}")
    return value


def latest_state(df: DataFrame, key: str = "vin", order: str = "arrival") -> DataFrame:
    """Newest row per vehicle; of equal times the first arrival stays."""
    rest = [c for c in df.columns if c != key]
    newest = F.struct(F.col("ts"), -F.col(order))
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), newest).alias("_latest"))
        .select(key, "_latest.*")
        .select(*df.columns)
    )


def live_list(latest: DataFrame, fleets: DataFrame, limit: int = 300) -> DataFrame:
    """Most recently seen vehicles: top ``limit`` of each fleet, fleets in id order, cut at ``limit``."""
    positive(limit, "limit")
    w = Window.partitionBy("fleet_id").orderBy(F.desc("ts"), F.desc("vin"))
    return (
        latest.join(fleets.select("fleet_id"), "fleet_id", "left_semi")
        .withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= limit)
        .orderBy("fleet_id", "position")
        .limit(limit)
    )


def active_vehicles(latest: DataFrame, as_of: dt.datetime, seconds: int = 120) -> DataFrame:
    """Vehicles heard of in the last ``seconds``, per fleet and in total (null fleet)."""
    since = as_of - dt.timedelta(seconds=seconds)
    return (
        latest.filter(F.col("ts") >= F.lit(since))
        .rollup("fleet_id")
        .agg(F.count("*").alias("active_vehicles"))
    )


def vehicle_status(latest: DataFrame, moving_kmh: float = 1.0) -> DataFrame:
    """Add ``status``: off, idling or moving."""
    return latest.withColumn(
        "status",
        F.when(~F.col("engine_on"), F.lit("off"))
        .when(F.col("speed_kmh") < moving_kmh, F.lit("idling"))
        .otherwise(F.lit("moving")),
    )


def vehicle_history(
    t: DataFrame,
    vin: str,
    as_of: dt.datetime,
    hours: int = 1,
    before: dt.datetime | None = None,
    limit: int = 200,
) -> DataFrame:
    """One vehicle's rows of the last hours, newest first; ``next_before`` only on a full page."""
    positive(limit, "limit")
    rows = since(t, "ts", as_of - dt.timedelta(hours=positive(hours, "hours"))).filter(F.col("vin") == vin)
    if before is not None:
        rows = rows.filter(F.col("ts") < F.lit(before))
        if "day" in rows.columns:
            rows = rows.filter(F.col("day") <= F.lit(before.date()))
    page = rows.orderBy(F.desc("ts"), F.desc("seq")).limit(limit)
    return _with_cursor(page, "ts", limit, "next_before", desc=True)


def _with_cursor(page: DataFrame, key: str, limit: int, name: str, desc: bool) -> DataFrame:
    """Add the page's last key where the page is full. A page is at most ``limit`` rows."""
    whole = Window.partitionBy(F.lit(0))
    last = (F.min if desc else F.max)(key).over(whole)
    out = page.withColumn(name, F.when(F.count("*").over(whole) == limit, last))
    return out.orderBy(F.desc(key) if desc else F.asc(key))


def keyset_page(
    df: DataFrame,
    key: str,
    after: int | None = None,
    limit: int = 50,
    desc: bool = False,
    max_limit: int | None = None,
) -> DataFrame:
    """One page in key order after a cursor, with ``next_cursor`` on a full page; ``max_limit`` caps its size."""
    limit = positive(limit, "limit") if max_limit is None else min(positive(limit, "limit"), max_limit)
    if after is not None:
        df = df.filter(F.col(key) < after if desc else F.col(key) > after)
    page = df.orderBy(F.desc(key) if desc else F.asc(key)).limit(limit)
    return _with_cursor(page, key, limit, "next_cursor", desc)


def fleets_with_counts(fleet: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Every fleet with its number of vehicles, zero included. Vehicles are counted before the join."""
    counts = vehicle.groupBy("fleet_id").agg(F.count("*").alias("vehicles"))
    return fleet.join(counts, "fleet_id", "left").withColumn(
        "vehicles", F.coalesce("vehicles", F.lit(0))
    )


def vehicle_list(
    vehicle: DataFrame, fleet: DataFrame, oem: DataFrame, fleet_id: int | None = None
) -> DataFrame:
    if fleet_id is not None:
        vehicle = vehicle.filter(F.col("fleet_id") == fleet_id)
    return (
        vehicle.join(fleet.select("fleet_id", "tenant_id"), "fleet_id")
        .join(oem, "oem_id")
        .select("vehicle_id", "vin", "fleet_id", "tenant_id", F.col("code").alias("oem"), "model", "fuel_type")
    )


def for_tenant(df: DataFrame, fleet: DataFrame, tenant_id: int) -> DataFrame:
    """Rows whose fleet belongs to the tenant."""
    own = fleet.filter(F.col("tenant_id") == tenant_id).select("fleet_id")
    return df.join(own, "fleet_id", "left_semi")


def mask_location(df: DataFrame, role: str, decimals: int = 3) -> DataFrame:
    """Coarse coordinates for viewers; other roles see them as stored."""
    if role != "viewer":
        return df
    return df.withColumns({c: F.round(c, decimals) for c in ("lat", "lon")})


def pair_assignments(
    vehicle: DataFrame, driver: DataFrame, assigned_from: dt.datetime, limit: int | None = None
) -> DataFrame:
    """Pair vehicles and drivers by position in id order, all of them or the first ``limit`` vehicles."""
    v = numbered(vehicle.select("vehicle_id"), [], "vehicle_id")
    if limit is not None:
        v = v.filter(F.col("rn") <= positive(limit, "limit"))
    d = numbered(driver.select("driver_id"), [], "driver_id")
    return v.join(d, "rn").select(
        "vehicle_id",
        "driver_id",
        F.lit(assigned_from).alias("assigned_from"),
        F.lit(None).cast("timestamp").alias("assigned_to"),
    )


def current_assignment(assignment: DataFrame) -> DataFrame:
    return assignment.filter(F.col("assigned_to").isNull())


def assignment_as_of(events: DataFrame, assignment: DataFrame) -> DataFrame:
    """Each event with the driver assigned at its time (null if none).

    A vehicle's assignments do not overlap, so an event meets one of them at most. The range test
    sits in the join condition: a crowded vehicle is split by AQE or served by broadcast.
    """
    a = assignment.select(
        F.col("vehicle_id").alias("_vehicle"), "driver_id", "assigned_from", "assigned_to"
    )
    on = (
        (F.col("vehicle_id") == F.col("_vehicle"))
        & (F.col("assigned_from") <= F.col("ts"))
        & (F.col("assigned_to").isNull() | (F.col("ts") < F.col("assigned_to")))
    )
    return events.join(a, on, "left").drop("_vehicle")


def erase_driver(
    driver: DataFrame, driver_id: int, tenant_id: int, as_of: dt.datetime
) -> DataFrame:
    """The driver table with one driver's personal data removed; a second run changes nothing.

    Rows changed by this run are those with ``erased_at = as_of``.
    """
    hit = (
        (F.col("driver_id") == driver_id)
        & (F.col("tenant_id") == tenant_id)
        & F.col("erased_at").isNull()
    )
    return driver.withColumns(
        {
            "full_name": F.when(hit, F.lit("ERASED")).otherwise(F.col("full_name")),
            "licence_no": F.when(hit, F.lit(None)).otherwise(F.col("licence_no")),
            "erased_at": F.when(hit, F.lit(as_of)).otherwise(F.col("erased_at")),
        }
    )


def audit_recent(log: DataFrame, tenant_id: int, limit: int = 50) -> DataFrame:
    return (
        log.filter(F.col("tenant_id") == tenant_id).orderBy(F.desc("audit_id")).limit(limit)
    )


def audit_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id", "action", "status").agg(F.count("*").alias("n"))
