"""Alert records and the jobs on the alert table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from convoy.operators.state import for_tenant, keyset_page


def build_alerts(hits: DataFrame, vehicle: DataFrame, alert_type: DataFrame) -> DataFrame:
    """Alert rows for rule hits (``vin, code, severity, ts, seq, detail``), status open.

    The id is a hash of vehicle, rule, time and sequence, so a replay yields the same alert.
    """
    return (
        hits.join(vehicle.select("vin", "vehicle_id"), "vin")
        .join(alert_type.select("code", "alert_type_id"), "code")
        .select(
            F.xxhash64("vehicle_id", "code", "ts", "seq").alias("alert_id"),
            "vehicle_id",
            "alert_type_id",
            "severity",
            F.col("ts").alias("raised_at"),
            "detail",
            F.lit("open").alias("status"),
        )
    )


def alert_queue(
    a: DataFrame,
    v: DataFrame,
    fleet: DataFrame,
    tenant: int,
    status: str = "open",
    before: int | None = None,
    limit: int = 50,
) -> DataFrame:
    """Newest alerts of a tenant in one status, one keyset page."""
    own = for_tenant(v.select("vehicle_id", "vin", "fleet_id"), fleet, tenant)
    rows = a.filter(F.col("status") == status).join(own.select("vehicle_id", "vin"), "vehicle_id")
    return keyset_page(rows, "alert_id", before, limit, desc=True)


def acknowledge(
    a: DataFrame,
    alert_id: int,
    user_id: int,
    v: DataFrame,
    fleet: DataFrame,
    tenant: int,
    as_of: dt.datetime,
) -> DataFrame:
    """The alert table with one open alert of the tenant acknowledged; others are untouched.

    Whether the alert is the tenant's is settled on that single row, not by joining the table.
    """
    target = (F.col("alert_id") == alert_id) & (F.col("status") == "open")
    own = for_tenant(v.select("vehicle_id", "fleet_id"), fleet, tenant)
    allowed = (
        a.filter(target)
        .join(own, "vehicle_id", "left_semi")
        .agg((F.count("*") > 0).alias("allowed"))
        .scalar()
    )
    hit = target & allowed
    return a.withColumns(
        {
            "status": F.when(hit, F.lit("ack")).otherwise(F.col("status")),
            "acked_by": F.when(hit, F.lit(user_id)),
            "acked_at": F.when(hit, F.lit(as_of)),
        }
    )


def vehicle_alert_history(a: DataFrame, vehicle_id: int, limit: int = 20) -> DataFrame:
    return (
        a.filter(F.col("vehicle_id") == vehicle_id)
        .orderBy(F.desc("raised_at"), F.desc("alert_id"))
        .limit(limit)
    )


def open_alert_counts(a: DataFrame, v: DataFrame, fleet: DataFrame, by: list[str]) -> DataFrame:
    """Open alerts by any of tenant, severity and rule. Alerts are counted per vehicle before the join."""
    own = [c for c in by if c != "tenant_id"]
    counts = (
        a.filter(F.col("status") == "open")
        .groupBy("vehicle_id", *own)
        .agg(F.count("*").alias("_n"))
    )
    scoped = v.join(fleet, "fleet_id").select("vehicle_id", "tenant_id")
    return counts.join(scoped, "vehicle_id").groupBy(*by).agg(F.sum("_n").alias("open_alerts"))
