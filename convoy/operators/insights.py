"""Idling cost, utilisation and dashboard figures; all read the rollup, never raw rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from convoy.operators.state import positive
from convoy.sources.sinks import since


def trailing(
    df: DataFrame,
    ts_col: str,
    as_of: dt.datetime,
    days: int | None = None,
    hours: int | None = None,
) -> DataFrame:
    """Rows of the last ``days`` (7) or ``hours``; the bound is a literal, so scans prune on it."""
    if hours is not None:
        span = dt.timedelta(hours=positive(hours, "hours"))
    else:
        span = dt.timedelta(days=positive(7 if days is None else days, "days"))
    return since(df, ts_col, as_of - span)


def _decimal(value: float) -> Column:
    return F.lit(str(value)).cast("decimal(9,4)")


def with_idle_cost(
    df: DataFrame,
    idle_col: str = "idle",
    sample_s: float = 1,
    l_per_h: float = 0.8,
    price: float = 95,
) -> DataFrame:
    """Add idle hours, litres and cost, each rounded from the unrounded exact amount."""
    seconds = F.col(idle_col).cast("decimal(18,0)") * _decimal(sample_s)
    litres = seconds * _decimal(l_per_h)
    cost = litres * _decimal(price)
    hour = F.lit(3600).cast("decimal(4,0)")
    return df.withColumns(
        {
            "idle_hours": F.round(seconds / hour, 3).cast("double"),
            "litres": F.round(litres / hour, 3).cast("double"),
            "cost": F.round(cost / hour, 2).cast("double"),
        }
    )


def _ratio() -> Column:
    return F.when(F.col("n") > 0, F.col("idle") / F.col("n")).otherwise(F.lit(0.0))


def idling_top(
    rollup: DataFrame, as_of: dt.datetime, days: int = 7, limit: int = 10, **cost
) -> DataFrame:
    """Vehicles that idled most, with idle share and cost."""
    rows = (
        trailing(rollup, "hour", as_of, days=days)
        .groupBy("vin")
        .agg(F.sum("idle_events").alias("idle"), F.sum("event_count").alias("n"))
        .filter(F.col("idle") > 0)
        .orderBy(F.desc("idle"), "vin")
        .limit(positive(limit, "limit"))
    )
    return with_idle_cost(rows.withColumn("idle_ratio", _ratio()), **cost)


def idling_by_fleet(rollup: DataFrame, as_of: dt.datetime, days: int = 7, **cost) -> DataFrame:
    """Idling cost per fleet and its share of the costliest fleet's idling."""
    rows = (
        trailing(rollup, "hour", as_of, days=days)
        .groupBy("fleet_id")
        .agg(F.sum("idle_events").alias("idle"))
    )
    top = F.max("idle").over(Window.partitionBy(F.lit(0)))  # one row per fleet
    share = F.when(top > 0, F.col("idle") / top).otherwise(F.lit(0.0))
    return with_idle_cost(rows.withColumn("share_of_max", share), **cost)


def idling_total(rollup: DataFrame, as_of: dt.datetime, days: int = 7, **cost) -> DataFrame:
    rows = trailing(rollup, "hour", as_of, days=days).agg(
        F.coalesce(F.sum("idle_events"), F.lit(0)).alias("idle"),
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("n"),
    )
    return with_idle_cost(rows.withColumn("idle_ratio", _ratio()), **cost)


def utilisation(
    rollup: DataFrame, as_of: dt.datetime, days: int = 7, limit: int = 10, sample_s: float = 1
) -> DataFrame:
    """Distance, active hours (engine-off samples count as active) and top speed per vehicle."""
    return (
        trailing(rollup, "hour", as_of, days=days)
        .groupBy("vin")
        .agg(
            F.sum("event_count").alias("n"),
            F.sum("idle_events").alias("idle"),
            (F.max("odo_max") - F.min("odo_min")).alias("km"),
            F.max("max_speed").alias("vmax"),
        )
        .orderBy(F.desc("km"), "vin")
        .limit(positive(limit, "limit"))
        .select(
            "vin",
            F.round("km", 2).alias("distance_km"),
            F.round(
                (F.col("n") - F.col("idle")).cast("decimal(18,0)") * _decimal(sample_s) / 3600, 3
            )
            .cast("double")
            .alias("active_hours"),
            F.round("vmax", 1).alias("max_speed_kmh"),
        )
    )


def summary(
    latest: DataFrame,
    open_alerts: DataFrame,
    rollup: DataFrame,
    stored: DataFrame,
    as_of: dt.datetime,
    active_seconds: int = 120,
    days: int = 7,
    **cost,
) -> DataFrame:
    """One row: active vehicles, open alerts, events in the last second, idling cost.

    The inputs are scoped to the tenant already. Each figure is its own small aggregate; they are
    stacked and pivoted instead of crossed.
    """
    second = dt.timedelta(seconds=1)
    figures = [
        latest.filter(F.col("ts") >= F.lit(as_of - dt.timedelta(seconds=active_seconds))).agg(
            F.count("*").cast("double").alias("v")
        ),
        open_alerts.agg(F.coalesce(F.sum("open_alerts"), F.lit(0)).cast("double").alias("v")),
        stored.filter(
            (F.col("received_at") >= F.lit(as_of - second)) & (F.col("received_at") < F.lit(as_of))
        ).agg(F.count("*").cast("double").alias("v")),
        idling_total(rollup, as_of, days, **cost).select(F.col("cost").alias("v")),
    ]
    names = ["active_vehicles", "open_alerts", "events_per_sec", "idle_cost_7d"]
    stacked = None
    for name, figure in zip(names, figures):
        row = figure.select(F.lit(name).alias("k"), "v")
        stacked = row if stacked is None else stacked.unionByName(row)
    picked = [F.max(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in names]
    out = stacked.agg(*picked)
    return out.select(
        *[F.col(n).cast("bigint").alias(n) for n in names[:3]], F.col(names[3])
    )


def kpi_trend(
    series: DataFrame,
    by: str = "series",
    order: str = "at",
    value: str = "value",
    points: int = 24,
    invert: bool = False,
    bucket: int = 4096,
) -> DataFrame:
    """Trend of each series over its last ``points`` changes of value.

    ``order`` is an integer position. A point counts if it differs from the point before it. The
    comparison runs inside buckets of ``bucket`` positions; only the edges of the buckets meet in a
    second window, and only ``points`` rows per task and series are ranked.
    """
    rows = series.filter(F.col(value).isNotNull()).withColumn(
        "_slot", F.floor(F.col(order) / F.lit(bucket))
    )
    edges = rows.groupBy(by, "_slot").agg(F.max_by(value, order).alias("_end"))
    previous = Window.partitionBy(by).orderBy("_slot")
    edges = edges.select(by, "_slot", F.lag("_end").over(previous).alias("_carry"))
    inside = Window.partitionBy(by, "_slot").orderBy(order)
    changed = (
        rows.withColumn("_prev", F.lag(value).over(inside))
        .join(edges, [by, "_slot"])
        .withColumn("_prev", F.coalesce("_prev", "_carry"))
        .filter(F.col("_prev").isNull() | (F.col("_prev") != F.col(value)))
    )
    tail = Window.partitionBy(by).orderBy(F.desc(order))
    kept = changed.withColumn("_rn", F.row_number().over(tail)).filter(F.col("_rn") <= points)
    ends = kept.groupBy(by).agg(
        F.count("*").alias("points"),
        F.min_by(value, order).alias("first"),
        F.max_by(value, order).alias("last"),
    )
    pct = (F.col("last") - F.col("first")) / F.abs("first") * 100
    moved = (F.col("points") >= 2) & (F.col("first") != 0)
    pct = F.when(moved, pct)
    steady = F.coalesce(F.abs(pct) < 1, F.lit(True))
    good = pct < 0 if invert else pct > 0
    return ends.select(
        by,
        "points",
        "first",
        "last",
        F.when(F.col("points") < 2, F.lit("none"))
        .when(steady, F.lit("steady"))
        .when(pct > 0, F.lit("up"))
        .otherwise(F.lit("down"))
        .alias("direction"),
        F.when(steady, F.lit("neutral"))
        .when(good, F.lit("success"))
        .otherwise(F.lit("critical"))
        .alias("variant"),
        F.when(~steady, F.round(F.abs(pct), 1)).alias("pct"),
    )
