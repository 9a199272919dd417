"""Spatial density, path length and radius search."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from convoy.functions.geo import geohash, geohash_bounds, haversine_km


def geohash_density(df: DataFrame, precision: int = 7) -> DataFrame:
    """Events, vehicles and mean speed per cell.

    Rows are combined per cell and vehicle first, so a crowded cell reaches the second step as one
    row per vehicle.
    """
    per_vehicle = (
        df.select(geohash(F.col("lat"), F.col("lon"), precision).alias("cell"), "vin", "speed_kmh")
        .groupBy("cell", "vin")
        .agg(F.count("*").alias("n"), F.sum("speed_kmh").alias("s"))
    )
    return per_vehicle.groupBy("cell").agg(
        F.sum("n").alias("events"),
        F.count("*").alias("vehicles"),
        (F.sum("s") / F.sum("n")).alias("mean_speed_kmh"),
    )


def geohash_cells(df: DataFrame, cell_col: str = "cell", precision: int = 7) -> DataFrame:
    """Centre and half widths of every distinct cell; null for names that are no cell."""
    lat, lon, lat_err, lon_err = geohash_bounds(F.col(cell_col), precision)
    return (
        df.select(cell_col)
        .distinct()
        .select(
            cell_col,
            lat.alias("lat"),
            lon.alias("lon"),
            lat_err.alias("lat_err"),
            lon_err.alias("lon_err"),
        )
    )


def path_distance(df: DataFrame, key: str = "vin") -> DataFrame:
    """Great-circle km and odometer km per vehicle and UTC day.

    A leg joins two consecutive fixes and counts on the day of the later one. Legs inside an hour
    come from a window over that hour only; the leg between two hours comes from the hours' first
    and last fixes, one row per vehicle and hour.
    """
    fix = F.struct("ts", "seq", "lat", "lon", "odo_km")
    rows = df.select(key, fix.alias("f"), F.date_trunc("hour", "ts").alias("_hour"))
    inside = Window.partitionBy(key, "_hour").orderBy("f.ts", "f.seq")
    legs = rows.select(key, "f", F.lag("f").over(inside).alias("g"))
    ends = rows.groupBy(key, "_hour").agg(F.min("f").alias("f"), F.max("f").alias("_last"))
    between = Window.partitionBy(key).orderBy("_hour")
    bridges = ends.select(key, "f", F.lag("_last").over(between).alias("g"))
    steps = legs.unionByName(bridges).filter(F.col("g").isNotNull())
    km = haversine_km(F.col("g.lat"), F.col("g.lon"), F.col("f.lat"), F.col("f.lon"))
    return steps.groupBy(key, F.to_date("f.ts").alias("day")).agg(
        F.count("*").alias("legs"),
        F.sum(km).alias("path_km"),
        F.sum(F.col("f.odo_km") - F.col("g.odo_km")).alias("odometer_km"),
    )


def within_radius(points: DataFrame, sites: DataFrame, km: float) -> DataFrame:
    """(site, point) pairs at most ``km`` apart, with the distance, anywhere on the globe.

    Both sides meet on grid cells. Rows of latitude are at least ``km`` high; each row has as many
    columns as its circle of latitude holds at that width, one around the poles, so cells are about
    equally large everywhere. A site stands in its own and the neighbouring columns of three rows.
    """
    lat_step = min(km / 111.19 * 1.01, 180.0)
    half = math.sin(min(km / (2 * 6371.0) * 1.01, math.pi / 2))

    def row(lat):
        return F.floor((lat + 90.0) / F.lit(lat_step))

    def columns(r):
        # the farthest latitude that a row and the one beyond it reach
        edge = F.greatest(F.abs(r * lat_step - 90.0), F.abs((r + 1) * lat_step - 90.0)) + lat_step
        ratio = F.lit(half) / F.cos(F.radians(F.least(edge, F.lit(89.9))))
        wide = F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0))))
        return F.when((edge >= 89.9) | (ratio >= 1), F.lit(1)).otherwise(F.floor(F.lit(360.0) / wide)).cast("long")

    def column(lon, n):
        return F.pmod(F.floor((lon + 180.0) / (F.lit(360.0) / n)), n)

    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    near = (
        sites.select(
            "site_id",
            F.col("lat").alias("site_lat"),
            F.col("lon").alias("site_lon"),
            F.explode(around).alias("dr"),
        )
        .select("*", F.explode(around).alias("dc"))
        .select(
            "site_id",
            "site_lat",
            "site_lon",
            "dc",
            (row(F.col("site_lat")) + F.col("dr")).alias("_row"),
        )
        .withColumn("_n", columns(F.col("_row")))
        .withColumn("_column", F.pmod(column(F.col("site_lon"), F.col("_n")) + F.col("dc"), F.col("_n")))
        .drop("dc", "_n")
        .distinct()
    )
    placed = points.withColumn("_row", row(F.col("lat")))
    placed = placed.withColumn("_column", column(F.col("lon"), columns(F.col("_row"))))
    distance = haversine_km(F.col("lat"), F.col("lon"), F.col("site_lat"), F.col("site_lon"))
    return (
        placed.join(near, ["_row", "_column"])
        .withColumn("distance_km", distance)
        .filter(F.col("distance_km") <= km)
        .drop("_row", "_column", "site_lat", "site_lon")
    )
