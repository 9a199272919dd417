"""Queries on rates, latency, reconciliation, lateness and geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoy.operators import dedup, geospatial, observe
from convoy.plans.fixtures import duck, view
from convoy.plans.mappings import ROUTED, routed
from convoy.plans.registry import query
from convoy.schemas import EARTH_RADIUS_KM, GEOHASH_ALPHABET, LATENCY_BOUNDS
from convoy.session import staged


@query(
    "event_rate",
    duck(
        "telemetry_fast",
        then="""+ steps AS (SELECT oem, unnest(range((ts_ms // 5000) * 5 + 5, (ts_ms // 5000) * 5 + 35, 5)) AS window_end FROM telemetry_fast)
        SELECT oem, CAST(window_end AS BIGINT) AS window_end, round(count(*) / 30, 6) AS per_second FROM steps GROUP BY ALL""",
    ),
)
def event_rate(spark, sf):
    out = observe.rate(view(spark, sf, "telemetry_fast"), "ts", ["oem"])
    return out.select("oem", "window_end", F.round("per_second", 6).alias("per_second"))


BOUNDS = ", ".join(f"({b}e0)" for b in LATENCY_BOUNDS)
HISTOGRAM = f"""bounds AS (SELECT * FROM (VALUES {BOUNDS}, (1e9)) b(le)),
    histogram AS (SELECT oem, le, count(*) FILTER (greatest(0, received_ms - ts_ms) <= le * 1000) AS n FROM arrivals, bounds GROUP BY oem, le)"""


def histogram(spark, sf):
    return observe.latency_histogram(view(spark, sf, "arrivals"), ["oem"])


@query("latency_histogram", duck("arrivals", then="+ " + HISTOGRAM + " SELECT oem, CASE WHEN le = 1e9 THEN '+Inf' ELSE CAST(CAST(le AS DECIMAL(9,2)) AS VARCHAR) END AS le, n FROM histogram"))
def latency_histogram(spark, sf):
    bound = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("decimal(9,2)").cast("string"))
    return histogram(spark, sf).select("oem", bound.alias("le"), "n")


@query(
    "latency_quantiles",
    duck(
        "arrivals",
        then="+ " + HISTOGRAM + """, stepped AS (SELECT *, lag(n, 1, 0) OVER (PARTITION BY oem ORDER BY le) AS below,
              lag(le, 1, 0e0) OVER (PARTITION BY oem ORDER BY le) AS low, max(n) OVER (PARTITION BY oem) AS total FROM histogram),
        wanted AS (SELECT s.*, q FROM stepped s, (VALUES (0.5e0), (0.95e0)) w(q))
        SELECT oem, q, round(CASE WHEN le = 1e9 THEN low ELSE low + (le - low) * ((q * total - below) / (n - below)) END, 6) AS quantile
        FROM wanted WHERE n >= q * total AND n > below QUALIFY row_number() OVER (PARTITION BY oem, q ORDER BY le) = 1""",
    ),
)
def latency_quantiles(spark, sf):
    h = histogram(spark, sf)
    parts = [
        observe.histogram_quantile(h, q, ["oem"]).select("oem", F.lit(q).alias("q"), F.round("quantile", 6).alias("quantile"))
        for q in (0.5, 0.95)
    ]
    return parts[0].unionByName(parts[1])


@query(
    "reconciliation",
    duck(
        "wire_defects", "vehicle", "fleet",
        then=ROUTED + """, ok AS (SELECT * FROM routed WHERE reason IS NULL),
        parts AS (SELECT oem, count(*) AS accepted, count(reason) AS dead FROM routed GROUP BY oem),
        kept AS (SELECT oem, count(DISTINCT (vin, seq, ts_ms)) AS stored, count(*) - count(DISTINCT (vin, seq, ts_ms)) AS duplicates FROM ok GROUP BY oem)
        SELECT p.oem, accepted, coalesce(stored, 0) AS stored, coalesce(duplicates, 0) AS duplicates, dead,
               accepted - coalesce(stored, 0) - coalesce(duplicates, 0) - dead AS missing FROM parts p LEFT JOIN kept k ON k.oem = p.oem""",
    ),
)
def reconciliation(spark, sf):
    rows = staged(routed(spark, sf).select("event_id", "copy", "oem", "vin", "seq", "ts", "arrival", "reason"))
    ok = rows.filter(F.col("reason").isNull())
    stored = dedup.dedup_exact(ok)
    duplicates = ok.join(stored.select("arrival"), "arrival", "left_anti")
    dead = rows.filter(F.col("reason").isNotNull())
    return observe.reconcile(rows, stored, duplicates, dead, ["oem"])


@query(
    "lateness_profile",
    duck(
        "arrivals",
        then="""+ seen AS (SELECT vin, greatest(0, coalesce(max(ts_ms) OVER (PARTITION BY vin ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - ts_ms, 0)) AS late FROM arrivals)
        SELECT vin, count(*) AS events, count(*) FILTER (late > 0) AS out_of_order, max(late) AS max_lateness_ms, CAST(sum(late) AS BIGINT) AS total_lateness_ms FROM seen GROUP BY vin""",
    ),
)
def lateness_profile(spark, sf):
    return observe.lateness_profile(view(spark, sf, "arrivals"))


# ---- geography ----

_BITS = " + ".join
LETTERS = " || ".join(
    "substr('" + GEOHASH_ALPHABET + "', CAST(1 + "
    + _BITS(
        f"((CAST(floor({'lon_i' if p % 2 == 0 else 'lat_i'}) AS BIGINT) >> {(17 if p % 2 == 0 else 16) - p // 2}) & 1) * {2 ** (4 - p % 5)}"
        for p in range(5 * c, 5 * c + 5)
    )
    + " AS INT), 1)"
    for c in range(7)
)
CELLS = f"""placed AS (SELECT *, floor((lon + 180) / 360 * {2**18}) AS lon_i, floor((lat + 90) / 180 * {2**17}) AS lat_i FROM telemetry),
    named AS (SELECT *, {LETTERS} AS cell FROM placed)"""


@query(
    "geohash_density",
    duck("telemetry", then="+ " + CELLS + " SELECT cell, count(*) AS events, count(DISTINCT vin) AS vehicles, round(avg(speed_kmh), 6) AS mean_speed_kmh FROM named GROUP BY cell"),
)
def geohash_density(spark, sf):
    out = geospatial.geohash_density(view(spark, sf, "telemetry"))
    return out.withColumn("mean_speed_kmh", F.round("mean_speed_kmh", 6))


@query(
    "geohash_cells",
    duck(
        "telemetry",
        then="+ " + CELLS + f""" SELECT DISTINCT cell, -90 + (lat_i + 0.5e0) * {180 / 2**17!r} AS lat, -180 + (lon_i + 0.5e0) * {360 / 2**18!r} AS lon,
            CAST({90 / 2**17!r} AS DOUBLE) AS lat_err, CAST({180 / 2**18!r} AS DOUBLE) AS lon_err FROM named""",
    ),
)
def geohash_cells(spark, sf):
    density = geospatial.geohash_density(view(spark, sf, "telemetry"))
    return geospatial.geohash_cells(density)


def _haversine(a: str, b: str) -> str:
    return (
        f"2 * {EARTH_RADIUS_KM} * asin(least(1, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2)"
        f" + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )


@query(
    "path_distance",
    duck(
        "telemetry",
        then=f"""+ numbered AS (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY ts, seq) AS rn FROM telemetry)
        SELECT f.vin, strftime(f.ts, '%Y-%m-%d') AS day, count(*) AS legs, round(sum({_haversine('g', 'f')}), 4) AS path_km,
            round(sum(f.odo_km - g.odo_km), 4) AS odometer_km
        FROM numbered f JOIN numbered g ON g.vin = f.vin AND g.rn = f.rn - 1 GROUP BY ALL""",
    ),
)
def path_distance(spark, sf):
    out = geospatial.path_distance(view(spark, sf, "telemetry"))
    return out.select(
        "vin", F.date_format("day", "yyyy-MM-dd").alias("day"), "legs",
        F.round("path_km", 4).alias("path_km"), F.round("odometer_km", 4).alias("odometer_km"),
    )


SITES = "SELECT n_nationkey AS site_id, 12e0 + (n_nationkey % 4) * 1.7e0 AS lat, 77e0 + (n_nationkey % 5) * 0.9e0 AS lon FROM nation"


@query(
    "within_radius",
    duck(
        "telemetry",
        then=f"""+ sites AS ({SITES}),
        near AS (SELECT s.site_id, t.vin, {_haversine('t', 's')} AS d FROM telemetry t, sites s)
        SELECT site_id, vin, count(*) AS fixes, round(min(d), 4) AS nearest_km FROM near WHERE d <= 25 GROUP BY site_id, vin""",
    ),
)
def within_radius(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    sites = nation.selectExpr(*[c.strip() for c in SITES[len("SELECT "):-len(" FROM nation")].split(",")])
    points = view(spark, sf, "telemetry").select("vin", "lat", "lon")
    out = geospatial.within_radius(points, sites, km=25)
    return out.groupBy("site_id", "vin").agg(
        F.count("*").alias("fixes"), F.round(F.min("distance_km"), 4).alias("nearest_km")
    )
