"""Queries on duplicates, vehicle state, fleet lists, drivers, alerts and audit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from convoy.operators import alerts, dedup, rules, state
from convoy.plans.fixtures import BASE_MS, duck, view
from convoy.plans.registry import AS_OF, ms, query

VIN = "CVY63352600000008"  # vehicle 7 in every table size


# ---- duplicates ----

FIRST = """+ firsts AS (SELECT * FROM arrivals QUALIFY row_number() OVER (PARTITION BY vin, seq, ts ORDER BY arrival) = 1)"""


@query("dedup_exact", duck("arrivals", then=FIRST + " SELECT event_id, copy, arrival, vin, speed_kmh FROM firsts"))
def dedup_exact(spark, sf):
    out = dedup.dedup_exact(view(spark, sf, "arrivals"))
    return out.select("event_id", "copy", "arrival", "vin", "speed_kmh")


@query(
    "duplicate_report",
    duck(
        "arrivals",
        then="""SELECT oem, count(*) AS stored, count(DISTINCT (vin, seq, ts)) AS distinct_keys,
            count(*) - count(DISTINCT (vin, seq, ts)) AS duplicates FROM arrivals GROUP BY oem""",
    ),
)
def duplicate_report(spark, sf):
    return dedup.duplicate_report(view(spark, sf, "arrivals"))


@query(
    "seen_key_split",
    duck(
        "arrivals",
        then=f"""+ history AS (SELECT DISTINCT vin, seq, ts FROM arrivals WHERE received_ms < {BASE_MS + 15 * 86400000})
        SELECT event_id, copy, EXISTS (SELECT 1 FROM history h WHERE h.vin = a.vin AND h.seq = a.seq AND h.ts = a.ts) AS seen
        FROM arrivals a""",
    ),
)
def seen_key_split(spark, sf):
    rows = view(spark, sf, "arrivals")
    history = rows.filter(F.col("received_ms") < BASE_MS + 15 * 86400000)
    return dedup.seen_key_split(history, rows).select("event_id", "copy", "seen")


# ---- latest state ----

LATEST = "+ latest AS (SELECT * FROM arrivals QUALIFY row_number() OVER (PARTITION BY vin ORDER BY ts DESC, arrival) = 1)"


def latest(spark, sf):
    """Latest state with the fleet that the vehicle table names."""
    rows = state.latest_state(view(spark, sf, "arrivals")).drop("fleet_id")
    return rows.join(view(spark, sf, "vehicle").select("vin", "fleet_id"), "vin")


LATEST_FLEET = (
    LATEST + ", placed AS (SELECT l.* EXCLUDE (fleet_id), v.fleet_id FROM latest l JOIN vehicle v ON v.vin = l.vin)"
)


@query("latest_state", duck("arrivals", then=LATEST + " SELECT vin, event_id, ts_ms, lat, lon, fuel_pct, odo_km FROM latest"))
def latest_state(spark, sf):
    out = state.latest_state(view(spark, sf, "arrivals"))
    return out.select("vin", "event_id", "ts_ms", "lat", "lon", "fuel_pct", "odo_km")


@query(
    "live_list",
    duck(
        "arrivals", "vehicle", "fleet",
        then=LATEST_FLEET + """ SELECT fleet_id, position, vin, ts_ms FROM (
            SELECT p.fleet_id, row_number() OVER (PARTITION BY p.fleet_id ORDER BY ts DESC, vin DESC) AS position, vin, ts_ms
            FROM placed p JOIN fleet f ON f.fleet_id = p.fleet_id WHERE f.tenant_id IN (1, 2)) x
        WHERE position <= 300 ORDER BY fleet_id, position LIMIT 300""",
    ),
)
def live_list(spark, sf):
    fleets = view(spark, sf, "fleet").filter(F.col("tenant_id").isin(1, 2))
    out = state.live_list(latest(spark, sf), fleets)
    return out.select("fleet_id", F.col("position").cast("bigint").alias("position"), "vin", "ts_ms")


@query(
    "active_vehicles",
    duck(
        "arrivals", "vehicle",
        then=LATEST_FLEET + """ SELECT fleet_id, count(*) AS active_vehicles FROM placed
            WHERE ts >= TIMESTAMP '2024-01-30 22:00:00' GROUP BY ROLLUP (fleet_id)""",
    ),
)
def active_vehicles(spark, sf):
    return state.active_vehicles(latest(spark, sf), AS_OF, seconds=7200)


@query(
    "vehicle_status",
    duck(
        "arrivals", "vehicle",
        then=LATEST_FLEET + """ SELECT fleet_id, CASE WHEN NOT engine_on THEN 'off' WHEN speed_kmh < 1 THEN 'idling' ELSE 'moving' END AS status,
            count(*) AS n FROM placed GROUP BY ALL""",
    ),
)
def vehicle_status(spark, sf):
    out = state.vehicle_status(latest(spark, sf))
    return out.groupBy("fleet_id", "status").agg(F.count("*").alias("n"))


@query(
    "vehicle_history",
    duck(
        "telemetry",
        then=f"""+ page AS (SELECT event_id, ts_ms, lat, lon, speed_kmh, fuel_pct, engine_on, evt FROM telemetry
            WHERE vin = '{VIN}' AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR AND ts < TIMESTAMP '2024-01-30'
            ORDER BY ts DESC, seq DESC LIMIT 10)
        SELECT *, CASE WHEN count(*) OVER () = 10 THEN min(ts_ms) OVER () END AS next_before_ms FROM page""",
    ),
)
def vehicle_history(spark, sf):
    out = state.vehicle_history(
        view(spark, sf, "telemetry"), VIN, AS_OF, hours=168, before=dt.datetime(2024, 1, 30), limit=10
    )
    return out.select(
        "event_id", "ts_ms", "lat", "lon", "speed_kmh", "fuel_pct", "engine_on", "evt",
        ms("next_before", "next_before_ms"),
    )


# ---- lists and pages ----


def vehicles(spark, sf):
    return state.vehicle_list(*[view(spark, sf, n) for n in ("vehicle", "fleet", "oem")])


@query(
    "vehicle_page",
    duck(
        "vehicle", "fleet", "oem",
        then="""+ page AS (SELECT v.vehicle_id, v.vin, v.fleet_id, f.tenant_id, o.code AS oem, v.model, v.fuel_type
            FROM vehicle v JOIN fleet f USING (fleet_id) JOIN oem o USING (oem_id)
            WHERE f.tenant_id = 2 AND v.vehicle_id > 40 ORDER BY v.vehicle_id LIMIT 20)
        SELECT *, CASE WHEN count(*) OVER () = 20 THEN max(vehicle_id) OVER () END AS next_cursor FROM page""",
    ),
)
def vehicle_page(spark, sf):
    own = state.for_tenant(vehicles(spark, sf), view(spark, sf, "fleet"), 2)
    page = state.keyset_page(own, "vehicle_id", after=40, limit=20)
    return page.select("vehicle_id", "vin", "fleet_id", "tenant_id", "oem", "model", "fuel_type", "next_cursor")


@query(
    "driver_page",
    duck(
        "driver",
        then="""+ page AS (SELECT driver_id, full_name, licence_no FROM driver WHERE tenant_id = 3 ORDER BY driver_id LIMIT 100)
        SELECT *, CASE WHEN count(*) OVER () = 100 THEN max(driver_id) OVER () END AS next_cursor FROM page""",
    ),
)
def driver_page(spark, sf):
    own = view(spark, sf, "driver").filter(F.col("tenant_id") == 3)
    page = state.keyset_page(own, "driver_id", after=None, limit=500, max_limit=100)
    return page.select("driver_id", "full_name", "licence_no", "next_cursor")


@query(
    "fleet_counts",
    duck(
        "fleet", "vehicle",
        then="""SELECT f.fleet_id, f.name, f.tenant_id, count(v.vehicle_id) AS vehicles FROM fleet f
            LEFT JOIN vehicle v ON v.fleet_id = f.fleet_id GROUP BY ALL""",
    ),
)
def fleet_counts(spark, sf):
    out = state.fleets_with_counts(view(spark, sf, "fleet"), view(spark, sf, "vehicle"))
    return out.select("fleet_id", "name", "tenant_id", "vehicles")


@query(
    "vehicle_listing",
    duck(
        "vehicle", "fleet", "oem",
        then="""SELECT v.vehicle_id, v.vin, v.fleet_id, f.tenant_id, o.code AS oem, v.model, v.fuel_type
            FROM vehicle v JOIN fleet f USING (fleet_id) JOIN oem o USING (oem_id)""",
    ),
)
def vehicle_listing(spark, sf):
    return vehicles(spark, sf)


@query(
    "tenant_scope",
    duck(
        "telemetry", "vehicle", "fleet",
        then="""SELECT t.event_id, t.vin, v.fleet_id FROM telemetry t JOIN vehicle v ON v.vin = t.vin
            WHERE v.fleet_id IN (SELECT fleet_id FROM fleet WHERE tenant_id = 2)""",
    ),
)
def tenant_scope(spark, sf):
    rows = view(spark, sf, "telemetry").select("event_id", "vin")
    placed = rows.join(view(spark, sf, "vehicle").select("vin", "fleet_id"), "vin")
    return state.for_tenant(placed, view(spark, sf, "fleet"), 2).select("event_id", "vin", "fleet_id")


@query(
    "masked_locations",
    duck(
        "telemetry",
        then="""SELECT event_id, round((lat + 0.00012e0), 3) AS lat, round((lon + 0.00012e0), 3) AS lon, true AS viewer FROM telemetry
        UNION ALL SELECT event_id, lat + 0.00012e0, lon + 0.00012e0, false FROM telemetry""",
    ),
)
def masked_locations(spark, sf):
    rows = view(spark, sf, "telemetry").select(
        "event_id", (F.col("lat") + 0.00012).alias("lat"), (F.col("lon") + 0.00012).alias("lon")
    )
    return (
        state.mask_location(rows, "viewer").withColumn("viewer", F.lit(True))
        .unionByName(state.mask_location(rows, "manager").withColumn("viewer", F.lit(False)))
    )


# ---- drivers ----


@query(
    "assignments_paired",
    duck(
        "vehicle", "driver",
        then="""SELECT v.vehicle_id, d.driver_id FROM
            (SELECT vehicle_id, row_number() OVER (ORDER BY vehicle_id) AS rn FROM vehicle) v
            JOIN (SELECT driver_id, row_number() OVER (ORDER BY driver_id) AS rn FROM driver) d USING (rn)""",
    ),
)
def assignments_paired(spark, sf):
    pairs = state.pair_assignments(view(spark, sf, "vehicle"), view(spark, sf, "driver"), AS_OF)
    return state.current_assignment(pairs).select("vehicle_id", "driver_id")


@query(
    "current_assignments",
    duck("assignment", then="SELECT vehicle_id, driver_id FROM assignment WHERE assigned_to IS NULL"),
)
def current_assignments(spark, sf):
    return state.current_assignment(view(spark, sf, "assignment")).select("vehicle_id", "driver_id")


@query(
    "assignment_as_of",
    duck(
        "telemetry", "assignment",
        then="""SELECT t.event_id, a.driver_id FROM telemetry t LEFT JOIN assignment a ON a.vehicle_id = t.vehicle_id
            AND a.assigned_from <= t.ts AND (a.assigned_to IS NULL OR t.ts < a.assigned_to)""",
    ),
)
def assignment_as_of(spark, sf):
    rows = view(spark, sf, "telemetry").select("event_id", "vehicle_id", "ts")
    return state.assignment_as_of(rows, view(spark, sf, "assignment")).select("event_id", "driver_id")


@query(
    "driver_erasure",
    duck(
        "driver",
        then=f"""+ pick AS (SELECT driver_id FROM driver WHERE tenant_id = 1 AND erased_at IS NULL ORDER BY driver_id LIMIT 1)
        SELECT driver_id, CASE WHEN driver_id = (SELECT driver_id FROM pick) THEN 'ERASED' ELSE full_name END AS full_name,
            CASE WHEN driver_id = (SELECT driver_id FROM pick) THEN NULL ELSE licence_no END AS licence_no,
            CASE WHEN driver_id = (SELECT driver_id FROM pick) THEN {BASE_MS + 30 * 86400000} WHEN erased_at IS NOT NULL THEN {BASE_MS} END AS erased_ms,
            driver_id = (SELECT driver_id FROM pick) AS changed FROM driver""",
    ),
)
def driver_erasure(spark, sf):
    drivers = view(spark, sf, "driver")
    pick = drivers.filter("tenant_id = 1 AND erased_at IS NULL").orderBy("driver_id").first()
    once = state.erase_driver(drivers, pick["driver_id"], 1, AS_OF)
    twice = state.erase_driver(once, pick["driver_id"], 1, dt.datetime(2024, 2, 1))
    other = state.erase_driver(twice, pick["driver_id"] + 1, 99, AS_OF)  # not that tenant's driver
    changed = F.coalesce(F.col("erased_at") == F.lit(AS_OF), F.lit(False))
    return other.select(
        "driver_id", "full_name", "licence_no", ms("erased_at", "erased_ms"), changed.alias("changed")
    )


@query(
    "audit_recent",
    duck("audit_log", then="SELECT audit_id, user_id, action, status FROM audit_log WHERE tenant_id = 3 ORDER BY audit_id DESC LIMIT 50"),
)
def audit_recent(spark, sf):
    return state.audit_recent(view(spark, sf, "audit_log"), 3).select("audit_id", "user_id", "action", "status")


@query("audit_counts", duck("audit_log", then="SELECT user_id, action, status, count(*) AS n FROM audit_log GROUP BY ALL"))
def audit_counts(spark, sf):
    return state.audit_counts(view(spark, sf, "audit_log"))


# ---- alerts ----


@query(
    "alert_records",
    duck(
        "telemetry", "vehicle", "alert_type",
        then="""SELECT v.vehicle_id, a.alert_type_id, 'info' AS severity, t.ts_ms AS raised_ms, t.fuel_pct, 'open' AS status, true AS fresh_id
        FROM telemetry t JOIN vehicle v ON v.vin = t.vin JOIN alert_type a ON a.code = 'LOW_FUEL' WHERE t.fuel_pct < 10""",
    ),
)
def alert_records(spark, sf):
    hits = rules.low_fuel(view(spark, sf, "telemetry"))
    out = alerts.build_alerts(hits, view(spark, sf, "vehicle"), view(spark, sf, "alert_type"))
    copies = out.groupBy("alert_id").agg(F.count("*").alias("c"))  # ids must not collide
    return out.join(copies, "alert_id").select(
        "vehicle_id", "alert_type_id", "severity", ms("raised_at", "raised_ms"),
        F.get_json_object("detail", "$.fuel_pct").cast("double").alias("fuel_pct"), "status",
        (F.col("c") == 1).alias("fresh_id"),
    )


@query(
    "alert_queue",
    duck(
        "alert", "vehicle", "fleet",
        then="""+ page AS (SELECT a.alert_id, v.vin, a.severity, a.raised_ms FROM alert a JOIN vehicle v USING (vehicle_id) JOIN fleet f USING (fleet_id)
            WHERE f.tenant_id = 1 AND a.status = 'open' AND a.alert_id < 1200 ORDER BY alert_id DESC LIMIT 50)
        SELECT *, CASE WHEN count(*) OVER () = 50 THEN min(alert_id) OVER () END AS next_cursor FROM page""",
    ),
)
def alert_queue(spark, sf):
    a, v, f = (view(spark, sf, n) for n in ("alert", "vehicle", "fleet"))
    out = alerts.alert_queue(a, v, f, tenant=1, before=1200)
    return out.select("alert_id", "vin", "severity", "raised_ms", "next_cursor")


@query(
    "alert_acknowledge",
    duck(
        "alert", "vehicle", "fleet",
        then=f"""+ pick AS (SELECT min(a.alert_id) AS id FROM alert a JOIN vehicle v USING (vehicle_id) JOIN fleet f USING (fleet_id)
            WHERE f.tenant_id = 1 AND a.status = 'open')
        SELECT alert_id, CASE WHEN alert_id = (SELECT id FROM pick) THEN 'ack' ELSE status END AS status,
            CASE WHEN alert_id = (SELECT id FROM pick) THEN 7 END AS acked_by,
            CASE WHEN alert_id = (SELECT id FROM pick) THEN {BASE_MS + 30 * 86400000} END AS acked_ms FROM alert""",
    ),
)
def alert_acknowledge(spark, sf):
    a, v, f = (view(spark, sf, n) for n in ("alert", "vehicle", "fleet"))
    own = state.for_tenant(v.select("vehicle_id", "fleet_id"), f, 1)
    pick = a.filter("status = 'open'").join(own, "vehicle_id", "left_semi").agg(F.min("alert_id")).first()[0]
    out = alerts.acknowledge(a, pick, 7, v, f, 1, AS_OF)
    return out.select("alert_id", "status", "acked_by", ms("acked_at", "acked_ms"))


@query(
    "vehicle_alert_history",
    duck("alert", then="SELECT alert_id, severity, status, raised_ms FROM alert WHERE vehicle_id = 7 ORDER BY raised_ms DESC, alert_id DESC LIMIT 20"),
)
def vehicle_alert_history(spark, sf):
    out = alerts.vehicle_alert_history(view(spark, sf, "alert"), 7)
    return out.select("alert_id", "severity", "status", "raised_ms")


@query(
    "open_alert_counts",
    duck(
        "alert", "alert_type", "vehicle", "fleet",
        then="""SELECT f.tenant_id, a.severity, t.code, count(*) AS open_alerts FROM alert a JOIN alert_type t USING (alert_type_id)
            JOIN vehicle v USING (vehicle_id) JOIN fleet f USING (fleet_id) WHERE a.status = 'open' GROUP BY ALL""",
    ),
)
def open_alert_counts(spark, sf):
    a = view(spark, sf, "alert").join(view(spark, sf, "alert_type"), "alert_type_id")
    v, f = view(spark, sf, "vehicle"), view(spark, sf, "fleet")
    return alerts.open_alert_counts(a, v, f, ["tenant_id", "severity", "code"])
