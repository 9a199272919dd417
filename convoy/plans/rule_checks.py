"""Queries on the vehicle rules, on the compressed clock (one day in 144 seconds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoy.operators import ewma, rules
from convoy.operators.cooldown import apply_cooldown
from convoy.plans.fixtures import duck, view
from convoy.plans.registry import ms, query

IDLE_MINUTES = 2


def detail(path: str, kind: str):
    return F.get_json_object("detail", f"$.{path}").cast(kind)


def events(spark, sf):
    return view(spark, sf, "telemetry_fast")


def _count_sql(source: str, keys: str, window: int, pos: str = "0") -> str:
    """Rows of the same keys in (t - window, t], up to the row itself in (ts, seq, pos) order."""
    match = " AND ".join(f"b.{k} = a.{k}" for k in keys.split(", "))
    return f"""SELECT a.*, (SELECT count(*) FROM {source} b WHERE {match} AND b.ts_ms > a.ts_ms - {window}
        AND (b.ts_ms, b.seq, b.{pos}) <= (a.ts_ms, a.seq, a.{pos})) AS cnt FROM {source} a"""


BRAKES = """brakes AS (SELECT vin, ts_ms, seq, 0 AS pos FROM telemetry_fast WHERE evt = 'HARSH_BRAKE'),
    brake_counts AS (""" + _count_sql("brakes", "vin", 600000, "pos") + ")"
CODES = """codes AS (SELECT vin, ts_ms, seq, 0 AS pos, dtc_code FROM telemetry_fast WHERE dtc_code <> ''),
    code_counts AS (""" + _count_sql("codes", "vin, dtc_code", 3600000, "pos") + ")"
IDLE = f"""marked AS (SELECT *, engine_on AND speed_kmh < 1 AS idle FROM telemetry_fast),
    islands AS (SELECT *, count(*) FILTER (NOT idle) OVER (PARTITION BY vin ORDER BY ts_ms, seq) AS island FROM marked),
    idles AS (SELECT vin, ts_ms, seq, min(ts_ms) OVER (PARTITION BY vin, island) AS since, island FROM islands WHERE idle),
    idle_hits AS (SELECT vin, ts_ms, seq, since FROM idles WHERE ts_ms - since >= {IDLE_MINUTES * 60000}
        QUALIFY row_number() OVER (PARTITION BY vin, island ORDER BY ts_ms, seq) = 1)"""
EWMA = """ordered AS (SELECT vin, ts_ms, seq, speed_kmh AS x, row_number() OVER (PARTITION BY vin ORDER BY ts_ms, seq) AS rn FROM telemetry_fast),
    walk AS (SELECT vin, rn, ts_ms, seq, x, x AS mean, 0e0 AS var, 0e0 AS z FROM ordered WHERE rn = 1
      UNION ALL
      SELECT o.vin, o.rn, o.ts_ms, o.seq, o.x, w.mean + 0.05e0 * (o.x - w.mean),
             0.95e0 * (w.var + 0.05e0 * (o.x - w.mean) * (o.x - w.mean)),
             CASE WHEN w.rn >= 30 AND sqrt(w.var) > 1e-9 THEN (o.x - w.mean) / sqrt(w.var) ELSE 0e0 END
      FROM walk w JOIN ordered o ON o.vin = w.vin AND o.rn = w.rn + 1)"""
HITS = """hits AS (
    SELECT vin, 'IDLING_EXCESSIVE' AS code, 'warning' AS severity, ts_ms, seq, 0 AS pos FROM idle_hits
    UNION ALL SELECT vin, 'HARSH_BRAKE_BURST', 'warning', ts_ms, seq, 0 FROM brake_counts WHERE cnt >= 3
    UNION ALL SELECT vin, 'DTC_REPEAT', 'critical', ts_ms, seq, pos FROM code_counts WHERE cnt >= 3
    UNION ALL SELECT vin, 'OVERSPEED_ANOMALY', 'warning', ts_ms, seq, 0 FROM walk WHERE z > 4 AND x > 100
    UNION ALL SELECT vin, 'LOW_FUEL', 'info', ts_ms, seq, 0 FROM telemetry_fast WHERE fuel_pct < 10)"""


def _cooled(hits: str) -> str:
    return f"""queue AS (SELECT *, row_number() OVER (PARTITION BY vin, code ORDER BY ts_ms, seq, pos) AS rn FROM {hits}),
    cooled AS (SELECT vin, code, rn, ts_ms, true AS emitted, ts_ms AS last FROM queue WHERE rn = 1
      UNION ALL
      SELECT q.vin, q.code, q.rn, q.ts_ms, q.ts_ms - c.last >= 900000,
             CASE WHEN q.ts_ms - c.last >= 900000 THEN q.ts_ms ELSE c.last END
      FROM cooled c JOIN queue q ON q.vin = c.vin AND q.code = c.code AND q.rn = c.rn + 1)"""


@query(
    "sliding_brake_count",
    duck("telemetry_fast", then="+ " + BRAKES + " SELECT vin, ts_ms, seq, cnt FROM brake_counts"),
)
def sliding_brake_count(spark, sf):
    brakes = events(spark, sf).filter("evt = 'HARSH_BRAKE'").select("vin", "ts", "seq")
    out = rules.sliding_count(brakes, ["vin"], 600_000, name="cnt")
    return out.select("vin", ms("ts", "ts_ms"), "seq", "cnt")


@query(
    "idle_episodes",
    duck(
        "telemetry_fast",
        then="+ " + IDLE + " SELECT vin, ts_ms, seq, CAST(FLOOR((ts_ms - since)/60000e0 + 0.5e0) AS BIGINT) AS idle_minutes FROM idle_hits",
    ),
)
def idle_episodes(spark, sf):
    out = rules.idle_episodes(events(spark, sf), IDLE_MINUTES)
    return out.select("vin", ms("ts", "ts_ms"), "seq", detail("idle_minutes", "bigint").alias("idle_minutes"))


@query(
    "harsh_brake_bursts",
    duck("telemetry_fast", then="+ " + BRAKES + " SELECT vin, ts_ms, seq, cnt AS count_10min FROM brake_counts WHERE cnt >= 3"),
)
def harsh_brake_bursts(spark, sf):
    out = rules.harsh_brake_bursts(events(spark, sf))
    return out.select("vin", ms("ts", "ts_ms"), "seq", detail("count_10min", "bigint").alias("count_10min"))


@query(
    "repeated_fault_codes",
    duck("telemetry_fast", then="+ " + CODES + " SELECT vin, ts_ms, seq, dtc_code AS code, cnt AS count_1h FROM code_counts WHERE cnt >= 3"),
)
def repeated_fault_codes(spark, sf):
    out = rules.repeated_fault_codes(events(spark, sf))
    return out.select(
        "vin", ms("ts", "ts_ms"), "seq", detail("code", "string").alias("code"), detail("count_1h", "bigint").alias("count_1h")
    )


@query(
    "speed_zscores",
    duck("telemetry_fast", then="+ " + EWMA + " SELECT vin, ts_ms, seq, round(z, 6) AS z FROM walk"),
)
def speed_zscores(spark, sf):
    out = ewma.ewma_z(events(spark, sf))
    return out.select("vin", ms("ts", "ts_ms"), "seq", F.round("z", 6).alias("z"))


@query(
    "overspeed_anomalies",
    duck("telemetry_fast", then="+ " + EWMA + " SELECT vin, ts_ms, seq, x AS speed_kmh, round(z, 1) AS z FROM walk WHERE z > 4 AND x > 100"),
)
def overspeed_anomalies(spark, sf):
    out = rules.overspeed_anomalies(events(spark, sf))
    return out.select(
        "vin", ms("ts", "ts_ms"), "seq", detail("speed_kmh", "double").alias("speed_kmh"), detail("z", "double").alias("z")
    )


@query("low_fuel", duck("telemetry_fast", then="SELECT vin, ts_ms, seq, fuel_pct FROM telemetry_fast WHERE fuel_pct < 10"))
def low_fuel(spark, sf):
    out = rules.low_fuel(events(spark, sf))
    return out.select("vin", ms("ts", "ts_ms"), "seq", detail("fuel_pct", "double").alias("fuel_pct"))


@query(
    "alert_cooldown",
    duck(
        "telemetry_fast",
        then="""+ low AS (SELECT vin, 'LOW_FUEL' AS code, ts_ms, seq, 0 AS pos FROM telemetry_fast WHERE fuel_pct < 10), """
        + _cooled("low") + " SELECT vin, ts_ms FROM cooled WHERE emitted",
    ),
)
def alert_cooldown(spark, sf):
    out = apply_cooldown(rules.low_fuel(events(spark, sf)))
    return out.select("vin", ms("ts", "ts_ms"))


@query(
    "rule_alerts",
    duck(
        "telemetry_fast",
        then="+ " + ", ".join([BRAKES, CODES, IDLE, EWMA, HITS, _cooled("hits")])
        + """ SELECT q.vin, q.code, q.severity, q.ts_ms, q.seq FROM cooled c
              JOIN queue q ON q.vin = c.vin AND q.code = c.code AND q.rn = c.rn WHERE emitted""",
    ),
)
def rule_alerts(spark, sf):
    out = rules.evaluate_rules(events(spark, sf), idle_minutes=IDLE_MINUTES)
    return out.select("vin", "code", "severity", ms("ts", "ts_ms"), "seq")
