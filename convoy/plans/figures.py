"""Queries on the rollup, insights, risk and dashboard figures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from convoy.operators import alerts, insights, risk, risk_tables, rollup
from convoy.operators.numbering import exact_quantiles
from convoy.operators.state import latest_state
from convoy.plans.fixtures import BASE_MS, duck, view
from convoy.plans.registry import AS_OF, ms, query
from convoy.session import staged

HOUR_MS = 3_600_000
DAYS = 30


def _rollup_sql(source: str, codes: str = "dtc_code <> ''") -> str:
    return f"""rolled AS (SELECT fleet_id, vin, (ts_ms // {HOUR_MS}) * {HOUR_MS} AS hour_ms, count(*) AS event_count,
        count(*) FILTER (engine_on AND speed_kmh < 1) AS idle_events, count(*) FILTER (evt = 'HARSH_BRAKE') AS harsh_events,
        count(*) FILTER ({codes}) AS dtc_events, count(*) FILTER (speed_kmh > 110) AS overspeed_events,
        count(*) FILTER (coalesce(fuel_pct, 0) < 10) AS lowfuel_events,
        min(odo_km) AS odo_min, max(odo_km) AS odo_max, max(speed_kmh) AS max_speed
      FROM {source} GROUP BY ALL)"""


ROLLED = _rollup_sql("telemetry")
ROLLED_SPARSE = _rollup_sql("telemetry_sparse")
ROLLUP_COLUMNS = [*rollup.ROLLUP_COUNTS, "odo_min", "odo_max", "max_speed"]
SINCE = BASE_MS + 23 * 86400000  # seven days before 2024-01-31


def rolled(spark, sf, source="telemetry"):
    return rollup.hourly_rollup(view(spark, sf, source))


def shown_rollup(df):
    return df.select("fleet_id", "vin", ms("hour", "hour_ms"), *ROLLUP_COLUMNS)


@query("hourly_rollup", duck("telemetry", then="+ " + ROLLED + " SELECT * FROM rolled"))
def hourly_rollup(spark, sf):
    return shown_rollup(rolled(spark, sf))


@query("merged_rollup", duck("telemetry", then="+ " + ROLLED + " SELECT * FROM rolled"))
def merged_rollup(spark, sf):
    t = view(spark, sf, "telemetry")
    batches = [t.filter(F.col("oem").isin("A", "B")), t.filter(F.col("oem") == "C"), t.filter(F.col("oem") > "C")]
    return shown_rollup(rollup.merge_rollups(*[rollup.hourly_rollup(b) for b in batches]))


@query("trailing_rollup", duck("telemetry", then="+ " + ROLLED + f" SELECT fleet_id, vin, hour_ms, event_count FROM rolled WHERE hour_ms >= {BASE_MS + 30 * 86400000 - 48 * HOUR_MS}"))
def trailing_rollup(spark, sf):
    out = insights.trailing(rolled(spark, sf), "hour", AS_OF, hours=48)
    return out.select("fleet_id", "vin", ms("hour", "hour_ms"), "event_count")


COST = """CAST(round(CAST(idle AS DECIMAL(18,0)) / 3600, 3) AS DOUBLE) AS idle_hours,
    CAST(round(idle * 0.8 / 3600, 3) AS DOUBLE) AS litres, CAST(round(idle * 0.8 * 95 / 3600, 2) AS DOUBLE) AS cost"""


@query(
    "idle_cost",
    duck(
        "telemetry",
        then="+ " + ROLLED + f", per_vin AS (SELECT vin, CAST(sum(idle_events) * 60 AS BIGINT) AS idle FROM rolled GROUP BY vin) SELECT vin, idle, {COST} FROM per_vin",
    ),
)
def idle_cost(spark, sf):
    per_vin = rolled(spark, sf).groupBy("vin").agg((F.sum("idle_events") * 60).alias("idle"))
    return insights.with_idle_cost(per_vin)


@query(
    "idling_top",
    duck(
        "telemetry",
        then="+ " + ROLLED + f""", top AS (SELECT vin, CAST(sum(idle_events) AS BIGINT) AS idle, CAST(sum(event_count) AS BIGINT) AS n FROM rolled
            WHERE hour_ms >= {SINCE} GROUP BY vin HAVING sum(idle_events) > 0 ORDER BY idle DESC, vin LIMIT 10)
        SELECT vin, idle, n, round(idle / n, 6) AS idle_ratio, {COST} FROM top""",
    ),
)
def idling_top(spark, sf):
    out = insights.idling_top(rolled(spark, sf), AS_OF)
    return out.withColumn("idle_ratio", F.round("idle_ratio", 6))


@query(
    "idling_by_fleet",
    duck(
        "telemetry",
        then="+ " + ROLLED + f""", per_fleet AS (SELECT fleet_id, CAST(sum(idle_events) AS BIGINT) AS idle FROM rolled WHERE hour_ms >= {SINCE} GROUP BY fleet_id)
        SELECT fleet_id, idle, round(idle / max(idle) OVER (), 6) AS share_of_max, {COST} FROM per_fleet""",
    ),
)
def idling_by_fleet(spark, sf):
    out = insights.idling_by_fleet(rolled(spark, sf), AS_OF)
    return out.withColumn("share_of_max", F.round("share_of_max", 6))


@query(
    "idling_total",
    duck(
        "telemetry",
        then="+ " + ROLLED + f""", total AS (SELECT CAST(sum(idle_events) AS BIGINT) AS idle, CAST(sum(event_count) AS BIGINT) AS n FROM rolled WHERE hour_ms >= {SINCE})
        SELECT idle, n, round(idle / n, 6) AS idle_ratio, {COST} FROM total""",
    ),
)
def idling_total(spark, sf):
    out = insights.idling_total(rolled(spark, sf), AS_OF)
    return out.withColumn("idle_ratio", F.round("idle_ratio", 6))


@query(
    "utilisation",
    duck(
        "telemetry",
        then="+ " + ROLLED + f"""SELECT vin, round(max(odo_max) - min(odo_min), 2) AS distance_km,
            CAST(round(CAST(sum(event_count) - sum(idle_events) AS DECIMAL(18,0)) / 3600, 3) AS DOUBLE) AS active_hours,
            round(max(max_speed), 1) AS max_speed_kmh FROM rolled WHERE hour_ms >= {SINCE}
        GROUP BY vin ORDER BY max(odo_max) - min(odo_min) DESC, vin LIMIT 10""",
    ),
)
def utilisation(spark, sf):
    return insights.utilisation(rolled(spark, sf), AS_OF)


# ---- risk ----

FEATURES = (
    "+ " + ROLLED_SPARSE
    + f""", agg AS (SELECT vin, sum(event_count) AS n, sum(idle_events) AS idle, sum(harsh_events) AS harsh, sum(dtc_events) AS dtc,
        sum(overspeed_events) AS over_n, sum(lowfuel_events) AS low, max(odo_max) - min(odo_min) AS km, max(odo_max) AS odo,
        (max(hour_ms) - min(hour_ms)) / 1000 + 3600 AS secs FROM rolled WHERE hour_ms >= {BASE_MS} GROUP BY vin HAVING sum(event_count) >= 30),
    features AS (SELECT vin, idle / n AS idle_ratio, harsh / n AS harsh_ratio, dtc / n AS dtc_ratio, over_n / n AS overspeed_ratio,
        low / n AS lowfuel_ratio, km / (secs / 3600) AS km_per_hour, odo AS odo_km, dtc, harsh FROM agg),
    risked AS (SELECT *, greatest(0e0, least(1e0, (dtc_ratio * 400 + harsh_ratio * 300 + idle_ratio * 1.5e0 + overspeed_ratio * 20 + lowfuel_ratio) / 10)) AS risk FROM features),
    labelled AS (SELECT r.*, CAST((v.vehicle_id * 7919) % 10 < CASE WHEN round(risk, 6) > 0.3 THEN 6 ELSE 2 END AS INT) AS label
        FROM risked r JOIN vehicle v ON v.vin = r.vin)"""
)


def features(spark, sf, cap=None):
    return risk.risk_features(rolled(spark, sf, "telemetry_sparse"), AS_OF, days=DAYS, cap=cap)


def labelled(spark, sf):
    scored = risk.rule_risk(features(spark, sf))
    ids = view(spark, sf, "vehicle").select("vin", "vehicle_id")
    odds = F.when(F.round("risk", 6) > 0.3, 6).otherwise(2)
    return scored.join(ids, "vin").withColumn(
        "label", ((F.col("vehicle_id") * 7919) % 10 < odds).cast("int")
    ).drop("vehicle_id")


def duck_risk(then: str) -> str:
    return duck("telemetry_sparse", "vehicle", then=FEATURES + then)


SIX = "round({0}, 6) AS {0}"


@query(
    "risk_features",
    duck_risk(" SELECT vin, " + ", ".join(SIX.format(f) for f in risk.RISK_FEATURES) + " FROM features"),
)
def risk_features(spark, sf):
    return features(spark, sf).select("vin", *[F.round(f, 6).alias(f) for f in risk.RISK_FEATURES])


@query("rule_risk", duck_risk(" SELECT vin, round(risk, 6) AS risk FROM risked"))
def rule_risk(spark, sf):
    return risk.rule_risk(features(spark, sf)).select("vin", F.round("risk", 6).alias("risk"))


@query("risk_ranking", duck_risk(" SELECT vin, round(risk, 4) AS risk, 'rules_fallback' AS source FROM risked ORDER BY risked.risk DESC, vin LIMIT 10"))
def risk_ranking(spark, sf):
    return risk.risk_ranking(features(spark, sf)).select("vin", "risk", "source")


GRID = "(SELECT i, 0.05e0 + 0.85e0 * i / 59 AS t FROM range(60) r(i))"


@query(
    "best_threshold",
    duck_risk(
        f""", per_t AS (SELECT i, t, count(*) FILTER (risk >= t AND label = 1) AS tp, count(*) FILTER (risk >= t AND label = 0) AS fp,
            count(*) FILTER (risk < t AND label = 1) AS fn FROM labelled, {GRID} g GROUP BY i, t),
        f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0e0 END AS f1 FROM per_t)
        SELECT round(t, 6) AS threshold, round(f1, 6) AS f1, tp, fp, fn FROM f ORDER BY f.f1 DESC, i LIMIT 1"""
    ),
)
def best_threshold(spark, sf):
    out = risk.best_threshold(labelled(spark, sf))
    return out.select(F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"), "tp", "fp", "fn")


@query(
    "rule_baseline",
    duck_risk(
        """, cuts AS (SELECT i, quantile_cont(dtc_ratio, 0.5 + 0.49 * i / 24) AS d, quantile_cont(harsh_ratio, 0.5 + 0.49 * i / 24) AS h
              FROM labelled, range(25) r(i) GROUP BY i),
        pairs AS (SELECT a.i AS ai, b.i AS bi, a.d, b.h FROM cuts a, cuts b),
        counts AS (SELECT ai, bi, d, h, count(*) FILTER ((dtc_ratio > d OR harsh_ratio > h) AND label = 1) AS tp,
            count(*) FILTER ((dtc_ratio > d OR harsh_ratio > h) AND label = 0) AS fp,
            count(*) FILTER (NOT (dtc_ratio > d OR harsh_ratio > h) AND label = 1) AS fn FROM labelled, pairs GROUP BY ALL),
        f AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS f1 FROM counts WHERE tp > 0)
        SELECT round(d, 6) AS dtc_cut, round(h, 6) AS harsh_cut, round(f1, 6) AS f1, tp, fp, fn FROM f ORDER BY f.f1 DESC, ai, bi LIMIT 1"""
        .replace("quantile_cont(dtc_ratio, 0.5 + 0.49 * i / 24)", "any_value(q_d[i + 1])")
        .replace("quantile_cont(harsh_ratio, 0.5 + 0.49 * i / 24)", "any_value(q_h[i + 1])")
        .replace(
            "FROM labelled, range(25) r(i) GROUP BY i",
            "FROM (SELECT quantile_cont(dtc_ratio, [QS]) AS q_d, quantile_cont(harsh_ratio, [QS]) AS q_h FROM labelled) q, range(25) r(i) GROUP BY i",
        )
        .replace("[QS]", "[" + ", ".join(repr(0.5 + 0.49 * i / 24) for i in range(25)) + "]")
    ),
)
def rule_baseline(spark, sf):
    out = risk.rule_baseline(labelled(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in ("dtc_cut", "harsh_cut", "f1")], "tp", "fp", "fn")


@query(
    "binary_metrics",
    duck_risk(
        """, m AS (SELECT count(*) FILTER (risk >= 0.3 AND label = 1) AS tp, count(*) FILTER (risk >= 0.3 AND label = 0) AS fp,
              count(*) FILTER (risk < 0.3 AND label = 1) AS fn FROM labelled),
        auc AS (SELECT sum(CASE WHEN a.risk > b.risk THEN 1e0 WHEN a.risk = b.risk THEN 0.5e0 ELSE 0e0 END) / count(*) AS v
              FROM labelled a, labelled b WHERE a.label = 1 AND b.label = 0)
        SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
            round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(v, 6) AS roc_auc FROM m, auc"""
    ),
)
def binary_metrics(spark, sf):
    out = risk.binary_metrics(labelled(spark, sf), 0.3)
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "roc_auc")])


@query(
    "speed_quantiles",
    duck(
        "telemetry",
        then="""+ q AS (SELECT quantile_cont(speed_kmh, [0.5, 0.9, 0.95, 0.99]) AS v FROM telemetry)
        SELECT CAST(i AS INT) AS i, round(v[i + 1], 6) AS value FROM q, range(4) r(i)""",
    ),
)
def speed_quantiles(spark, sf):
    out = exact_quantiles(view(spark, sf, "telemetry"), "speed_kmh", [0.5, 0.9, 0.95, 0.99])
    return out.select("i", F.round("value", 6).alias("value"))


def _split(spark, sf):
    return risk.stratified_split(labelled(spark, sf))


@query(
    "train_test_split",
    duck_risk(
        """, per AS (SELECT label, count(*) AS n, CAST(ceil(0.25e0 * (count(*) - 1)) AS BIGINT) AS k FROM labelled GROUP BY label)
        SELECT label, true AS is_test, k AS n FROM per WHERE k > 0 UNION ALL SELECT label, false, n - k FROM per"""
    ),
)
def train_test_split(spark, sf):
    return _split(spark, sf).groupBy("label", "is_test").agg(F.count("*").alias("n"))


@query("risk_model_scores")
def risk_model_scores(spark, sf):
    rows = _split(spark, sf)
    model = risk.train_risk_model(rows.filter("NOT is_test"))
    return risk.score(rows.filter("is_test").drop("risk"), model).select("vin", "label", F.round("risk", 6).alias("risk"))


@query("risk_model_tables", duck_risk(" SELECT vin, label, true AS same, true AS in_range FROM labelled"))
def risk_model_tables(spark, sf):
    """Every vehicle scored from the exported trees, against the model itself."""
    rows = staged(_split(spark, sf))
    model = risk.train_risk_model(rows.filter("NOT is_test"))
    features = rows.drop("risk")
    own = risk.score(features, model).select("vin", F.col("risk").alias("own"))
    by_table = risk_tables.score_by_table(features, risk_tables.export_trees(spark, model))
    same, in_range = F.abs(F.col("risk") - F.col("own")) < 1e-9, F.col("risk").between(0, 1)
    return by_table.join(own, "vin").select("vin", "label", same.alias("same"), in_range.alias("in_range"))


@query("risk_model_report")
def risk_model_report(spark, sf):
    out = risk.evaluate_model(labelled(spark, sf))
    return out.select("method", "tp", "fp", "fn", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "roc_auc")])


# ---- dashboard ----


@query(
    "summary",
    duck(
        "arrivals", "alert", "vehicle", "fleet",
        then="""+ latest AS (SELECT vin, max(ts) AS ts FROM arrivals GROUP BY vin),
        own AS (SELECT v.* FROM vehicle v JOIN fleet f USING (fleet_id) WHERE f.tenant_id = 2),
        idle AS (SELECT count(*) AS idle FROM (SELECT DISTINCT vin, seq, ts, ts_ms, engine_on, speed_kmh FROM arrivals) a JOIN own ON own.vin = a.vin
            WHERE engine_on AND speed_kmh < 1 AND (ts_ms // 3600000) * 3600000 >= """ + str(SINCE) + """)
        SELECT (SELECT count(*) FROM latest l JOIN own USING (vin) WHERE l.ts >= TIMESTAMP '2024-01-30 12:00:00') AS active_vehicles,
               (SELECT count(*) FROM alert a JOIN own ON own.vehicle_id = a.vehicle_id WHERE a.status = 'open') AS open_alerts,
               (SELECT count(*) FROM arrivals a JOIN own ON own.vin = a.vin WHERE received_ms >= 1706659199000 AND received_ms < 1706659200000) AS events_per_sec,
               (SELECT CAST(round(idle * 0.8 * 95 / 3600, 2) AS DOUBLE) FROM idle) AS idle_cost_7d""",
    ),
)
def summary(spark, sf):
    from convoy.operators.dedup import dedup_exact
    from convoy.operators.state import for_tenant

    fleet, vehicle = view(spark, sf, "fleet"), view(spark, sf, "vehicle")
    own = for_tenant(vehicle, fleet, 2).select("vin", F.col("fleet_id").alias("own_fleet"))
    stored = (
        view(spark, sf, "arrivals").join(own, "vin").drop("fleet_id").withColumnRenamed("own_fleet", "fleet_id")
    )
    counts = alerts.open_alert_counts(view(spark, sf, "alert"), vehicle, fleet, ["tenant_id"])
    return insights.summary(
        latest_state(stored),
        counts.filter("tenant_id = 2"),
        rollup.hourly_rollup(dedup_exact(stored)),
        stored,
        AS_OF,
        active_seconds=12 * 3600,
    )


KPI = """hourly AS (SELECT oem AS series, CAST(ts_ms // 3600000 AS BIGINT) AS "at", count(*) AS value FROM telemetry GROUP BY ALL)"""


@query(
    "kpi_trend",
    duck(
        "telemetry",
        then="+ " + KPI + """, changes AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY "at") AS prev FROM hourly),
        tail AS (SELECT * FROM changes WHERE prev IS NULL OR prev <> value QUALIFY row_number() OVER (PARTITION BY series ORDER BY "at" DESC) <= 24),
        ends AS (SELECT series, count(*) AS points, arg_min(value, "at") AS first, arg_max(value, "at") AS last FROM tail GROUP BY series),
        p AS (SELECT *, CASE WHEN points >= 2 AND first <> 0 THEN (last - first) / abs(first) * 100 END AS pct FROM ends)
        SELECT series, points, first, last,
            CASE WHEN points < 2 THEN 'none' WHEN coalesce(abs(pct) < 1, true) THEN 'steady' WHEN pct > 0 THEN 'up' ELSE 'down' END AS direction,
            CASE WHEN coalesce(abs(pct) < 1, true) THEN 'neutral' WHEN pct > 0 THEN 'success' ELSE 'critical' END AS variant,
            CASE WHEN NOT coalesce(abs(pct) < 1, true) THEN round(abs(pct), 1) END AS pct FROM p""",
    ),
)
def kpi_trend(spark, sf):
    hour = F.floor(F.unix_seconds("ts") / F.lit(3600)).alias("at")
    series = view(spark, sf, "telemetry").groupBy(F.col("oem").alias("series"), hour).agg(F.count("*").alias("value"))
    return insights.kpi_trend(series, bucket=48)
