"""Queries on the mapping registry and on normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from convoy.functions import fields as fx
from convoy.operators import mapping, normalise as nm, routing
from convoy.operators.mapping import by_vendor, vendor_registry
from convoy.plans.fixtures import duck, view
from convoy.plans.ingest import LINE_REASON, by_oem, payloads
from convoy.plans.registry import ms, query
from convoy.schemas import VENDOR_MAPPINGS
from convoy.session import shared_dir
from convoy.sources import batches, rejects

REGISTRY = {o: {"version": 1, "fields": f} for o, f in VENDOR_MAPPINGS.items()}


def part_registry(spark: SparkSession, sf: str) -> DataFrame:
    spec = F.struct(
        "path", "unit", "scale", "format", F.lit(None).cast("array<string>").alias("truthy"), "split"
    )
    return (
        view(spark, sf, "mapping_fields")
        .groupBy("oem", "version", "active", "arrival")
        .agg(F.map_from_entries(F.collect_list(F.struct("field", spec))).alias("fields"))
    )


@query(
    "mapping_issues",
    duck(
        "mapping_fields",
        then="""+ names AS (SELECT * FROM (VALUES (0,'vin'),(1,'ts'),(2,'lat'),(3,'lon'),(4,'speed_kmh'),(5,'odo_km'),(6,'seq')) t(pos, field)),
        problems AS (
          SELECT oem, version, -1 AS pos, 0 AS step, 'oem:invalid' AS issue FROM mapping_docs
            WHERE NOT regexp_full_match(oem, '[A-Z0-9_-]{1,20}')
          UNION ALL SELECT d.oem, d.version, n.pos, 0, n.field || ':missing' FROM mapping_docs d, names n
            WHERE NOT EXISTS (SELECT 1 FROM mapping_fields f WHERE f.oem = d.oem AND f.version = d.version AND f.field = n.field)
          UNION ALL SELECT oem, version, pos, 1, field || ':path' FROM mapping_fields WHERE length(path) NOT BETWEEN 1 AND 100
          UNION ALL SELECT oem, version, pos, 2, field || ':unit' FROM mapping_fields WHERE unit NOT IN ('kmh','kph','mph','ms','km','mi')
          UNION ALL SELECT oem, version, pos, 3, field || ':scale' FROM mapping_fields WHERE scale <= 0
          UNION ALL SELECT oem, version, pos, 4, field || ':format' FROM mapping_fields WHERE format NOT IN ('epoch_ms','epoch_s','iso','ddmmyyyy_hms')
          UNION ALL SELECT oem, version, pos, 5, field || ':split' FROM mapping_fields WHERE length(split) > 3)
        SELECT d.oem, d.version, count(p.issue) = 0 AS ok,
               coalesce(string_agg(p.issue, ',' ORDER BY p.pos, p.step), '') AS issues
        FROM mapping_docs d LEFT JOIN problems p ON p.oem = d.oem AND p.version = d.version GROUP BY d.oem, d.version""",
    ),
)
def mapping_issues(spark, sf):
    out = mapping.validate_mappings(part_registry(spark, sf))
    return out.select("oem", "version", "ok", F.array_join("issues", ",").alias("issues"))


@query(
    "mapping_register",
    duck(
        "mapping_docs",
        then="""+ top AS (SELECT oem, max(version) AS v FROM mapping_docs WHERE price >= 1 GROUP BY oem)
        SELECT oem, version, active FROM mapping_docs WHERE price >= 1
        UNION ALL
        SELECT d.oem, CAST(coalesce(top.v, 0) + row_number() OVER (PARTITION BY d.oem ORDER BY arrival) AS INT), false
        FROM mapping_docs d LEFT JOIN top ON top.oem = d.oem WHERE price < 1""",
    ),
)
def mapping_register(spark, sf):
    docs = part_registry(spark, sf).join(
        view(spark, sf, "mapping_docs").select("arrival", "price"), "arrival"
    )
    out = mapping.register_mapping(docs.filter("price >= 1"), docs.filter("price < 1"))
    return out.select("oem", "version", "active")


@query(
    "mapping_activate",
    duck(
        "mapping_docs",
        then="""+ pick AS (SELECT oem, version FROM mapping_docs ORDER BY version LIMIT 1)
        SELECT d.oem, d.version, CASE WHEN d.oem = pick.oem THEN d.version = pick.version ELSE active END AS active
        FROM mapping_docs d, pick""",
    ),
)
def mapping_activate(spark, sf):
    docs = part_registry(spark, sf)
    pick = docs.orderBy("version").select("oem", "version").first()
    out = mapping.activate_mapping(docs, pick["oem"], pick["version"])
    return out.select("oem", "version", "active")


@query(
    "mapping_active",
    duck("mapping_docs", then="SELECT oem, max(version) AS version FROM mapping_docs WHERE active GROUP BY oem"),
)
def mapping_active(spark, sf):
    return mapping.active_mappings(part_registry(spark, sf)).select("oem", "version")


@query(
    "mapping_listing",
    duck(
        "mapping_fields",
        then="""SELECT oem, version, active, count(*) AS fields FROM mapping_fields
        GROUP BY oem, version, active ORDER BY oem, version DESC""",
    ),
)
def mapping_listing(spark, sf):
    rows = part_registry(spark, sf).withColumn("fields", F.size("fields").cast("bigint"))
    return mapping.list_mappings(rows.select("oem", "version", "active", "fields"))


# ---- the SQL twin of normalisation: text of every field, then values, then reasons ----

_TEXT = ", ".join(f"{by_oem(f)} AS s_{f}" for f in VENDOR_MAPPINGS["A"] if f != "dtc")
READ = f"""+ read AS (SELECT event_id, copy, arrival, received_ms, vehicle_id, oem, true_vin, line, {_TEXT},
    CASE WHEN oem = 'C' THEN list_filter(string_split(upper(json_extract_string(line, '$.codes')), ';'), lambda x: x <> '')
         ELSE list_transform({by_oem('dtc', "json_extract_string(line, '{p}[*]')").replace("WHEN 'C' THEN json_extract_string(line, '$.codes[*]')", "")}, lambda x: upper(x)) END AS codes
    FROM wire_defects WHERE {LINE_REASON} IS NULL)"""
VALUES = """, vals AS (SELECT *,
    CASE WHEN oem IN ('A', 'E') THEN TRY_CAST(s_ts AS BIGINT)
         WHEN oem = 'D' THEN TRY_CAST(s_ts AS BIGINT) * 1000
         WHEN oem = 'B' THEN CAST(FLOOR(epoch_us(try_strptime(s_ts, '%Y-%m-%dT%H:%M:%S.%gZ')) / 1000.0) AS BIGINT)
         ELSE CAST(FLOOR(epoch_us(try_strptime(s_ts, '%d/%m/%Y %H:%M:%S')) / 1000.0) AS BIGINT) END AS ts_ms,
    upper(s_vin) AS vin, TRY_CAST(s_lat AS DOUBLE) AS lat, TRY_CAST(s_lon AS DOUBLE) AS lon,
    greatest(0, TRY_CAST(s_speed_kmh AS DOUBLE) * CASE WHEN oem IN ('A', 'D') THEN 1.609344e0 WHEN oem = 'C' THEN 3.6e0 ELSE 1e0 END) AS speed_kmh,
    TRY_CAST(s_odo_km AS DOUBLE) * CASE WHEN oem IN ('A', 'D') THEN 1.609344e0 ELSE 1e0 END AS odo_km,
    TRY_CAST(s_fuel_pct AS DOUBLE) * CASE WHEN oem IN ('A', 'E') THEN 100e0 ELSE 1e0 END AS fuel_pct,
    s_engine_on = CASE oem WHEN 'A' THEN 'ON' WHEN 'C' THEN '1' WHEN 'E' THEN 'Y' ELSE 'true' END AS engine_on,
    TRY_CAST(s_rpm AS DOUBLE) AS rpm, upper(nullif(s_evt, '')) AS evt, TRY_CAST(s_seq AS BIGINT) AS seq FROM read)"""
REASONS = """, normalised AS (SELECT *, CASE WHEN oem = 'Z' THEN 'no_mapping' WHEN s_vin IS NULL THEN 'missing:vin'
    WHEN s_ts IS NULL THEN 'missing:ts' WHEN ts_ms IS NULL THEN 'bad_ts'
    WHEN s_lat IS NULL THEN 'missing:lat' WHEN lat IS NULL THEN 'bad_number:lat'
    WHEN s_lon IS NULL THEN 'missing:lon' WHEN lon IS NULL THEN 'bad_number:lon'
    WHEN s_speed_kmh IS NULL THEN 'missing:speed_kmh' WHEN TRY_CAST(s_speed_kmh AS DOUBLE) IS NULL THEN 'bad_number:speed_kmh'
    WHEN s_odo_km IS NULL THEN 'missing:odo_km' WHEN odo_km IS NULL THEN 'bad_number:odo_km'
    WHEN s_seq IS NULL THEN 'missing:seq' WHEN seq IS NULL THEN 'bad_number:seq'
    WHEN vin <> true_vin THEN 'invalid:vin:invalid_vin'
    WHEN lat NOT BETWEEN -90 AND 90 THEN 'invalid:lat:out_of_range'
    WHEN lon NOT BETWEEN -180 AND 180 THEN 'invalid:lon:out_of_range'
    WHEN speed_kmh > 400 THEN 'invalid:speed_kmh:out_of_range'
    WHEN fuel_pct NOT BETWEEN 0 AND 100 THEN 'invalid:fuel_pct:out_of_range'
    WHEN rpm NOT BETWEEN 0 AND 12000 THEN 'invalid:rpm:out_of_range'
    WHEN len(list_filter(codes, lambda x: NOT regexp_full_match(x, '[PBCU][0-3][0-9A-F]{3}'))) > 0 THEN 'invalid:dtc.0:invalid_dtc'
    END AS reason FROM vals)"""
NORMALISED = READ + VALUES + REASONS


def each_vendor(field: str, build):
    """The vendors' column expressions for one field, picked by vendor."""
    return F.coalesce(
        *[F.when(F.col("oem") == oem, build(fields[field])) for oem, fields in VENDOR_MAPPINGS.items()]
    )


@query(
    "payload_paths",
    duck(
        "wire_defects",
        then=READ
        + " SELECT event_id, copy, oem, s_vin, s_odo_km IS NULL AS no_odo, TRY_CAST(s_lat AS DOUBLE) AS lat,"
        " TRY_CAST(s_lon AS DOUBLE) AS lon, s_seq FROM read WHERE oem <> 'Z'",
    ),
)
def payload_paths(spark, sf):

    def text(field: str):
        return by_vendor(REGISTRY, field, lambda s, _: fx.path_sql(s["path"]))

    return payloads(spark, sf).filter(F.col("oem") != "Z").select(
        "event_id", "copy", "oem",
        text("vin").alias("s_vin"),
        text("odo_km").isNull().alias("no_odo"),
        text("lat").try_cast("double").alias("lat"),
        text("lon").try_cast("double").alias("lon"),
        text("seq").alias("s_seq"),
    )


@query(
    "event_times",
    duck("wire_defects", then=READ + VALUES + " SELECT event_id, copy, ts_ms FROM vals WHERE oem <> 'Z'"),
)
def event_times(spark, sf):
    ts = each_vendor(
        "ts", lambda s: fx.parse_ts(fx.extract_path("payload", s["path"]), s.get("format", "iso"))
    )
    rows = payloads(spark, sf).filter(F.col("oem") != "Z")
    return rows.select("event_id", "copy", F.unix_millis(ts).alias("ts_ms"))


@query(
    "required_numbers",
    duck(
        "wire_defects",
        then=READ + VALUES + """ SELECT event_id, copy, round(TRY_CAST(s_speed_kmh AS DOUBLE), 6) AS speed,
            CASE WHEN s_speed_kmh IS NULL THEN 'missing:speed_kmh' WHEN TRY_CAST(s_speed_kmh AS DOUBLE) IS NULL THEN 'bad_number:speed_kmh' END AS speed_reason,
            round(odo_km, 6) AS odo_km, CASE WHEN s_odo_km IS NULL THEN 'missing:odo_km' END AS odo_reason
        FROM vals WHERE oem <> 'Z'""",
    ),
)
def required_numbers(spark, sf):

    def text(field: str):
        return by_vendor(REGISTRY, field, lambda s, _: fx.path_sql(s["path"]))

    factor = each_vendor("odo_km", lambda s: F.lit(fx.unit_factor("distance", s.get("unit"))))
    speed, speed_reason = fx.required_number(text("speed_kmh"), "speed_kmh")
    odo, odo_reason = fx.required_number(text("odo_km"), "odo_km", factor)
    return payloads(spark, sf).filter(F.col("oem") != "Z").select(
        "event_id", "copy",
        F.round(speed, 6).alias("speed"), speed_reason.alias("speed_reason"),
        F.round(odo, 6).alias("odo_km"), odo_reason.alias("odo_reason"),
    )


@query(
    "optional_numbers",
    duck("wire_defects", then=READ + VALUES + " SELECT event_id, copy, round(fuel_pct, 6) AS fuel_pct, rpm FROM vals WHERE oem <> 'Z'"),
)
def optional_numbers(spark, sf):

    def number(field: str):
        return each_vendor(
            field, lambda s: fx.optional_number(fx.extract_path("payload", s["path"]), s.get("scale", 1.0))
        )

    rows = payloads(spark, sf).filter(F.col("oem") != "Z")
    return rows.select(
        "event_id", "copy", F.round(number("fuel_pct"), 6).alias("fuel_pct"), number("rpm").alias("rpm")
    )


@query(
    "unit_conversion",
    duck(
        "telemetry",
        then="""SELECT event_id, round(speed_kmh * 1.609344e0, 6) AS from_mph, round(speed_kmh * 3.6e0, 6) AS from_ms,
            speed_kmh AS from_kph, speed_kmh AS from_km, round(odo_km * 1.609344e0, 6) AS from_mi, odo_km AS from_mph_odo
        FROM telemetry""",
    ),
)
def unit_conversion(spark, sf):
    t = view(spark, sf, "telemetry")
    speed, odo = F.col("speed_kmh"), F.col("odo_km")
    return t.select(
        "event_id",
        F.round(fx.convert_unit(speed, "speed", "mph"), 6).alias("from_mph"),
        F.round(fx.convert_unit(speed, "speed", "ms"), 6).alias("from_ms"),
        fx.convert_unit(speed, "speed", "kph").alias("from_kph"),
        fx.convert_unit(speed, "speed", "km").alias("from_km"),
        F.round(fx.convert_unit(odo, "distance", "mi"), 6).alias("from_mi"),
        fx.convert_unit(odo, "distance", "mph").alias("from_mph_odo"),
    )


@query(
    "fault_code_lists",
    duck(
        "wire_defects",
        then=READ + " SELECT event_id, copy, array_to_string(codes, ',') AS codes, CAST(len(codes) AS INT) AS n FROM read WHERE oem <> 'Z'",
    ),
)
def fault_code_lists(spark, sf):
    codes = each_vendor(
        "dtc",
        lambda s: fx.fault_codes(
            fx.extract_path("payload", s["path"], "array<string>"),
            fx.extract_path("payload", s["path"]),
            fx.kind_of("payload", s["path"]),
            s.get("split", ","),
        ),
    )
    rows = payloads(spark, sf).filter(F.col("oem") != "Z").select("event_id", "copy", codes.alias("c"))
    return rows.select("event_id", "copy", F.array_join("c", ",").alias("codes"), F.size("c").alias("n"))


@query(
    "engine_switch",
    duck("wire_defects", then=READ + VALUES + " SELECT event_id, copy, engine_on FROM vals WHERE oem <> 'Z'"),
)
def engine_switch(spark, sf):
    on = each_vendor(
        "engine_on", lambda s: fx.truthy(fx.extract_path("payload", s["path"]), tuple(s["truthy"]))
    )
    return payloads(spark, sf).filter(F.col("oem") != "Z").select("event_id", "copy", on.alias("engine_on"))


@query(
    "normalised_events",
    duck(
        "wire_defects",
        then=NORMALISED + """ SELECT event_id, copy, oem, vin, ts_ms, round(lat, 6) AS lat, round(lon, 6) AS lon,
            round(speed_kmh, 6) AS speed_kmh, round(odo_km, 6) AS odo_km, round(fuel_pct, 6) AS fuel_pct, engine_on, rpm,
            array_to_string(codes, ',') AS dtc, evt, seq, 1 AS schema_ver FROM normalised WHERE reason IS NULL""",
    ),
)
def normalised_events(spark, sf):
    out = nm.normalise(payloads(spark, sf), vendor_registry(spark)).filter(F.col("reason").isNull())
    rounded = [F.round(c, 6).alias(c) for c in ("lat", "lon", "speed_kmh", "odo_km", "fuel_pct")]
    return out.select(
        "event_id", "copy", "oem", "vin", ms("ts", "ts_ms"), *rounded, "engine_on", "rpm",
        F.array_join("dtc", ",").alias("dtc"), "evt", "seq", "schema_ver",
    )


@query(
    "reject_reasons",
    duck("wire_defects", then=NORMALISED + " SELECT event_id, copy, oem, reason FROM normalised WHERE reason IS NOT NULL"),
)
def reject_reasons(spark, sf):
    out = nm.normalise(payloads(spark, sf), vendor_registry(spark))
    return out.filter(F.col("reason").isNotNull()).select("event_id", "copy", "oem", "reason")


@query(
    "failure_precedence",
    duck("wire_defects", then=NORMALISED + " SELECT reason, count(*) AS n FROM normalised GROUP BY reason"),
)
def failure_precedence(spark, sf):
    return nm.first_failure(nm.normalise(payloads(spark, sf), vendor_registry(spark)))


NULLED = ("vin", "oem", "lat", "lon", "speed_kmh", "odo_km", "engine_on", "dtc", "seq", "schema_ver")
VALIDATION_ROWS = """event_id, vin, oem, ts, lat + k AS lat, lon * 2 + k AS lon, value * 1.5e0 AS speed_kmh,
    odo_km - 1010e0 AS odo_km, fuel_pct * 1.05e0 AS fuel_pct, engine_on, value * 30 AS rpm, dtc, evt, seq - 7 AS seq, 1 AS schema_ver"""


def _nulled(source: str) -> str:
    """Rows of ``source`` with one required field emptied in ten of 23."""
    empty = ", ".join(f"CASE WHEN event_id % 23 = {i} THEN NULL ELSE {c} END AS {c}" for i, c in enumerate(NULLED))
    return f"SELECT event_id, ts, fuel_pct, rpm, evt, {empty} FROM {source}"


def _first_problem() -> str:
    checks = {
        "vin": None, "oem": None, "lat": "lat > 90", "lon": "lon > 180", "speed_kmh": "speed_kmh > 400", "odo_km": "odo_km < 0",
        "fuel_pct": "fuel_pct > 100", "engine_on": None, "rpm": "rpm > 12000", "dtc": None, "seq": "seq < 0", "schema_ver": None,
    }
    arms = []
    for column, bad in checks.items():
        arms += [f"WHEN {column} IS NULL THEN 'invalid:{column}:missing'"] if column in NULLED else []
        arms += [f"WHEN {bad} THEN 'invalid:{column}:out_of_range'"] if bad else []
    return "CASE " + " ".join(arms) + " END"


@query(
    "validation",
    duck(
        "telemetry",
        then=f"""+ whole AS (SELECT {VALIDATION_ROWS.replace('value', 'e.value').replace('ts,', 't.ts,').replace('event_id', 't.event_id')}
            FROM telemetry t JOIN events e ON e.event_id = t.event_id), rows AS ({_nulled('whole')})
        SELECT event_id, {_first_problem()} AS reason FROM rows""",
    ),
)
def validation(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    rows = view(spark, sf, "telemetry").join(events, "event_id").selectExpr(
        *[c.strip() for c in VALIDATION_ROWS.split(",")]
    )
    emptied = {c: F.when(F.col("event_id") % 23 != i, F.col(c)) for i, c in enumerate(NULLED)}
    return nm.validate(rows.withColumns(emptied)).select("event_id", "reason")


AUDIT_VIN = """CASE WHEN k < 10 THEN replace(vin, '1', 'I') WHEN k < 20 THEN substr(vin, 1, 16)
    WHEN k < 30 THEN lower(vin) WHEN k < 40 THEN substr(vin, 1, 8) || 'B' || substr(vin, 10) ELSE vin END"""


@query(
    "vin_audit",
    duck(
        "telemetry",
        then="""SELECT oem, CASE WHEN k < 10 AND contains(vin, '1') THEN 'charset' WHEN k BETWEEN 10 AND 19 THEN 'length'
            WHEN k BETWEEN 30 AND 39 THEN 'check_digit' ELSE 'ok' END AS problem, count(*) AS n FROM telemetry GROUP BY ALL""",
    ),
)
def vin_audit(spark, sf):
    t = view(spark, sf, "telemetry").select("oem", F.expr(AUDIT_VIN).alias("vin"))
    return nm.audit_vins(t)


CANDIDATE = {
    "A": {**VENDOR_MAPPINGS["A"], "speed_kmh": {"path": "velocityMph", "unit": "ms"}},
    "E": {**VENDOR_MAPPINGS["E"], "odo_km": {"path": "odo"}},
}


@query(
    "mapping_preview",
    duck(
        "wire_defects",
        then=NORMALISED.replace("CASE WHEN oem = 'Z' THEN 'no_mapping'", "CASE WHEN oem NOT IN ('A', 'E') THEN 'no_mapping'")
        .replace("WHEN oem IN ('A', 'D') THEN 1.609344e0 WHEN oem = 'C' THEN 3.6e0 ELSE 1e0 END) AS speed_kmh",
                 "WHEN oem = 'A' THEN 3.6e0 ELSE 1e0 END) AS speed_kmh")
        .replace("WHEN s_odo_km IS NULL THEN 'missing:odo_km'", "WHEN s_odo_km IS NULL OR oem = 'E' THEN 'missing:odo_km'")
        + """ SELECT oem, coalesce(reason, 'ok') AS outcome, count(*) AS n FROM normalised GROUP BY ALL""",
    ),
)
def mapping_preview(spark, sf):
    out = nm.preview_mapping(payloads(spark, sf), CANDIDATE)
    return out.groupBy("oem", F.coalesce("reason", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


# ---- routing ----

ROUTED = (
    NORMALISED
    + """, routed AS (SELECT n.* EXCLUDE (reason, vehicle_id), coalesce(reason, CASE WHEN v.vehicle_id IS NULL THEN 'unknown_vehicle' END) AS reason,
        v.vehicle_id, v.fleet_id, f.tenant_id
      FROM normalised n LEFT JOIN vehicle v ON v.vin = n.vin AND v.registered AND n.reason IS NULL
      LEFT JOIN fleet f ON f.fleet_id = v.fleet_id)"""
)


def directory(spark, sf):
    return view(spark, sf, "vehicle").filter("registered"), view(spark, sf, "fleet")


def routed(spark, sf, mappings=None):
    raw = payloads(spark, sf).drop("vehicle_id", "true_vin")
    return routing.route(raw, mappings or REGISTRY, *directory(spark, sf))


@query(
    "route_split",
    duck(
        "wire_defects", "vehicle", "fleet",
        then=ROUTED + " SELECT event_id, copy, oem, reason, vehicle_id, fleet_id, tenant_id FROM routed",
    ),
)
def route_split(spark, sf):
    raw = payloads(spark, sf).drop("vehicle_id", "true_vin")
    accepted, rejected = routing.split_accept_reject(raw, REGISTRY, *directory(spark, sf))
    shown = ["event_id", "copy", "oem", "reason", "vehicle_id", "fleet_id", "tenant_id"]
    accepted = accepted.withColumn("reason", F.lit(None).cast("string"))
    return accepted.select(shown).unionByName(rejected.select(shown))


@query(
    "vehicle_enrichment",
    duck(
        "telemetry", "vehicle", "fleet",
        then="""SELECT t.event_id, v.vehicle_id, v.fleet_id, f.tenant_id, CASE WHEN v.vehicle_id IS NULL THEN 'unknown_vehicle' END AS reason
        FROM telemetry t LEFT JOIN vehicle v ON v.vin = t.vin AND v.registered LEFT JOIN fleet f ON f.fleet_id = v.fleet_id""",
    ),
)
def vehicle_enrichment(spark, sf):
    rows = view(spark, sf, "telemetry").select("event_id", "vin")
    out = routing.enrich_vehicle(rows, *directory(spark, sf))
    return out.select("event_id", "vehicle_id", "fleet_id", "tenant_id", "reason")


@query(
    "dead_letter_counts",
    duck(
        "wire_defects", "vehicle", "fleet",
        then=ROUTED + """ SELECT array_to_string(string_split(reason, ':')[1:2], ':') AS reason, count(*) AS n
            FROM routed WHERE reason IS NOT NULL GROUP BY ALL""",
    ),
)
def dead_letter_counts(spark, sf):
    return routing.dead_letter_counts(routed(spark, sf))


@query(
    "dead_letter_sample",
    duck(
        "wire_defects", "vehicle", "fleet",
        then=ROUTED + """ SELECT event_id, copy, reason FROM routed WHERE reason IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY received_ms // 3600000 ORDER BY arrival) <= 3""",
    ),
)
def dead_letter_sample(spark, sf):
    rejected = routed(spark, sf).filter(F.col("reason").isNotNull())
    # one test second stands for an hour: the fixture rejects less than one row per second
    slow = rejected.withColumn("at", F.timestamp_seconds(F.floor(F.unix_seconds("received_at") / 3600)))
    return routing.sample_dead_letters(slow, "at", per_second=3).select("event_id", "copy", "reason")


@query(
    "invalid_line_sample",
    duck(
        "batches",
        then=f"""+ lines AS (SELECT batch_id, list_filter(list_transform(string_split(text, chr(10)),
                        lambda x: trim(x)), lambda x: x <> '') AS ls FROM batches),
        split AS (SELECT batch_id, CAST(i - 1 AS INT) AS line_no, ls[i] AS line
            FROM (SELECT batch_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines))
        SELECT batch_id, line_no, {LINE_REASON} AS reason FROM split WHERE {LINE_REASON} IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY line_no) <= 20""",
    ),
)
def invalid_line_sample(spark, sf):
    from convoy.sources.ndjson import classify_lines, parse_ndjson

    lines = classify_lines(parse_ndjson(view(spark, sf, "batches")))
    invalid = lines.filter(F.col("reason").isNotNull())
    return routing.sample_invalid_lines(invalid).select("batch_id", "line_no", "reason")


@query(
    "recent_rejects",
    duck(
        "wire_defects", "vehicle", "fleet",
        then=ROUTED + """ SELECT event_id, copy, reason, received_ms FROM routed WHERE reason IS NOT NULL
            ORDER BY received_ms DESC, arrival DESC LIMIT 10""",
    ),
)
def recent_rejects(spark, sf):
    rejected = routed(spark, sf).filter(F.col("reason").isNotNull())
    return routing.recent_rejects(rejected).select("event_id", "copy", "reason", "received_ms")


@query(
    "dead_letter_replay",
    duck(
        "wire_defects", "vehicle", "fleet",
        then=ROUTED + """ SELECT oem, coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM routed
            WHERE reason IS NOT NULL OR oem = 'E' GROUP BY ALL""",
    ),
)
def dead_letter_replay(spark, sf):
    first = {o: m for o, m in REGISTRY.items() if o != "E"}  # E is not onboarded yet
    rejected = routed(spark, sf, first).filter(F.col("reason").isNotNull())
    again = routing.replay_dead_letters(rejected, REGISTRY, *directory(spark, sf))
    return again.groupBy("oem", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("n")
    )


@query(
    "rejects_replayed",
    duck(
        "wire_defects", "vehicle", "fleet",
        then=ROUTED + """ SELECT oem, coalesce(reason, 'accepted') AS outcome, count(*) AS n, oem = 'E' AS read_again FROM routed
            WHERE reason IS NOT NULL OR oem = 'E' GROUP BY ALL""",
    ),
)
def rejects_replayed(spark, sf):
    """Vendor E is onboarded after its rows were rejected: what its letters became, and the letters left, after two replays."""
    first = {o: m for o, m in REGISTRY.items() if o != "E"}
    path, accepted = shared_dir(spark, "rejects"), shared_dir(spark, "replay-accepted")
    raw = ("oem", "line", "arrival", "received_at")
    routes = routed(spark, sf, first).select(*raw, "reason").filter(F.col("reason").isNotNull())
    rejects.store_rejects(routes, 0, path, first, raw)
    read = [rejects.replay_changed(spark, path, accepted, REGISTRY, *directory(spark, sf)) for _ in range(2)]
    passed = batches.read_batches(spark, accepted).select("oem", F.lit("accepted").alias("outcome"))
    left = batches.read_batches(spark, path).select("oem", F.col("reason").alias("outcome"))
    seen = read[0].unionByName(read[1]).select(F.substring_index("part", "~", 1).alias("_oem")).distinct()
    counted = passed.unionByName(left).groupBy("oem", "outcome").agg(F.count("*").alias("n"))
    return counted.join(seen, F.col("oem") == F.col("_oem"), "left").withColumn("read_again", F.col("_oem").isNotNull()).drop("_oem")
