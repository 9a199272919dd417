"""Queries on decoding, storage and retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from convoy.operators.mapping import vendor_registry
from convoy.plans.fixtures import duck, view
from convoy.plans.registry import AS_OF, ms, query
from convoy.schemas import VENDOR_MAPPINGS
from convoy.session import shared_dir
from convoy.sources import batches, ndjson, sinks

LINE_REASON = (
    "CASE WHEN NOT json_valid(line) THEN 'bad_json' WHEN json_type(line) <> 'OBJECT' THEN 'not_object' END"
)


def json_path(path: str) -> str:
    """SQL-side JSONPath of a dotted mapping path."""
    return "$" + "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in path.split("."))


def by_oem(field: str, fn: str = "json_extract_string(line, '{p}')") -> str:
    arms = " ".join(
        f"WHEN '{o}' THEN " + fn.format(p=json_path(m[field]["path"]))
        for o, m in VENDOR_MAPPINGS.items()
    )
    return f"CASE oem {arms} END"


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Readable payloads of the wire rows with injected defects."""
    lines = ndjson.classify_lines(view(spark, sf, "wire_defects"))
    return lines.filter(F.col("reason").isNull()).drop("reason")


@query(
    "ndjson_lines",
    duck(
        "batches",
        then="""+ lines AS (SELECT batch_id, list_filter(list_transform(string_split(text, chr(10)),
                        lambda x: trim(x)), lambda x: x <> '') AS ls FROM batches)
        SELECT batch_id, i > 40 AS truncated, CAST(i - 1 AS INT) AS line_no, ls[i] AS line
        FROM (SELECT batch_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines)""",
    ),
)
def ndjson_lines(spark, sf):
    return ndjson.parse_ndjson(view(spark, sf, "batches"), max_lines=40)


@query(
    "malformed_lines",
    duck(
        "wire_defects",
        then=f"""SELECT event_id, copy, oem, reason, line, CASE WHEN reason IS NOT NULL THEN left(line, 5) END AS shown
        FROM (SELECT *, {LINE_REASON} AS reason FROM wire_defects)""",
    ),
)
def malformed_lines(spark, sf):
    out = ndjson.classify_lines(view(spark, sf, "wire_defects"))
    cut = F.when(F.col("reason").isNotNull(), ndjson.shown("line", 5)).alias("shown")
    return out.select("event_id", "copy", "oem", "reason", "line", cut)


@query(
    "partition_keys",
    duck(
        "wire_defects",
        then=f"""SELECT event_id, copy, oem, coalesce({by_oem('vin')},
            json_extract_string(line, '$.vin'), json_extract_string(line, '$.VIN'),
            json_extract_string(line, '$.vehicleId'), json_extract_string(line, '$.v'),
            json_extract_string(line, '$.chassis')) AS key
        FROM wire_defects WHERE {LINE_REASON} IS NULL""",
    ),
)
def partition_keys(spark, sf):
    out = ndjson.with_partition_key(payloads(spark, sf), vendor_registry(spark))
    return out.select("event_id", "copy", "oem", "key")


ENVELOPE = """'{"oem":"' || oem || '","r":' || CAST(received_ms AS STRING) || ',"p":' || line || '}'"""


@query(
    "envelope_decode",
    duck(
        "wire_defects",
        then=f"""SELECT event_id, copy,
            CASE WHEN json_valid(env) THEN NULL ELSE 'bad_envelope' END AS reason,
            CASE WHEN json_valid(env) THEN oem END AS oem,
            CASE WHEN json_valid(env) THEN received_ms END AS received_ms,
            CASE WHEN json_valid(env) THEN json_type(env, '$.p') = 'OBJECT' END AS is_object
        FROM (SELECT *, {ENVELOPE} AS env FROM wire_defects)""",
    ),
)
def envelope_decode(spark, sf):
    rows = view(spark, sf, "wire_defects").select("event_id", "copy", F.expr(ENVELOPE).alias("value"))
    out = ndjson.decode_envelope(rows)
    return out.select(
        "event_id",
        "copy",
        "reason",
        "oem",
        ms("received_at", "received_ms"),
        F.schema_of_variant("payload").startswith("OBJECT").alias("is_object"),
    )


@query(
    "storage_rows",
    duck(
        "telemetry",
        then="""SELECT fleet_id, vin, ts_ms, CAST(CAST(lat AS FLOAT) AS DOUBLE) AS lat,
            CAST(CAST(lon AS FLOAT) AS DOUBLE) AS lon, CAST(CAST(speed_kmh AS FLOAT) AS DOUBLE) AS speed_kmh,
            odo_km, CAST(CAST(coalesce(fuel_pct, 0) AS FLOAT) AS DOUBLE) AS fuel_pct,
            CAST(engine_on AS INT) AS engine_on, rpm, dtc_code AS dtc, coalesce(evt, '') AS evt, seq, oem
        FROM telemetry""",
    ),
)
def storage_rows(spark, sf):
    rows = sinks.to_storage_rows(view(spark, sf, "telemetry"))
    wide = [F.col(c).cast("double").alias(c) for c in ("lat", "lon", "speed_kmh", "fuel_pct")]
    return rows.select(
        "fleet_id", "vin", ms("ts", "ts_ms"), *wide, "odo_km", "engine_on", "rpm",
        F.array_join("dtc", ",").alias("dtc"), "evt", "seq", "oem",
    )


@query(
    "telemetry_by_day",
    duck(
        "telemetry",
        then="""SELECT strftime(ts, '%Y-%m-%d') AS day, fleet_id, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum
        FROM telemetry GROUP BY ALL""",
    ),
)
def telemetry_by_day(spark, sf):
    path = shared_dir(spark, "telemetry")
    sinks.write_telemetry(view(spark, sf, "telemetry"), path)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "fleet_id").agg(
        F.count("*").alias("n"), F.sum("seq").alias("seq_sum")
    )


@query(
    "replayed_batches",
    duck(
        "arrivals",
        then="""SELECT CAST(copy AS INT) AS batch_id, oem, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum
        FROM arrivals GROUP BY ALL""",
    ),
)
def replayed_batches(spark, sf):
    path = shared_dir(spark, "batches")
    rows = view(spark, sf, "arrivals").drop("dtc")
    for batch in (0, 1, 0, 1):  # the second pass is the replay
        batches.write_batch(rows.filter(F.col("copy") == batch), batch, path)
    return (
        batches.read_batches(spark, path)
        .groupBy(F.col("batch_id").cast("int").alias("batch_id"), "oem")
        .agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum"))
    )


@query(
    "expired_days",
    duck(
        "telemetry",
        then="""SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN strftime(ts, '%Y-%m-%d') < '2024-01-24' THEN 'deleted' ELSE 'kept' END AS fate,
            count(*) AS n, true AS has_bytes FROM telemetry GROUP BY ALL""",
    ),
)
def expired_days(spark, sf):
    """Telemetry of two runs with the same batch numbers, then the days deleted by age and those left on disk."""
    path = shared_dir(spark, "expiring")
    rows = view(spark, sf, "telemetry")
    for run in ("first", "second"):
        for batch in (0, 1):
            part = rows.filter((F.col("event_id") % 4) == 2 * (run == "second") + batch)
            sinks.write_telemetry_batch(part, batch, path, run)
    gone = sinks.expire(spark, path, sinks.RETENTION_DAYS["raw_archive"], AS_OF)
    left = batches.read_batches(spark, path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    deleted = gone.select("day", F.lit("deleted").alias("fate"), F.col("rows").alias("n"), (F.col("bytes") > 0).alias("has_bytes"))
    return deleted.unionByName(left.select("day", F.lit("kept").alias("fate"), "n", F.lit(True).alias("has_bytes")))


@query(
    "tier_moves",
    duck(
        "telemetry",
        then="""+ days AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM telemetry GROUP BY ALL)
        SELECT day, n, seq_sum, true AS has_bytes, tier, CASE tier WHEN 'expired' THEN 'hot' ELSE tier END AS place,
            CASE WHEN tier IN ('warm', 'cold') THEN n ELSE 0 END AS first_moved, CAST(0 AS BIGINT) AS then_moved
        FROM (SELECT *, CASE WHEN day >= '2024-01-24' THEN 'hot' WHEN day >= '2024-01-17' THEN 'warm'
            WHEN day >= '2024-01-10' THEN 'cold' ELSE 'expired' END AS tier FROM days)""",
    ),
)
def tier_moves(spark, sf):
    """Days moved between tier folders twice, what lies where after it, and the rows read back through the manifest."""
    path = shared_dir(spark, "tiered")
    roots = {tier: f"{path}/{tier}" for tier in ("warm", "cold")}
    ages = {"hot": 7, "warm": 14, "cold": 21}
    rows = view(spark, sf, "telemetry")
    for batch in (0, 1):
        sinks.write_telemetry_batch(rows.filter(F.col("event_id") % 2 == batch), batch, path)
    first, then = (sinks.move_tiers(spark, path, roots, AS_OF, ages).groupBy("day").agg(F.sum("rows").alias("n")) for _ in range(2))
    lies = sinks.tier_storage(spark, path, roots, AS_OF, ages)
    read = batches.read_batches(spark, path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"))
    return (
        lies.join(read.agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum")), "day")
        .join(first.withColumnRenamed("n", "first_moved"), "day", "left")
        .join(then.withColumnRenamed("n", "then_moved"), "day", "left")
        .select(
            "day", "n", "seq_sum", (F.col("bytes") > 0).alias("has_bytes"), "tier", "place",
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("first_moved", "then_moved")],
        )
    )


@query(
    "retained_raw",
    duck(
        "telemetry",
        then="SELECT event_id, ts_ms FROM telemetry WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY",
    ),
)
def retained_raw(spark, sf):
    days = sinks.RETENTION_DAYS["raw_archive"]
    kept = sinks.retain(view(spark, sf, "telemetry"), "ts", days, AS_OF)
    return kept.select("event_id", "ts_ms")


@query(
    "storage_tiers",
    duck(
        "alert",
        then="""SELECT CASE WHEN raised_at >= TIMESTAMP '1998-08-02' - INTERVAL 7 DAY THEN 'hot'
                    WHEN raised_at >= TIMESTAMP '1998-08-02' - INTERVAL 90 DAY THEN 'warm'
                    WHEN raised_at >= TIMESTAMP '1998-08-02' - INTERVAL 365 DAY THEN 'cold' ELSE 'expired' END AS tier,
               count(*) AS n, min(raised_ms) AS oldest_ms, max(raised_ms) AS newest_ms
        FROM alert GROUP BY ALL""",
    ),
)
def storage_tiers(spark, sf):
    out = sinks.tier_report(view(spark, sf, "alert"), "raised_at", dt.datetime(1998, 8, 2))
    return out.select("tier", "n", ms("oldest", "oldest_ms"), ms("newest", "newest_ms"))
