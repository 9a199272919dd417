"""Queries that run the streaming forms over the given tables, replayed in time order."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from convoy.operators.mapping import vendor_registry
from convoy.plans.figures import ROLLED, shown_rollup
from convoy.plans.fixtures import BASE_MS, duck, view
from convoy.plans.mappings import NORMALISED, ROUTED, directory
from convoy.plans.registry import ms, query
from convoy.plans.rule_checks import BRAKES, CODES, EWMA, HITS, IDLE, IDLE_MINUTES, _cooled
from convoy.session import shared_dir
from convoy.sources import streams
from convoy.sources.batches import read_batches, write_batch
from convoy.sources.finished import read_finished
from convoy.streaming import pipeline, rules, state

RAW = ("oem", "received_at", "line", "arrival")


def replayed(
    spark: SparkSession,
    df: DataFrame,
    order: str,
    name: str,
    start: Callable[[DataFrame, str, str], None],
    parts: int = 2,
    swapped: bool = False,
) -> str:
    """Land a table stretch by stretch and catch up after each, on one checkpoint.

    ``swapped`` lands the third stretch before the second. ``start(stream, checkpoint, sink)`` runs the query until it has caught up. Returns the sink folder.
    """
    data, checkpoint = streams.scratch(spark, name)
    source, sink = f"{data}/source", f"{data}/sink"
    pieces = streams.stretches(df, order, parts)
    if swapped:
        pieces[1], pieces[2] = pieces[2], pieces[1]
    for stretch in pieces:
        stretch.write.mode("append").parquet(source)
        stream = streams.read_raw_stream(spark, source, df.schema, max_files_per_trigger=1000)
        start(stream, checkpoint, sink)
    return sink


@query("raw_stream", duck("wire_defects", then="SELECT oem, count(*) AS n, min(received_ms) AS first_ms, max(received_ms) AS last_ms FROM wire_defects GROUP BY oem"))
def raw_stream(spark, sf):
    """An archive of finished batches followed by its offsets; the stream stops in the middle and goes on."""
    rows = view(spark, sf, "wire_defects").select(*RAW)
    data, checkpoint = streams.scratch(spark, "raw")
    sink = f"{data}/sink"
    for i, stretch in enumerate(streams.stretches(rows, "arrival", 2)):
        write_batch(stretch, i, f"{data}/archive")
        streams.run_available(read_finished(spark, f"{data}/archive", rows.schema), checkpoint, sink)
    at = F.unix_millis("received_at")
    return spark.read.parquet(sink).groupBy("oem").agg(
        F.count("*").alias("n"), F.min(at).alias("first_ms"), F.max(at).alias("last_ms")
    )


@query("dedup_stream", duck("arrivals", then="SELECT DISTINCT vin, seq, ts_ms FROM arrivals"))
def dedup_stream(spark, sf):
    rows = view(spark, sf, "arrivals").select("vin", "seq", "ts", "received_at", "arrival")
    sink = replayed(
        spark, rows, "arrival", "dedup",
        lambda stream, checkpoint, sink: streams.run_available(
            stream, checkpoint, each_batch=state.dedup_batches(sink)
        ),
        parts=6, swapped=True,
    )
    return read_batches(spark, f"{sink}/rows").select("vin", "seq", ms("ts", "ts_ms"))


#: Milliseconds after a row at which further copies of it arrive, in the horizon test.
AGAIN = (0, 1_800_000, 3_599_000, 3_600_000, 5_400_000, 7_300_000, 18_000_000)


@query(
    "dedup_horizon_stream",
    duck(
        "arrivals",
        then=f"""+ again AS (SELECT a.vin, a.seq, a.ts_ms, a.received_ms + d.after AS received_ms
            FROM arrivals a JOIN (VALUES {', '.join(f'({x})' for x in AGAIN)}) d(after) ON d.after = 0 OR a.event_id % 10 = 3),
        queue AS (SELECT *, row_number() OVER (PARTITION BY vin, seq, ts_ms ORDER BY received_ms) AS rn FROM again),
        walk AS (SELECT vin, seq, ts_ms, rn, received_ms, true AS kept, received_ms AS stored FROM queue WHERE rn = 1
          UNION ALL
          SELECT q.vin, q.seq, q.ts_ms, q.rn, q.received_ms, q.received_ms - w.stored >= 3600000,
            CASE WHEN q.received_ms - w.stored >= 3600000 THEN q.received_ms ELSE w.stored END
          FROM walk w JOIN queue q ON q.vin = w.vin AND q.seq = w.seq AND q.ts_ms = w.ts_ms AND q.rn = w.rn + 1)
        SELECT vin, seq, ts_ms, received_ms FROM walk WHERE kept""",
    ),
)
def dedup_horizon_stream(spark, sf):
    """Copies up to five hours apart, in order of arrival, in six batches: the memory follows each key's first store."""
    rows = view(spark, sf, "arrivals").select("event_id", "vin", "seq", "ts", "received_ms")
    after = F.explode(F.when(F.col("event_id") % 10 == 3, F.array(*[F.lit(x) for x in AGAIN])).otherwise(F.array(F.lit(0))))
    rows = rows.select("vin", "seq", "ts", "received_ms", after.alias("after")).withColumn("received_ms", F.col("received_ms") + F.col("after"))
    rows = rows.select("vin", "seq", "ts", F.timestamp_millis("received_ms").alias("received_at"), F.col("received_ms").alias("arrival"))
    sink = replayed(
        spark, rows, "arrival", "horizon",
        lambda stream, checkpoint, sink: streams.run_available(
            stream, checkpoint, each_batch=state.dedup_batches(sink)
        ),
        parts=6,
    )
    return read_batches(spark, f"{sink}/rows").select("vin", "seq", ms("ts", "ts_ms"), ms("received_at", "received_ms"))


@query("latest_stream", duck("arrivals", then="SELECT vin, event_id, ts_ms FROM arrivals QUALIFY row_number() OVER (PARTITION BY vin ORDER BY ts DESC, arrival) = 1"))
def latest_stream(spark, sf):
    rows = view(spark, sf, "arrivals").select("vin", "event_id", "ts", "arrival")
    sink = replayed(
        spark, rows, "arrival", "latest",
        lambda stream, checkpoint, sink: streams.run_available(
            stream, checkpoint, each_batch=state.latest_partials(sink)
        ),
    )
    return state.read_latest(spark, sink).select("vin", "event_id", ms("ts", "ts_ms"))


ROLLUP_INPUT = ("fleet_id", "vin", "ts", "ts_ms", "engine_on", "speed_kmh", "evt", "dtc", "fuel_pct", "odo_km")


@query("rollup_partials_stream", duck("telemetry", then="+ " + ROLLED + " SELECT * FROM rolled"))
def rollup_partials_stream(spark, sf):
    rows = view(spark, sf, "telemetry").select(*ROLLUP_INPUT)
    sink = replayed(
        spark, rows, "ts_ms", "partials",
        lambda stream, checkpoint, sink: streams.run_available(
            stream, checkpoint, each_batch=state.rollup_partials(sink)
        ),
    )
    return shown_rollup(state.read_rollup(spark, sink))


@query("rollup_window_stream", duck("telemetry", then="+ " + ROLLED + " SELECT * FROM rolled"))
def rollup_window_stream(spark, sf):
    """In order of arrival, a part of it 36 hours late, and with one stretch before its time."""
    rows = view(spark, sf, "arrivals").filter("copy = 0").select(*ROLLUP_INPUT, "arrival")
    sink = replayed(
        spark, rows, "arrival", "windows",
        lambda stream, checkpoint, sink: streams.run_available(
            state.hourly_rollup_stream(stream), checkpoint, mode="update", each_batch=state.updated_rows(sink)
        ),
        parts=6, swapped=True,
    )
    return shown_rollup(state.read_updated(spark, sink))


@query("rollup_bounded_stream", duck("telemetry", then="+ " + ROLLED + " SELECT * FROM rolled"))
def rollup_bounded_stream(spark, sf):
    """The window with a watermark of six hours; rows of hours that it has left, 36 hours late or out of order, come from the side table."""
    rows = view(spark, sf, "arrivals").filter("copy = 0").select(*ROLLUP_INPUT, "arrival")
    late = dt.timedelta(hours=6)
    windows, behind = streams.scratch(spark, "bounded")

    def start(stream: DataFrame, checkpoint: str, sink: str) -> None:
        streams.run_available(stream, checkpoint, each_batch=state.route_late(sink, late))
        on_time = read_finished(spark, f"{sink}/on_time", rows.schema)
        streams.run_available(
            state.hourly_rollup_stream(on_time, "6 hours"), behind, mode="update", each_batch=state.updated_rows(windows)
        )

    sink = replayed(spark, rows, "arrival", "routed", start, parts=4, swapped=True)
    return shown_rollup(state.read_window_rollup(spark, windows, f"{sink}/late"))


def _alert_sink(spark, sf, shape: Callable[[DataFrame], DataFrame] = lambda alerts: alerts) -> str:
    """Folder of the alerts of the replayed telemetry, each batch of them passed through ``shape``."""
    rules.use_rocksdb(spark)
    rows = view(spark, sf, "telemetry_fast").select(
        "vin", "ts", "ts_ms", "seq", "engine_on", "speed_kmh", "evt", "dtc", "fuel_pct"
    )

    def start(stream: DataFrame, checkpoint: str, sink: str) -> None:
        alerts = rules.evaluate_rules_stream(stream, idle_minutes=IDLE_MINUTES)
        streams.run_available(shape(alerts), checkpoint, sink)

    return replayed(spark, rows, "ts_ms", "rules", start)


ALERT_SQL = (
    "+ " + ", ".join([BRAKES, CODES, IDLE, EWMA, HITS, _cooled("hits")])
    + """, alerts AS (SELECT q.vin, q.code, q.severity, q.ts_ms, q.seq FROM cooled c
          JOIN queue q ON q.vin = c.vin AND q.code = c.code AND q.rn = c.rn WHERE emitted)"""
)


@query("rule_alerts_stream", duck("telemetry_fast", then=ALERT_SQL + " SELECT * FROM alerts"))
def rule_alerts_stream(spark, sf):
    sink = _alert_sink(spark, sf)
    return spark.read.parquet(sink).select("vin", "code", "severity", ms("ts", "ts_ms"), "seq")


@query(
    "alert_feed_stream",
    duck(
        "telemetry_fast", "vehicle", "fleet",
        then=ALERT_SQL + """ SELECT a.vin, code, ts_ms, f.tenant_id FROM alerts a JOIN vehicle v ON v.vin = a.vin
            JOIN fleet f USING (fleet_id) WHERE f.tenant_id = 2""",
    ),
)
def alert_feed_stream(spark, sf):
    owners = view(spark, sf, "vehicle").join(view(spark, sf, "fleet"), "fleet_id").select("vin", "tenant_id")
    sink = _alert_sink(spark, sf, lambda alerts: state.alert_feed(alerts.join(owners, "vin"), 2))
    return spark.read.parquet(sink).select("vin", "code", ms("ts", "ts_ms"), "tenant_id")


HALF_MS = BASE_MS + 15 * 86400000


@query(
    "hot_reload_stream",
    duck(
        "wire_defects",
        then=NORMALISED + f""" SELECT oem, CASE WHEN oem = 'E' AND received_ms < {HALF_MS} THEN 'no_mapping' ELSE coalesce(reason, 'ok') END AS outcome, count(*) AS n
            FROM normalised GROUP BY ALL
        UNION ALL SELECT oem, CASE WHEN json_valid(line) THEN 'not_object' ELSE 'bad_json' END, count(*) FROM wire_defects
            WHERE NOT json_valid(line) OR json_type(line) <> 'OBJECT' GROUP BY ALL""",
    ),
)
def hot_reload_stream(spark, sf):
    """One streaming query, two runs: vendor E is activated between them."""
    rows = view(spark, sf, "wire_defects").select(*RAW, "received_ms")
    data, checkpoint = streams.scratch(spark, "reload")
    source, sink, registry = f"{data}/source", f"{data}/sink", f"{data}/registry"
    for before, vendors in ((True, ("A", "B", "C", "D")), (False, ("A", "B", "C", "D", "E"))):
        pipeline.write_registry(vendor_registry(spark, vendors), registry)
        early = F.col("received_ms") < HALF_MS
        rows.filter(early if before else ~early).write.mode("append").parquet(source)
        stream = streams.read_raw_stream(spark, source, rows.schema, max_files_per_trigger=100)
        streams.run_available(stream, checkpoint, each_batch=pipeline.normalise_stream(sink, registry))
    return (
        read_batches(spark, sink)
        .groupBy("oem", F.coalesce("reason", F.lit("ok")).alias("outcome"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "ingest_stream",
    duck(
        "wire_defects", "vehicle", "fleet",
        then=ROUTED + """, bad AS (SELECT oem FROM wire_defects WHERE NOT json_valid(line) OR json_type(line) <> 'OBJECT')
        SELECT 'telemetry' AS part, oem, count(DISTINCT (vin, seq, ts_ms)) AS n FROM routed WHERE reason IS NULL GROUP BY ALL
        UNION ALL SELECT 'dead', oem, count(*) FROM (SELECT oem FROM routed WHERE reason IS NOT NULL UNION ALL SELECT oem FROM bad) GROUP BY ALL""",
    ),
)
def ingest_stream(spark, sf):
    rows = view(spark, sf, "wire_defects").select(*RAW)
    tables, body = _write_path(spark, sf)
    replayed(
        spark, rows, "arrival", "ingest",
        lambda stream, checkpoint, _: streams.run_available(stream, checkpoint, each_batch=body),
    )
    counts = [
        read_batches(spark, path).groupBy("oem").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "oem", "n")
        for part, path in (("telemetry", tables.path("telemetry")), ("dead", tables.path("dead")))
    ]
    return counts[0].unionByName(counts[1])


def _write_path(spark, sf):
    """Fresh tables of the write path, and its micro-batch body."""
    root = shared_dir(spark, "ingest")
    registry, tables = f"{root}/registry", pipeline.Tables(f"{root}/tables")
    pipeline.write_registry(vendor_registry(spark), registry)
    paths = [f"{root}/vehicle", f"{root}/fleet"]
    for df, path in zip(directory(spark, sf), paths, strict=True):
        df.write.parquet(path)
    return tables, pipeline.ingest_batch(tables, registry, *paths)


@query(
    "alerts_from_lines",
    duck(
        "wire_defects", "vehicle", "fleet", "alert_type",
        then=ROUTED + """, telemetry_fast AS (SELECT vin, ts_ms, seq, engine_on, speed_kmh, evt, fuel_pct, coalesce(codes[1], '') AS dtc_code
            FROM routed WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY vin, seq, ts_ms ORDER BY arrival) = 1), """
        + ALERT_SQL.lstrip("+ ")
        + """ SELECT v.vehicle_id, t.alert_type_id, a.severity, a.ts_ms AS raised_ms, 'open' AS status
            FROM alerts a JOIN vehicle v ON v.vin = a.vin JOIN alert_type t ON t.code = a.code""",
    ),
)
def alerts_from_lines(spark, sf):
    """From vendor lines to alert rows: the write path, and behind it the rules on the batches that it has finished."""
    rules.use_rocksdb(spark)
    # in order of event time: what came late would be judged by what had been seen till then
    rows = view(spark, sf, "wire_defects").join(view(spark, sf, "telemetry").select("event_id", "ts_ms"), "event_id").select(*RAW, "ts_ms")
    tables, body = _write_path(spark, sf)
    _, behind = streams.scratch(spark, "alerts")
    paths = [f"{tables.root}/{name}" for name in ("vehicle", "alert_type")]
    for name, path in zip(("vehicle", "alert_type"), paths, strict=True):
        view(spark, sf, name).write.parquet(path)
    raise_alerts = pipeline.write_alerts(tables, *paths)

    def start(stream: DataFrame, checkpoint: str, _: str) -> None:
        streams.run_available(stream.drop("ts_ms"), checkpoint, each_batch=body)
        streams.run_available(pipeline.alert_stream(spark, tables, idle_minutes=IDLE_MINUTES), behind, each_batch=raise_alerts)

    replayed(spark, rows, "ts_ms", "lines", start)
    alerts = read_batches(spark, tables.path("alerts"))
    return alerts.select("vehicle_id", "alert_type_id", "severity", ms("raised_at", "raised_ms"), "status")
