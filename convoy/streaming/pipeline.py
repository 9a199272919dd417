"""The write path as one streaming job: decode, normalise, route, dedup, store."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from convoy.operators.alerts import build_alerts
from convoy.operators.routing import route
from convoy.operators.rollup import hourly_rollup
from convoy.operators.state import latest_state
from convoy.sources.ndjson import classify_lines
from convoy.sources.batches import write_batch
from convoy.sources.finished import read_finished
from convoy.sources.sinks import write_telemetry_batch
from convoy.streaming.rules import evaluate_rules_stream
from convoy.streaming.state import HORIZON, LATENESS, forget, remember, unseen


@dataclass(frozen=True)
class Tables:
    """Folders of the tables that the job writes, one partition per micro-batch."""

    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"


def ingest_batch(
    tables: Tables, registry_path: str, vehicle_path: str, fleet_path: str,
    horizon: dt.timedelta = HORIZON, lateness: dt.timedelta = LATENESS,
):
    """Micro-batch body of the write path.

    Registry, vehicles and fleets are read anew for every micro-batch, so an activated mapping or
    a new vehicle takes effect without a restart. A batch is routed once; accepted events lose the copies inside the
    batch and those of events stored within ``horizon`` of their arrival; then telemetry (by day,
    clustered), latest state and rollup partials are written. Every table has its own commit: a replayed batch
    goes on where it broke off. ``alert_stream`` reads the stored events.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        registry, vehicle, fleet = (spark.read.parquet(p) for p in (registry_path, vehicle_path, fleet_path))
        routed = route(classify_lines(batch), registry, vehicle, fleet).drop("payload")
        done = write_batch(routed, batch_id, tables.path("routed"))
        write_batch(done.filter(F.col("reason").isNotNull()), batch_id, tables.path("dead"))
        accepted = done.filter(F.col("reason").isNull()).drop("reason")
        forget(spark, tables.path("seen"), batch_id, horizon, lateness)
        events = unseen(accepted, tables.path("seen"), batch_id, horizon=horizon, lateness=lateness)
        stored = write_batch(events, batch_id, tables.path("events"))
        remember(stored, tables.path("seen"), batch_id, horizon=horizon, lateness=lateness)
        write_telemetry_batch(stored, batch_id, tables.path("telemetry"))
        write_batch(latest_state(stored), batch_id, tables.path("latest"))
        write_batch(hourly_rollup(stored), batch_id, tables.path("rollup"))

    return write


#: What the rules read of an event.
RULE_INPUT = "vin string, ts timestamp, seq bigint, engine_on boolean, speed_kmh double, evt string, dtc array<string>, fuel_pct double"


def alert_stream(
    spark: SparkSession, tables: Tables, batches_per_trigger: int = 0, progress: str | None = None, **limits
) -> DataFrame:
    """Rule hits on the events that the write path keeps, as a stream of its own behind the first one.

    It follows the finished batches of the events, so one that the first stream writes again after a crash is read once.
    """
    events = read_finished(spark, tables.path("events"), RULE_INPUT, batches_per_trigger, progress)
    return evaluate_rules_stream(events, **limits)


def write_alerts(tables: Tables, vehicle_path: str, alert_type_path: str):
    """Micro-batch sink of ``alert_stream``: alert rows with ids that a replay repeats."""

    def write(hits: DataFrame, batch_id: int) -> None:
        read = hits.sparkSession.read.parquet
        write_batch(build_alerts(hits, read(vehicle_path), read(alert_type_path)), batch_id, tables.path("alerts"))

    return write


def normalise_stream(batch_sink_path: str, registry_path: str):
    """Micro-batch body that only normalises, under the mappings active at that moment."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from convoy.operators.normalise import normalise

        registry = batch.sparkSession.read.parquet(registry_path)
        out = normalise(classify_lines(batch), registry).drop("payload")
        write_batch(out, batch_id, batch_sink_path)

    return write


def write_registry(mappings: DataFrame, path: str) -> None:
    """Replace the registry table. It is tiny: one file."""
    mappings.coalesce(1).write.mode("overwrite").parquet(path)

