"""Streams that follow the finished batches of another: crashes, restarts, limits, and bounded state."""

import datetime as dt

import __spark_entry__ as entry
import harness
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from convoy.operators import rollup
from convoy.plans import streams as plans
from convoy.plans.fixtures import view
from convoy.sources import batches, streams
from convoy.sources.finished import read_finished
from convoy.streaming import pipeline, rules, state

SF = "/root/testdata/sf0.001"


def test_finished_batches_are_read_once(spark):
    data, checkpoint = streams.scratch(spark, "finished-test")
    rows = lambda a, b: spark.range(a, b).select("id", F.timestamp_seconds("id").alias("ts"), F.array(F.lit("x")).alias("xs"))
    sizes = []

    def body(df, i):
        sizes.append(df.count())
        batches.write_batch(df, i, f"{data}/out")

    def catch_up():
        streams.run_available(read_finished(spark, f"{data}/in", rows(0, 1).schema), checkpoint, each_batch=body)

    for i in range(2):
        batches.write_batch(rows(10 * i, 10 * i + 10), i, f"{data}/in")
    catch_up()
    batches.write_batch(rows(10, 20), 1, f"{data}/in")  # replayed after its commit
    rows(90, 99).write.parquet(f"{data}/in/data/run=batch/batch_id=2")  # never committed
    catch_up()
    batches.write_batch(rows(20, 25), 2, f"{data}/in")
    catch_up()
    out = batches.read_batches(spark, f"{data}/out").collect()
    assert sorted((r.id, r.xs[0]) for r in out) == [(i, "x") for i in range(25)] and sizes == [20, 5]
    assert all(r.ts == dt.datetime(1970, 1, 1) + dt.timedelta(seconds=r.id) for r in out)


def test_a_batch_limit_holds(spark):
    data, checkpoint = streams.scratch(spark, "limit-test")
    for i in range(5):
        batches.write_batch(spark.range(i, i + 1), i, f"{data}/in")
    seen = []

    def follow():
        stream = read_finished(spark, f"{data}/in", "id long", batches_per_trigger=2, progress=f"{data}/progress")
        running = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: seen.append(df.count())).start()
        try:
            running.processAllAvailable()
        finally:
            running.stop()

    follow()
    for i in range(5, 8):
        batches.write_batch(spark.range(i, i + 1), i, f"{data}/in")
    follow()  # after a restart too
    assert [n for n in seen if n] == [2, 2, 1, 2, 1]
    with pytest.raises(ValueError):
        read_finished(spark, f"{data}/in", "id long", batches_per_trigger=2)


def test_a_killed_batch_is_alerted_once(spark, monkeypatch):
    """The write path dies after it has stored events; the rules have read them before it comes back."""
    rules.use_rocksdb(spark)
    rows = view(spark, SF, "wire_defects").join(view(spark, SF, "telemetry").select("event_id", "ts_ms"), "event_id").select(*plans.RAW, "ts_ms")
    tables, body = plans._write_path(spark, SF)
    data, checkpoint = streams.scratch(spark, "killed-test")
    paths = [f"{data}/{name}" for name in ("vehicle", "alert_type")]
    for name, path in zip(("vehicle", "alert_type"), paths, strict=True):
        view(spark, SF, name).write.parquet(path)

    def ingest():
        stream = streams.read_raw_stream(spark, f"{data}/in", rows.schema, max_files_per_trigger=100)
        streams.run_available(stream.drop("ts_ms"), checkpoint, each_batch=body)

    def raise_alerts():
        stream = pipeline.alert_stream(spark, tables, idle_minutes=plans.IDLE_MINUTES)
        streams.run_available(stream, f"{data}/behind", each_batch=pipeline.write_alerts(tables, *paths))

    first, second = streams.stretches(rows, "ts_ms", 2)
    first.write.parquet(f"{data}/in")
    ingest()
    raise_alerts()
    second.write.mode("append").parquet(f"{data}/in")

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(pipeline, "write_telemetry_batch", die)
        with pytest.raises(StreamingQueryException):
            ingest()
    raise_alerts()
    ingest()
    raise_alerts()
    alerts = batches.read_batches(spark, tables.path("alerts"))
    got = alerts.select("vehicle_id", "alert_type_id", "severity", F.unix_millis("raised_at").alias("raised_ms"), "status")
    assert harness.spark_rows(got) == harness.duck_rows(harness.duck(SF), entry.oracle_sql()["alerts_from_lines"])
    assert alerts.select("alert_id").distinct().count() == alerts.count()
    assert batches.read_batches(spark, tables.path("telemetry")).count() == batches.read_batches(spark, tables.path("events")).count()


def test_window_state_stays_bounded_and_loses_nothing(spark):
    """Twenty batches over ten days, a tenth of the rows up to four days late."""
    schema = "fleet_id int, vin string, ts timestamp, engine_on boolean, speed_kmh double, evt string, dtc array<string>, fuel_pct double, odo_km double"
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(2400):
        at = start + dt.timedelta(minutes=6 * i) - (dt.timedelta(hours=i % 97) if i % 10 == 3 else dt.timedelta())
        rows.append((i % 3, f"V{i % 4}", at, i % 7 == 0, float(i % 130), "HARSH_BRAKE" if i % 11 == 0 else None, [], float(i % 20), float(i)))
    data, checkpoint = streams.scratch(spark, "window-test")
    totals = []
    for k in range(20):
        spark.createDataFrame(rows[120 * k : 120 * k + 120], schema).coalesce(1).write.mode("append").parquet(f"{data}/in")
        source = streams.read_raw_stream(spark, f"{data}/in", schema)
        streams.run_available(source, checkpoint, each_batch=state.route_late(f"{data}/routed", dt.timedelta(hours=3)))
        on_time = read_finished(spark, f"{data}/routed/on_time", schema)
        done = streams.run_available(
            state.hourly_rollup_stream(on_time, "3 hours"), f"{data}/behind", mode="update", each_batch=state.updated_rows(f"{data}/windows")
        )
        totals.append(done.lastProgress.stateOperators[0].numRowsTotal)
        assert all(op.numRowsDroppedByWatermark == 0 for p in done.recentProgress for op in p.stateOperators)
    got = state.read_window_rollup(spark, f"{data}/windows", f"{data}/routed/late")
    whole = rollup.hourly_rollup(spark.createDataFrame(rows, schema))
    assert got.select(whole.columns).exceptAll(whole).count() == 0 and got.count() == whole.count()
    assert max(totals[10:]) <= 2 * max(totals[2:5]) and max(totals) < whole.count() / 3
