"""Rules against a plain sequential reading of their definition, on crowded and random vehicles."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from convoy.operators import rule_pass, rules
from convoy.operators.cooldown import apply_cooldown
from convoy.operators.ewma import ewma_z
from convoy.sources import streams
from convoy.streaming import rules as live

SCHEMA = (
    "vin string, ts timestamp, seq long, engine_on boolean, speed_kmh double, evt string, dtc array<string>, fuel_pct double"
)
START = dt.datetime(2024, 1, 1)


def event(t, seq, vin="V", engine=True, speed=50.0, evt=None, dtc=(), fuel=50.0):
    return (vin, START + dt.timedelta(milliseconds=t), seq, engine, speed, evt, list(dtc), fuel)


def sequential(rows, idle_ms=600_000, cooldown=900_000):
    """The rules, one event after another."""
    out, vehicles = [], {}
    for vin, ts, seq, engine, speed, evt, dtc, fuel in sorted(rows, key=lambda r: (r[1], r[2])):
        t = int((ts - START).total_seconds() * 1000 + 0.5)
        s = vehicles.setdefault(vin, dict(idle=None, done=False, brakes=[], codes={}, n=0, mean=0.0, var=0.0, last={}))

        def emit(code, detail, s=s, t=t, vin=vin, seq=seq):
            if code not in s["last"] or t - s["last"][code] >= cooldown:
                s["last"][code] = t
                out.append((vin, code, t, seq, detail))

        if engine and speed < 1:
            if s["idle"] is None:
                s["idle"], s["done"] = t, False
            elif not s["done"] and t - s["idle"] >= idle_ms:
                s["done"] = True
                emit("IDLING_EXCESSIVE", int((t - s["idle"]) / 60000 + 0.5))
        else:
            s["idle"] = None
        if evt == "HARSH_BRAKE":
            s["brakes"] = [x for x in s["brakes"] if x > t - 600_000] + [t]
            if len(s["brakes"]) >= 3:
                emit("HARSH_BRAKE_BURST", len(s["brakes"]))
        for code in dtc:
            w = [x for x in s["codes"].get(code, []) if x > t - 3_600_000] + [t]
            s["codes"][code] = w
            if len(w) >= 3:
                emit("DTC_REPEAT", len(w))
        if s["n"] == 0:
            s["mean"], z = speed, 0.0
        else:
            sd = s["var"] ** 0.5
            z = (speed - s["mean"]) / sd if s["n"] >= 30 and sd > 1e-9 else 0.0
        d = speed - s["mean"]
        s["mean"] += 0.05 * d
        s["var"] = 0.95 * (s["var"] + 0.05 * d * d)
        s["n"] += 1
        if z > 4 and speed > 100:
            emit("OVERSPEED_ANOMALY", round(z, 1))
        if fuel is not None and fuel < 10:
            emit("LOW_FUEL", fuel)
    return out


KEYS = {
    "IDLING_EXCESSIVE": "idle_minutes", "HARSH_BRAKE_BURST": "count_10min", "DTC_REPEAT": "count_1h",
    "OVERSPEED_ANOMALY": "z", "LOW_FUEL": "fuel_pct",
}


def found(df):
    return sorted(
        (r["vin"], r["code"], int((r["ts"] - START).total_seconds() * 1000 + 0.5), r["seq"], json.loads(r["detail"])[KEYS[r["code"]]])
        for r in df.collect()
    )


def run(spark, rows, **params):
    return found(rules.evaluate_rules(spark.createDataFrame(rows, SCHEMA), **params))


def test_idling_alerts_once_per_episode(spark):
    rows = [event(i * 1000, i, speed=0.0) for i in range(200)]
    assert [(a[1], a[4]) for a in run(spark, rows, idle_minutes=1)] == [("IDLING_EXCESSIVE", 1)]


def test_brake_burst(spark):
    burst = [event(t * 1000, i, evt="HARSH_BRAKE") for i, t in enumerate((0, 10, 20))]
    assert [(a[1], a[2]) for a in run(spark, burst)] == [("HARSH_BRAKE_BURST", 20_000)]
    sparse = [event(t * 1000, i, evt="HARSH_BRAKE") for i, t in enumerate((0, 700, 1400, 2100))]
    assert run(spark, sparse) == []


def test_repeated_code_and_cooldown(spark):
    rows = [event(i * 10_000, i, dtc=["P0301"]) for i in range(6)]
    assert [a[1] for a in run(spark, rows)] == ["DTC_REPEAT"]
    twice = [event(0, 0, dtc=["P0301", "P0301"]), event(10, 1, dtc=["P0301"])]
    assert [a[4] for a in run(spark, twice)] == [3]


def test_cooldown_is_greedy(spark):
    hits = spark.createDataFrame(
        [("V", "X", START + dt.timedelta(seconds=t), i) for i, t in enumerate((0, 1, 2, 500, 501, 502))],
        "vin string, code string, ts timestamp, seq long",
    )
    assert apply_cooldown(hits, 1).count() == 2
    assert apply_cooldown(hits, 0).count() == 6


def test_low_fuel_ignores_unknown(spark):
    rows = [event(0, 0, fuel=5.0), event(1, 1, vin="W", fuel=None)]
    assert [(a[0], a[1]) for a in run(spark, rows)] == [("V", "LOW_FUEL")]


def test_window_is_open_on_the_left(spark):
    rows = spark.createDataFrame(
        [("V", START + dt.timedelta(milliseconds=t), i) for i, t in enumerate((0, 100, 200, 1500))],
        "vin string, ts timestamp, seq long",
    )
    got = {r["seq"]: r["count"] for r in rules.sliding_count(rows, ["vin"], 1000).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 1}


def test_zscore(spark):
    speeds = [50.0 + i % 3 for i in range(60)] + [140.0]
    rows = [event(i * 1000, i, speed=s) for i, s in enumerate(speeds)]
    z = {r["seq"]: r["z"] for r in ewma_z(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert z[60] > 4 and z[1] == 0


def crowd(seed, hot=2500, others=20, each=60):
    """One vehicle with a third of all rows, one with half, ties in time, and many small ones."""
    rnd = random.Random(seed)
    rows, seq = [], 0
    for vin, n, pace in [("HOT", hot, 4_000)] + [(f"V{i}", each, 60_000) for i in range(others)] + [
        ("EVEN", 2 * hot - others * each, 2_500)
    ]:
        t = rnd.randrange(600_000)
        idle = False
        for _ in range(n):
            t += rnd.choice((0, 0, 1, rnd.randrange(pace), rnd.randrange(2 * pace)))
            idle = idle if rnd.random() < 0.97 else not idle
            seq += 1
            rows.append(
                event(
                    t, seq, vin, engine=rnd.random() < 0.995,
                    speed=0.0 if idle else rnd.choice((60.0, 62.0, 65.0, rnd.uniform(50, 70), 180.0 if rnd.random() < 0.05 else 61.0)),
                    evt="HARSH_BRAKE" if rnd.random() < 0.05 else None,
                    dtc=rnd.choice(((), (), (), ("P0301",), ("P0420", "P0301"))) if rnd.random() < 0.2 else (),
                    fuel=rnd.choice((None, 5.0, 50.0, 60.0)),
                )
            )
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_vehicle_matches_sequential_reading(spark, seed):
    rows = crowd(seed)
    expected = sorted(sequential(rows, idle_ms=120_000))
    assert run(spark, rows, idle_minutes=2) == expected
    # the cuts must not show
    assert run(spark, rows, idle_minutes=2, slice_ms=17_000) == expected


def test_cooldown_over_dense_hits(spark):
    rnd = random.Random(5)
    times = sorted(rnd.randrange(40_000) for _ in range(3000))
    hits = spark.createDataFrame(
        [("V", "X", START + dt.timedelta(milliseconds=t), i) for i, t in enumerate(times)],
        "vin string, code string, ts timestamp, seq long",
    )
    expected, last = [], None
    for t in times:
        if last is None or t - last >= 700:
            expected.append(t)
            last = t
    got = sorted(int((r["ts"] - START).total_seconds() * 1000 + 0.5) for r in apply_cooldown(hits, 700 / 60000).collect())
    assert got == expected


def test_stream_equals_batch_over_many_files(spark):
    rows = sorted(crowd(7, hot=400, others=5, each=40), key=lambda r: (r[1], r[2]))
    expected = sorted(sequential(rows, idle_ms=120_000))
    live.use_rocksdb(spark)
    data, checkpoint = streams.scratch(spark, "rule-test")
    third = len(rows) // 3 + 1
    for i in range(3):
        part = rows[i * third : (i + 1) * third]
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{data}/in")
        stream = streams.read_raw_stream(spark, f"{data}/in", SCHEMA, max_files_per_trigger=100)
        alerts = live.evaluate_rules_stream(stream, idle_minutes=2)
        streams.run_available(alerts, checkpoint, f"{data}/out")
    assert found(spark.read.parquet(f"{data}/out")) == expected


@pytest.mark.parametrize("operator", [rules.idle_runs, ewma_z])
def test_summary_and_replay_share_one_shuffle(spark, operator):
    rows = spark.createDataFrame([event(i * 1000, i, speed=float(i % 3)) for i in range(50)], SCHEMA)
    df = operator(rows)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def mixed(n, seed, vins="VVVW"):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice((0, 900, 5_000, 40_000, 700_000 if rnd.random() < 0.02 else 0))
        still = rnd.random() < 0.5 if i % 90 else False
        speed = 0.0 if 20 < i % 90 < 60 else (0.5 if still else rnd.choice((60.0, 61.0, 150.0 if rnd.random() < 0.05 else 62.0)))
        codes = rnd.choice(([], [], [], ["P0301"], ["P0420", "P0420", "B1234"]))
        rows.append(event(t, i, rnd.choice(vins), rnd.random() < 0.97, speed, rnd.choice((None, None, "HARSH_BRAKE")), codes, rnd.choice((None, 5.0, 50.0))))
    return rows


@pytest.mark.parametrize("batch_rows", ["10000", "7"])
def test_one_pass_equals_the_sequence_however_rows_are_batched(spark, batch_rows):
    """A vehicle with most rows over several slices; slices that end inside idlings and inside Arrow batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        rows = mixed(1500, 21)
        assert run(spark, rows, idle_minutes=2) == sorted(sequential(rows, idle_ms=120_000))
        short = {"code_minutes": 2, "brake_minutes": 1, "slice_ms": 60_000, "idle_minutes": 2}
        df = spark.createDataFrame(rows, SCHEMA)
        one = found(rules.evaluate_rules(df, **short))
        short.pop("slice_ms")
        assert one == found(apply_cooldown(rules.rule_candidates(df, **short))) and {a[1] for a in one} == set(KEYS)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_events_are_shuffled_once(spark, tmp_path):
    """The scan of the events stands below one exchange; everything else reads that one again."""
    spark.createDataFrame(mixed(200, 3), SCHEMA).write.parquet(str(tmp_path / "events"))
    params = dict(idle_ms=60_000, moving_kmh=1, brake_n=3, brake_ms=600_000, code_n=3, code_ms=3_600_000, z=4, min_kmh=100, alpha=0.05, warmup=30, low_pct=10)
    hits = rule_pass.rule_hits(spark.read.parquet(str(tmp_path / "events")), params, 3_600_000)
    hits.write.format("noop").mode("overwrite").save()
    plan = hits._jdf.queryExecution()
    hits.collect()
    text = plan.executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1


def test_a_call_reads_and_writes_a_vehicles_state_once(spark):
    """What a call costs whatever its rows is what a stream of many vehicles takes; chunks of rows must not show."""

    class Value:
        def __init__(self):
            self.held, self.calls = None, []

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

    class Handle:
        def __init__(self):
            self.values = []

        def getValueState(self, *_):
            self.values.append(Value())
            return self.values[-1]

    rows = mixed(700, 4, vins="V")
    df = spark.createDataFrame(rows, SCHEMA)
    columns = ("vin", F.unix_millis("ts").alias("ts_ms"), "seq", "engine_on", "speed_kmh", "evt", "dtc", "fuel_pct")
    calls = df.select(*columns).sort("ts_ms", "seq").collect()
    params = dict(idle_ms=120_000, cooldown_ms=900_000, moving_kmh=1.0, brake_n=3, brake_ms=600_000, code_n=3, code_ms=3_600_000, z=4, min_kmh=100, alpha=0.05, warmup=30, low_pct=10)
    expected = sorted(sequential(rows, idle_ms=120_000))
    for chunk in (live.CHUNK, 50):
        live.CHUNK, before = chunk, live.CHUNK
        try:
            processor, handle = live.RuleProcessor(params, None), Handle()
            processor.init(handle)
            out = [a for k in range(0, len(calls), 300) for a in processor.handleInputRows(("V",), iter(calls[k : k + 300]), None)]
        finally:
            live.CHUNK = before
        assert sum((v.calls for v in handle.values), []) == ["get", "update"] * 3
        got = spark.createDataFrame(out, live.ALERTS).withColumn("ts", F.timestamp_millis("ts_ms"))
        assert found(got) == expected
