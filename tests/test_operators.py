"""Operators on small tables: skew, replays, edges."""

import datetime as dt
import math
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from convoy.operators import dedup, geospatial, insights, numbering, observe, risk, rollup, state
from convoy.sources import batches, sinks, streams
from convoy.streaming import state as live

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_seen_keys_are_exact_whatever_repeats(spark):
    history = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), (None, 2)], "k string, n int")
    probe = spark.createDataFrame([("a", 1, "x")] * 300 + [("a", 2, "x"), ("b", None, "x"), (None, 2, "x"), ("c", 3, "x")], "k string, n int, seen_by string")
    out = dedup.seen_key_split(history, probe, ("k", "n"))
    assert out.columns == ["k", "n", "seen_by", "seen"]
    assert [r["count"] for r in out.groupBy("seen").count().orderBy("seen").collect()] == [4, 300]
    report = dedup.seen_report(history, probe, ("k", "n")).first()
    assert (report.n, report.n_seen) == (304, 300) and report.share == pytest.approx(300 / 304)
    assert dedup.seen_key_split(history.limit(0), probe, ("k", "n")).filter("seen").count() == 0
    assert dedup.false_positive_rate(20_000, 1 << 20, 4) < 0.01


def test_dedup_of_a_crowded_copy_group(spark):
    rows = [("V", 1, START, i, f"c{i}") for i in range(500)] + [("V", i, START, 1000 + i, "x") for i in range(2, 30)]
    df = spark.createDataFrame(rows, "vin string, seq long, ts timestamp, arrival long, body string")
    out = dedup.dedup_exact(df).collect()
    assert len(out) == 29 and [r["body"] for r in out if r["seq"] == 1] == ["c0"]


def test_numbering_matches_row_number(spark):
    rnd = random.Random(3)
    ids = rnd.sample(range(1_000_000), 3000)
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in ids], "id long, k string")
    got = {(r["k"], r["id"]): r["rn"] for r in numbering.numbered(df, ["k"], "id", bucket=1000).collect()}
    for key in "ab":
        own = sorted(i for i in ids if (i % 3 != 0) == (key == "a"))
        assert [got[key, i] for i in own] == list(range(1, len(own) + 1))


def test_running_totals_and_quantiles(spark):
    rnd = random.Random(4)
    values = [round(rnd.choice((0.5, rnd.random(), rnd.random() * 100)), 4) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    counts = df.groupBy("x").agg(F.count("*").alias("n"))
    got = {r["x"]: r["n_before"] for r in numbering.running_by_value(counts, "x", ["n"]).collect()}
    ordered = sorted(values)
    assert all(got[v] == ordered.index(v) for v in rnd.sample(values, 60))
    for share, row in zip((0.0, 0.37, 0.5, 1.0), numbering.exact_quantiles(df, "x", [0.0, 0.37, 0.5, 1.0]).orderBy("i").collect()):
        position = share * (len(ordered) - 1)
        low, high = ordered[int(position)], ordered[min(int(position) + 1, len(ordered) - 1)]
        assert row["value"] == pytest.approx(low + (high - low) * (position - int(position)))


def test_auc_with_ties(spark):
    rnd = random.Random(6)
    rows = [(round(rnd.random(), 1), rnd.randrange(2)) for _ in range(400)]
    got = risk.binary_metrics(spark.createDataFrame(rows, "risk double, label int"), 0.5).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert got["roc_auc"] == pytest.approx(wins / len(pos) / len(neg))
    assert got["recall"] == pytest.approx(sum(s >= 0.5 for s in pos) / len(pos))


def test_metrics_of_empty_classes(spark):
    got = risk.binary_metrics(spark.createDataFrame([(0.1, 0), (0.2, 0)], "risk double, label int"), 0.5).first()
    assert (got["precision"], got["recall"], got["f1"], got["roc_auc"]) == (0.0, 0.0, 0.0, None)


def test_rule_risk_clamps(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0, 0.0)], "idle_ratio double, harsh_ratio double, dtc_ratio double, overspeed_ratio double, lowfuel_ratio double")
    assert risk.rule_risk(df).first()["risk"] == 1.0


def test_idle_cost_of_an_hour(spark):
    row = insights.with_idle_cost(spark.createDataFrame([(3600,)], "idle long")).first()
    assert (row["idle_hours"], row["litres"], row["cost"]) == (1.0, 0.8, 76.0)


def test_mask_location(spark):
    df = spark.createDataFrame([(13.082712345, 80.270798765), (None, 1.0)], "lat double, lon double")
    assert [tuple(r) for r in state.mask_location(df, "viewer").collect()] == [(13.083, 80.271), (None, 1.0)]
    assert state.mask_location(df, "admin").first()["lat"] == 13.082712345


def test_page_cursor_only_when_full(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    full = state.keyset_page(df, "k", after=2, limit=3).collect()
    assert [(r["k"], r["next_cursor"]) for r in full] == [(3, 5), (4, 5), (5, 5)]
    assert {r["next_cursor"] for r in state.keyset_page(df, "k", after=7, limit=3).collect()} == {None}
    assert [r["k"] for r in state.keyset_page(df, "k", after=4, limit=2, desc=True).collect()] == [3, 2]


def test_latest_keeps_first_arrival_of_equal_times(spark):
    rows = [("V", at(5), 2, "b"), ("V", at(5), 1, "a"), ("V", at(1), 3, "c")]
    df = spark.createDataFrame(rows, "vin string, ts timestamp, arrival long, body string")
    assert state.latest_state(df).first()["body"] == "a"


def test_lateness_over_slices(spark):
    rnd = random.Random(8)
    rows = [("V" if i % 3 else "W", at(rnd.randrange(5000)), at(i * 13), i) for i in range(600)]
    df = spark.createDataFrame(rows, "vin string, ts timestamp, received_at timestamp, arrival long")
    got = {r["arrival"]: r["lateness_ms"] for r in observe.late_events(df, slice_s=100).collect()}
    newest = {}
    for vin, ts, _, i in rows:
        top = newest.get(vin)
        assert got[i] == (max(0, int((top - ts).total_seconds() * 1000)) if top else 0)
        newest[vin] = max(ts, top) if top else ts


def test_path_distance_crosses_hours(spark):
    rnd = random.Random(9)
    rows = [("V", at(i * 1700 + rnd.randrange(900)), i, 12 + rnd.random(), 77 + rnd.random(), float(i)) for i in range(150)]
    df = spark.createDataFrame(rows, "vin string, ts timestamp, seq long, lat double, lon double, odo_km double")
    got = geospatial.path_distance(df).agg(F.sum("legs"), F.sum("odometer_km")).first()
    assert tuple(got) == (149, 149.0)



def test_running_totals_do_not_depend_on_the_slices(spark):
    """One slice, a few, more than a row of cut points holds, and more than there are values."""
    rnd = random.Random(8)
    rows = sorted({round(rnd.expovariate(1), 6): rnd.randrange(9) for _ in range(2000)}.items())
    values = spark.createDataFrame(rows, "x double, n long")
    want = {x: sum(n for _, n in rows[:i]) for i, (x, _) in enumerate(rows)}
    for slices in (None, 2, 33, 34, 500, 5000):
        assert {r.x: r.n_before for r in numbering.running_by_value(values, "x", ["n"], slices).collect()} == want
    sliced = numbering.staged(values)
    part = sliced.withColumn("_edges", numbering._edges(sliced, "x", 500)).groupBy(numbering._slice_of(sliced, "x", 500).alias("s")).count().collect()
    assert len(part) > 450 and max(r["count"] for r in part) < 40
    assert numbering.running_by_value(values.limit(0), "x", ["n"], 40).count() == 0


def test_the_rule_grid_reads_its_input_once(spark):
    rows = [(i % 17 / 17, i % 23 / 23, int(i % 17 > 12)) for i in range(400)]
    df = spark.createDataFrame(rows, "dtc_ratio double, harsh_ratio double, label int")
    best = risk.rule_baseline(df)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") < 10 and "ExistingRDD" not in plan
    got = best.first()
    assert (got.tp, got.fp, got.fn) == (sum(y for *_, y in rows), 0, 0) and got.f1 == 1.0
    assert risk.rule_baseline(df.limit(0)).first().f1 is None

def test_radius_over_the_date_line(spark):
    points = spark.createDataFrame([(1, 0.0, 179.95), (2, 0.0, -179.95), (3, 0.0, 179.0), (4, 60.0, 10.3)], "id int, lat double, lon double")
    sites = spark.createDataFrame([("s", 0.0, 180.0), ("n", 60.0, 10.0)], "site_id string, lat double, lon double")
    got = {(r["site_id"], r["id"]) for r in geospatial.within_radius(points, sites, 20).collect()}
    assert got == {("s", 1), ("s", 2), ("n", 4)}


def test_radius_against_all_pairs(spark):
    """At the poles, over the date line and everywhere else; also where one circle spans all latitudes."""
    rnd = random.Random(5)
    spots = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(150)]
    spots += [(rnd.choice((-1, 1)) * rnd.uniform(88, 90), rnd.uniform(-180, 180)) for _ in range(60)]
    spots += [(rnd.uniform(60, 70), rnd.choice((-1, 1)) * rnd.uniform(179, 180)) for _ in range(60)]
    points = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "id int, lat double, lon double")
    sites = points.select(F.col("id").alias("site_id"), "lat", "lon")

    def km(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    for radius in (50, 200, 3000, 21_000):
        got = {(r.site_id, r.id) for r in geospatial.within_radius(points, sites, radius).collect()}
        assert got == {(i, j) for i, a in enumerate(spots) for j, b in enumerate(spots) if km(a, b) <= radius}


def test_a_replayed_batch_adds_nothing(spark):
    path, _ = streams.scratch(spark, "replay-test")
    for _ in range(2):
        assert batches.write_batch(spark.range(10), 3, path).count() == 10
    # a crash before the commit: rows without one are not read, and the replay writes them anew
    spark.range(99).write.parquet(f"{path}/data/run=batch/batch_id=4")
    assert batches.read_batches(spark, path).count() == 10
    batches.write_batch(spark.range(5), 4, path)
    assert batches.read_batches(spark, path).count() == 15


def test_a_new_run_on_old_tables_loses_nothing(spark):
    """Another checkpoint starts at batch 0 again."""
    data, first = streams.scratch(spark, "runs-test")
    _, second = streams.scratch(spark, "runs-test")
    spark.range(10).coalesce(1).write.parquet(f"{data}/a")
    spark.range(10, 17).coalesce(1).write.parquet(f"{data}/b")
    for folder, checkpoint in (("a", first), ("b", second), ("a", first)):
        stream = streams.read_raw_stream(spark, f"{data}/{folder}", "id long")
        streams.run_available(stream, checkpoint, each_batch=lambda df, i: batches.write_batch(df, i, f"{data}/out"))
    rows = batches.read_batches(spark, f"{data}/out")
    assert sorted(r.id for r in rows.collect()) == list(range(17))
    assert {r.batch_id for r in rows.collect()} == {0} and rows.select("run").distinct().count() == 2


def test_expired_days_leave_the_disk(spark):
    path, _ = streams.scratch(spark, "expire-test")
    rows = spark.range(40).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 21600).alias("ts"), "id")
    for i in range(2):
        batches.write_batch(rows.filter(F.col("id") % 2 == i).withColumn("day", F.to_date("ts")), i, path, "day")
    gone = sinks.expire(spark, path, 2, dt.datetime(2024, 1, 8))
    assert [(r.day, r.rows) for r in gone.orderBy("day").collect()] == [(f"2024-01-0{d}", 4) for d in range(1, 6)]
    assert gone.where("bytes > 0").count() == 5
    assert sorted(r.id for r in batches.read_batches(spark, path).collect()) == list(range(20, 40))
    assert not list(pathlib.Path(path).glob("data/*/*/day=2024-01-05")) and list(pathlib.Path(path).glob("data/*/*/day=2024-01-06"))
    assert sinks.expire(spark, path, 2, dt.datetime(2024, 1, 8)).count() == 0


def test_kept_checkpoint_adds_no_rows(spark):
    data, checkpoint = streams.scratch(spark, "keep-test")
    spark.range(10).write.parquet(f"{data}/in")
    for _ in range(2):
        streams.run_available(streams.read_raw_stream(spark, f"{data}/in", "id long"), checkpoint, f"{data}/out")
    assert spark.read.parquet(f"{data}/out").count() == 10


def run_dedup(spark, parts):
    """Batches of (seq, seconds of arrival) through the streaming dedup; what it keeps."""
    data, checkpoint = streams.scratch(spark, "dedup-test")
    schema = "vin string, seq long, ts timestamp, received_at timestamp, arrival long"
    for batch in parts:
        rows = [("V", s, at(s), at(r), r) for s, r in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{data}/in")
        stream = streams.read_raw_stream(spark, f"{data}/in", schema, max_files_per_trigger=100)
        streams.run_available(stream, checkpoint, each_batch=live.dedup_batches(f"{data}/out"))
    return sorted((r["seq"], r["arrival"]) for r in batches.read_batches(spark, f"{data}/out/rows").collect())


def test_stream_dedup_holds_across_batches(spark):
    kept = run_dedup(spark, [[(s, 100 + i) for s in range(i, i + 4)] for i in range(3)])
    assert [s for s, _ in kept] == list(range(6))


def test_stream_dedup_keeps_unseen_keys_however_late(spark):
    hour = 3600
    kept = run_dedup(
        spark,
        [
            [(1, 12 * hour), (2, 17 * hour)],
            [(3, 18 * hour)],
            [(4, 13 * hour), (3, 18 * hour + 60), (1, 12 * hour - 30)],  # a new key five hours back, and two repeats
            [(1, 14 * hour)],  # beyond the horizon of its first arrival
        ],
    )
    assert kept == [(1, 12 * hour), (1, 14 * hour), (2, 17 * hour), (3, 18 * hour), (4, 13 * hour)]


def chain(arrivals, horizon):
    """(seq, arrival) that a memory of each key's stored arrival lets through, one by one."""
    stored, out = {}, []
    for seq, r in sorted(arrivals, key=lambda x: x[1]):
        if seq not in stored or r - stored[seq] >= horizon:
            stored[seq] = r
            out.append((seq, r))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 6, 20])
def test_the_horizon_does_not_depend_on_the_cut(spark, parts):
    """One crowded key and many others over half a day, cut into so many batches; old arrivals are gone from disk."""
    rnd = random.Random(11)
    rows = sorted({(7 if rnd.random() < 0.4 else rnd.randrange(20, 120), rnd.randrange(50_000)) for _ in range(700)}, key=lambda x: x[1])
    path, _ = streams.scratch(spark, "cut-test")
    schema = "vin string, seq long, ts timestamp, received_at timestamp, arrival long"
    body = live.dedup_batches(path, lateness=dt.timedelta(hours=2))
    for i in range(parts):
        cut = rows[len(rows) * i // parts : len(rows) * (i + 1) // parts]
        batch = spark.createDataFrame([("V", s, at(s), at(r), r) for s, r in cut], schema)
        body(batch, i)
        if i % 5 == 4:
            body(batch, i)  # a replay
    got = sorted((r.seq, r.arrival) for r in batches.read_batches(spark, f"{path}/rows").collect())
    assert got == chain(rows, 3600)
    if parts == 20:
        slots = sorted(int(p.name.split("=")[1]) for p in pathlib.Path(path).glob("seen/data/*/*/slot=*"))
        assert slots[-1] - slots[0] <= 6 and len(slots) > 3


@pytest.mark.parametrize("few", [30, 10_000])
def test_the_horizon_of_crowded_and_of_few_copies(spark, few):
    """Three batches with one crowded key, one that is null, and a column without an order: in slices and in one group per key."""
    rnd = random.Random(12)
    rows = sorted({(rnd.choice((7, 7, 7, None, *range(20, 90))), rnd.randrange(40_000)) for _ in range(600)}, key=lambda x: x[1])
    path, _ = streams.scratch(spark, "few-test")
    schema = "vin string, seq long, ts timestamp, received_at timestamp, arrival long, body map<string, long>"
    for i in range(3):
        cut = rows[200 * i : 200 * (i + 1)] if i < 2 else rows[400:]
        batch = spark.createDataFrame([("V", s, START, at(r), r, {"r": r}) for s, r in rnd.sample(cut, len(cut))], schema)
        kept = live.unseen(batch, f"{path}/seen", i, few=few)
        assert kept.columns == batch.columns
        live.remember(batches.write_batch(kept, i, f"{path}/rows"), f"{path}/seen", i)
    got = batches.read_batches(spark, f"{path}/rows").collect()
    assert all(r.body == {"r": r.arrival} for r in got)
    as_key = lambda s: -1 if s is None else s
    assert sorted((as_key(r.seq), r.arrival) for r in got) == chain([(as_key(s), r) for s, r in rows], 3600)


def test_a_long_batch_is_read_and_shuffled_once(spark):
    """However many rows it has, a batch without crowded keys is scanned once beside the counting of its copies."""
    path, _ = streams.scratch(spark, "once-test")
    rows = spark.range(400).select(
        F.lit("V").alias("vin"), (F.col("id") % 90).alias("seq"), F.lit(START).alias("ts"), F.timestamp_seconds(F.col("id") * 100 + 1704067200).alias("received_at"), F.col("id").alias("arrival")
    )
    rows.write.parquet(f"{path}/in")
    batch = spark.read.parquet(f"{path}/in")
    live.remember(batch.where("arrival < 20"), f"{path}/seen", 0)
    plan = live.unseen(batch.where("arrival >= 20"), f"{path}/seen", 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange") == 1  # rows and stored arrivals


def test_compaction_while_the_stream_runs(spark):
    path, _ = streams.scratch(spark, "compact-test")
    df = spark.range(60).select(F.concat(F.lit("v"), F.col("id") % 7).alias("vin"), F.timestamp_seconds(F.col("id") * 37 % 50).alias("ts"), F.col("id").alias("arrival"))
    for i in range(6):
        live.latest_partials(path)(df.filter(F.col("arrival") % 8 == i), i)
    before = sorted(live.read_latest(spark, path).collect())
    batches.compact(spark, path, state.latest_state)
    assert sorted(live.read_latest(spark, path).collect()) == before
    live.latest_partials(path)(df.filter(F.col("arrival") % 8 == 5), 5)  # the newest batch is replayed
    for i in (6, 7):
        live.latest_partials(path)(df.filter(F.col("arrival") % 8 == i), i)
    assert sorted(live.read_latest(spark, path).collect()) == sorted(state.latest_state(df).collect())
    assert {(r.run, r.batch_id < 10) for r in batches.manifest(spark, path).collect()} == {("merged", False), ("batch", True)}
    assert batches.manifest(spark, path).count() == 4 and len(list(pathlib.Path(path).glob("data/*/*"))) == 4


def test_retention_reads_only_younger_days(spark):
    path, _ = streams.scratch(spark, "days-test")
    rows = spark.range(40).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 21600).alias("ts"), "id")
    rows.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    kept = sinks.retain(spark.read.parquet(path), "ts", 2, dt.datetime(2024, 1, 8))
    assert [r.id for r in kept.orderBy("id").collect()] == list(range(21, 40))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_merged_partials_equal_one_pass(spark):
    rows = [(1, "V", at(i * 50), i % 7 == 0, float(i % 130), None, [], float(i % 20), float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "fleet_id int, vin string, ts timestamp, engine_on boolean, speed_kmh double, evt string, dtc array<string>, fuel_pct double, odo_km double")
    parts = [rollup.hourly_rollup(df.filter(F.col("odo_km") % 3 == i)) for i in range(3)]
    whole = rollup.hourly_rollup(df)
    assert rollup.merge_rollups(*parts).select(whole.columns).exceptAll(whole).count() == 0


def test_hot_keys_are_ranked_with_a_map_side_limit(spark):
    """The per-group top-N plan must cut groups before the shuffle."""
    df = spark.range(1000).select((F.col("id") % 2).alias("fleet_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("string").alias("vin"))
    plan = state.live_list(df, df.select("fleet_id").distinct(), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_history_filter_reaches_the_scan(spark):
    path, _ = streams.scratch(spark, "push-test")
    spark.range(100).select(F.lit("V").alias("vin"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), F.lit(1).alias("unused")).write.parquet(path)
    page = state.vehicle_history(spark.read.parquet(path), "V", START).select("seq")
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(vin,V)" in plan and "GreaterThanOrEqual(ts" in plan and "unused" not in plan


def test_a_landed_table_of_many_rows_is_scanned_in_more_parts_than_slots(spark, tmp_path, monkeypatch):
    from convoy.plans import fixtures

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(fixtures, "ROWS", 10)
    slots = spark.sparkContext.defaultParallelism
    for name in ("telemetry", "wire_defects"):
        rows = fixtures.view(spark, str(tmp_path), name)
        assert rows.rdd.getNumPartitions() > 2 * slots
    assert fixtures.view(spark, str(tmp_path), "telemetry").count() == spark.read.parquet(str(tmp_path / "events.parquet")).count()
