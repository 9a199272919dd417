"""The risk model as a table, scored here and in SQL, and days that move between tiers."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from convoy.operators import risk, risk_tables
from convoy.plans import figures
from convoy.schemas import RISK_FEATURES
from convoy.session import shared_dir, staged
from convoy.sources import batches, sinks

SF = "/root/testdata/sf0.001"
AS_OF = dt.datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def fitted(spark):
    rows = staged(figures.labelled(spark, SF))
    model = risk.train_risk_model(rows, trees=12)
    return rows.drop("risk"), model, staged(risk_tables.export_trees(spark, model))


def test_sql_over_the_exported_trees_gives_the_model_probabilities(fitted):
    rows, model, trees = fitted
    features, nodes = rows.toArrow(), trees.toArrow()  # noqa: F841 (read by the SQL)
    pick = "CASE n.feature " + " ".join(f"WHEN '{c}' THEN f.{c}" for c in RISK_FEATURES) + " END"
    sql = f"""WITH RECURSIVE walk AS (
        SELECT f.vin, n.tree, n.node FROM features f CROSS JOIN nodes n WHERE n.node = 0
        UNION ALL
        SELECT w.vin, w.tree, CASE WHEN {pick} <= n.cut THEN n."left" ELSE n."right" END
        FROM walk w JOIN nodes n USING (tree, node) JOIN features f ON f.vin = w.vin WHERE n.feature IS NOT NULL)
      SELECT vin, 1 / (1 + exp(-2 * sum(weight * value))) AS risk
      FROM walk JOIN nodes n USING (tree, node) WHERE n.feature IS NULL GROUP BY vin"""
    by_sql = dict(duckdb.sql(sql).fetchall())
    by_model = {r.vin: r.risk for r in risk.score(rows, model).collect()}
    by_table = {r.vin: r.risk for r in risk_tables.score_by_table(rows, trees).collect()}
    assert by_sql.keys() == by_model.keys() == by_table.keys() and len(set(by_model.values())) > 1
    for vin, p in by_model.items():
        assert by_sql[vin] == pytest.approx(p, abs=1e-12) and by_table[vin] == pytest.approx(p, abs=1e-12)


def test_scoring_by_table_takes_missing_features_as_zero_and_shuffles_no_rows(fitted):
    rows, model, trees = fitted
    gaps = rows.withColumn("dtc_ratio", F.lit(None).cast("double")).drop("odo_km")
    expected = {r.vin: r.risk for r in risk.score(gaps, model).collect()}
    assert {r.vin: r.risk for r in risk_tables.score_by_table(gaps, trees).collect()} == pytest.approx(expected, abs=1e-12)
    step, names = risk_tables.score_by_table(rows, trees)._jdf.queryExecution().optimizedPlan(), set()
    while step.children().nonEmpty():
        names.add(step.nodeName())
        step = step.children().head()
    assert names == {"Project"}  # the model is a scalar subquery beside it
    assert risk_tables.score_by_table(rows.limit(0), trees).count() == 0


def _events(spark, days, seq):
    rows = [(1, "V", "A", dt.datetime(2024, 1, d, 12), float(d), seq + d) for d in days]
    df = spark.createDataFrame(rows, "fleet_id int, vin string, oem string, ts timestamp, x double, seq long")
    return df.select(
        "fleet_id", "vin", "oem", "ts", "seq", *[F.col("x").alias(c) for c in ("lat", "lon", "speed_kmh", "odo_km", "fuel_pct", "rpm")],
        F.lit(True).alias("engine_on"), F.array(F.lit("P0301")).alias("dtc"), F.lit(None).cast("string").alias("evt"),
    )


def test_days_move_once_late_rows_follow_and_rows_stay_whole(spark):
    path = shared_dir(spark, "tiers")
    roots, ages = {"cold": f"{path}/cold"}, {"hot": 7, "cold": 30}
    for batch, days in enumerate(([2, 3, 30], [3, 24])):
        sinks.write_telemetry_batch(_events(spark, days, 100 * batch), batch, path)
    moved = sinks.move_tiers(spark, path, roots, AS_OF, ages)
    assert sorted((r.day, r.tier, r.rows) for r in moved.collect()) == [("2024-01-02", "cold", 1), ("2024-01-03", "cold", 1), ("2024-01-03", "cold", 1)]
    assert sinks.move_tiers(spark, path, roots, AS_OF, ages).count() == 0
    sinks.write_telemetry_batch(_events(spark, [2], 200), 2, path)  # a late row of a day that has moved
    assert [r.rows for r in sinks.move_tiers(spark, path, roots, AS_OF, ages).collect()] == [1]
    lies = {(r.day, r.place): r.rows for r in sinks.tier_storage(spark, path, roots, AS_OF, ages).collect()}
    assert lies == {("2024-01-02", "cold"): 2, ("2024-01-03", "cold"): 2, ("2024-01-24", "hot"): 1, ("2024-01-30", "hot"): 1}
    assert sorted(r.seq for r in batches.read_batches(spark, path).collect()) == [2, 3, 30, 103, 124, 202]
    # a replay after the move changes nothing
    sinks.write_telemetry_batch(_events(spark, [2, 3, 30], 0), 0, path)
    assert batches.read_batches(spark, path).count() == 6


def test_a_move_ended_before_its_commit_leaves_the_table(spark, monkeypatch):
    path = shared_dir(spark, "tiers")
    sinks.write_telemetry_batch(_events(spark, [2, 30], 0), 0, path)

    def fail(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(batches, "commit", fail)
        with pytest.raises(OSError):
            sinks.move_tiers(spark, path, {"cold": f"{path}/cold"}, AS_OF, {"hot": 7, "cold": 30})
    assert batches.read_batches(spark, path).count() == 2
    assert sinks.move_tiers(spark, path, {"cold": f"{path}/cold"}, AS_OF, {"hot": 7, "cold": 30}).count() == 1
    assert batches.read_batches(spark, path).count() == 2


def _scanned(df):
    """Rows that the scan of a collected plan gave on."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def _fleet_day(spark, first, vehicles, each):
    """Rows of many vehicles on one day; seconds run through the vehicles, so arrival order spreads each over the whole day."""
    rows = spark.range(vehicles * each).select(F.concat(F.lit("VIN"), F.lpad((first + F.col("id") % vehicles).cast("string"), 14, "0")).alias("vin"), "id")
    at = F.timestamp_seconds(F.lit(int(dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc).timestamp())) + F.col("id") % 86_000)
    return rows.select(
        F.lit(1).alias("fleet_id"), "vin", F.lit("a").alias("oem"), at.alias("ts"), F.col("id").alias("seq"),
        *[F.lit(1.0).alias(c) for c in ("lat", "lon", "speed_kmh", "odo_km", "fuel_pct", "rpm")],
        F.lit(True).alias("engine_on"), F.array(F.lit("P0301")).alias("dtc"), F.lit(None).cast("string").alias("evt"),
    )


def test_one_vehicle_is_read_without_its_day(spark):
    """400 vehicles with 1 000 rows each: a look-up gets a few pages, wherever the vehicle lies."""
    path = shared_dir(spark, "look-up")
    sinks.write_telemetry(_fleet_day(spark, 0, 400, 1000), path)
    day = spark.read.parquet(path).filter("day = '2024-01-02'")
    for number in (0, 213, 399):
        one = day.filter(F.col("vin") == f"VIN{number:014d}").select("vin", "ts")
        assert _scanned(one) <= 400_000 / 8 and one.count() == 1000


def test_a_vehicle_that_a_file_lacks_is_seen_by_its_bloom_filter(spark):
    """150 000 vehicles are too many for a dictionary; even numbers only, so the smallest and largest say nothing of an odd one."""
    path = shared_dir(spark, "bloom")
    rows = _fleet_day(spark, 0, 150_000, 1).withColumn("vin", F.concat(F.lit("VIN"), F.lpad((F.col("seq") * 2).cast("string"), 14, "0"))).coalesce(1)
    plain = f"{path}/plain"
    with_filter = f"{path}/bloom"
    stored = sinks.to_storage_rows(rows).withColumn("day", F.to_date("ts")).sortWithinPartitions(*sinks.ORDER)
    stored.write.options(**sinks.FILES).parquet(with_filter)
    stored.write.parquet(plain)
    lacking = [f"VIN{n:014d}" for n in range(1001, 300_000, 50_000)]
    got = {p: sum(_scanned(spark.read.parquet(p).filter(F.col("vin") == v).select("vin", "ts")) for v in lacking) for p in (plain, with_filter)}
    assert got[with_filter] < got[plain] / 2
    assert spark.read.parquet(with_filter).filter(F.col("vin") == "VIN00000000002000").count() == 1


def test_batches_of_a_day_are_put_together_but_the_newest(spark):
    path = shared_dir(spark, "days")
    for batch in range(4):
        sinks.write_telemetry_batch(_fleet_day(spark, 0, 20, 50).filter(F.col("seq") % 4 == batch), batch, path)
    sinks.write_telemetry_batch(_events(spark, [30], 5000), 4, path)
    before = sorted(r.seq for r in batches.read_batches(spark, path).collect())
    done = sinks.compact_days(spark, path, dt.date(2024, 1, 20)).collect()
    assert [(str(r.day), r.folders, r.rows) for r in done] == [("2024-01-02", 4, 1000)]
    assert sorted(r.seq for r in batches.read_batches(spark, path).collect()) == before
    assert sinks.compact_days(spark, path, dt.date(2024, 1, 20)).count() == 0
    # a late batch of that day joins it once it is no longer the newest
    sinks.write_telemetry_batch(_events(spark, [2], 7000), 5, path)
    assert sinks.compact_days(spark, path, dt.date(2024, 1, 20)).count() == 0
    sinks.write_telemetry_batch(_events(spark, [30], 8000), 6, path)
    assert [(r.folders, r.rows) for r in sinks.compact_days(spark, path, dt.date(2024, 1, 20)).collect()] == [(2, 1001)]
    assert len([e for e in batches.live(spark, path) if e.part == "2024-01-02"]) == 1
