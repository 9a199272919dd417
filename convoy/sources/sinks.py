"""Telemetry storage: row projection, clustered write, idempotent batches, retention, tiers."""

from __future__ import annotations

import datetime as dt
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, functions as F

from convoy.sources.batches import live, relocate, take_out, write_batch

#: Order of stored rows. A vehicle's rows of a day lie together, so min/max of pages and row groups find them.
ORDER = ["day", "fleet_id", "vin", "ts"]
#: Files say which vehicles they hold: by their dictionary while it fits, else by a Bloom filter that grows with their number.
FILES = {"parquet.bloom.filter.enabled#vin": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def to_storage_rows(df: DataFrame) -> DataFrame:
    """The stored form of accepted events: unknown fuel and rpm as 0, no event as empty text."""
    return df.select(
        F.col("fleet_id"),
        F.col("vin"),
        F.col("ts"),
        F.col("lat").cast("float").alias("lat"),
        F.col("lon").cast("float").alias("lon"),
        F.col("speed_kmh").cast("float").alias("speed_kmh"),
        F.col("odo_km").cast("double").alias("odo_km"),
        F.coalesce("fuel_pct", F.lit(0.0)).cast("float").alias("fuel_pct"),
        F.col("engine_on").cast("int").alias("engine_on"),
        F.floor(F.coalesce(F.col("rpm").cast("double"), F.lit(0.0)) + 0.5).cast("int").alias("rpm"),
        F.col("dtc"),
        F.coalesce("evt", F.lit("")).alias("evt"),
        F.col("seq"),
        F.col("oem"),
    )


def write_telemetry(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write storage rows by day, clustered by (fleet, vin, ts), with Bloom filters on vin.

    Range partitioning ends with the time, so a day or vehicle with most of the rows is spread over
    many tasks while each file still covers a narrow key range for min/max pruning.
    """
    (
        to_storage_rows(df)
        .withColumn("day", F.to_date("ts"))
        .repartitionByRange(*ORDER)
        .sortWithinPartitions(*ORDER)
        .write.mode(mode)
        .options(**FILES)
        .partitionBy("day")
        .parquet(path)
    )


def write_telemetry_batch(df: DataFrame, batch_id: int, path: str, run: str | None = None) -> DataFrame:
    """A micro-batch's storage rows by day, clustered by (fleet, vin, ts) within it."""
    rows = to_storage_rows(df).withColumn("day", F.to_date("ts"))
    return write_batch(rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER), batch_id, path, "day", run, options=FILES)


def compact_days(spark: SparkSession, path: str, before: dt.date, folders: int = 2) -> DataFrame:
    """Puts the batches of whole days before ``before`` together, so that a vehicle's day lies in one place again.

    Takes days of which at least ``folders`` batches lie in the stream's own place; one job and one commit for all of them. The
    newest batch of a run, which may be replayed, stays as it is. A second run finds nothing. Returns day, folders, rows, bytes as they were.
    """
    entries = [e for e in live(spark, path) if e.part is not None and e.folder.startswith(f"{path}/data/run=")]
    newest = {run: max(e.batch_id for e in entries if e.run == run) for run in {e.run for e in entries}}
    old = [e for e in entries if e.part < before.isoformat() and (e.run == "days" or e.batch_id < newest[e.run])]
    count = Counter(e.part for e in old)
    picked = [e for e in old if count[e.part] >= max(folders, 2)]
    if picked:
        relocate(spark, path, picked, f"{path}/data", "days", "day", ORDER, FILES)
    rows = spark.createDataFrame([(e.part, e.rows, e.bytes) for e in picked], "day string, rows bigint, bytes bigint")
    return rows.groupBy("day").agg(F.count("*").alias("folders"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def since(df: DataFrame, ts_col: str, start: dt.datetime, after: bool = False) -> DataFrame:
    """Rows from ``start`` on (only later ones if ``after``).

    Tables written by day have the column ``day``; naming it too lets Spark leave out whole days, which it
    does not conclude from ``ts_col``.
    """
    bound = F.lit(start)
    rows = df.filter(F.col(ts_col) > bound if after else F.col(ts_col) >= bound)
    return rows.filter(F.col("day") >= F.lit(start.date())) if "day" in df.columns else rows


def retain(df: DataFrame, ts_col: str, days: int, as_of: dt.datetime) -> DataFrame:
    """Rows younger than ``days``; the bound is a literal, and days that lie before it are not read."""
    return since(df, ts_col, as_of - dt.timedelta(days=days), after=True)


def expire(spark: SparkSession, path: str, days: int, as_of: dt.datetime) -> DataFrame:
    """Deletes the days of a table written by day of which no row is younger than ``days``; returns day, rows, bytes of each.

    Rows of the day on which the bound falls stay until the day has passed; :func:`retain` leaves them out of a reading.
    A second run finds nothing.
    """
    first = (as_of - dt.timedelta(days=days)).date().isoformat()
    gone = take_out(spark, path, lambda e: e.part is not None and e.part < first, "retention")
    return gone.groupBy(F.col("part").alias("day")).agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


# Days kept per table.
RETENTION_DAYS = {"telemetry": 365, "dead_letter": 3, "raw_archive": 7}


def label_tier(
    df: DataFrame, ts_col: str, as_of: dt.datetime, hot: int = 7, warm: int = 90, cold: int = 365
) -> DataFrame:
    """Add ``tier`` by age: hot, warm, cold or expired."""

    def younger(days: int):
        return F.col(ts_col) >= F.lit(as_of - dt.timedelta(days=days))

    return df.withColumn(
        "tier",
        F.when(younger(hot), F.lit("hot"))
        .when(younger(warm), F.lit("warm"))
        .when(younger(cold), F.lit("cold"))
        .otherwise(F.lit("expired")),
    )


def tier_report(df: DataFrame, ts_col: str, as_of: dt.datetime, **tiers) -> DataFrame:
    """Rows and time span per tier."""
    return (
        label_tier(df, ts_col, as_of, **tiers)
        .groupBy("tier")
        .agg(
            F.count("*").alias("n"), F.min(ts_col).alias("oldest"), F.max(ts_col).alias("newest")
        )
    )


# Days until a row leaves a tier.
TIER_DAYS = {"hot": 7, "warm": 90, "cold": 365}


def day_tier(day: str, as_of: dt.datetime, days: dict[str, int] | None = None) -> str:
    """Tier of a whole day (ISO text): that of its youngest moment."""
    for tier, age in (days or TIER_DAYS).items():
        if day >= (as_of - dt.timedelta(days=age)).date().isoformat():
            return tier
    return "expired"


def tier_storage(spark: SparkSession, path: str, roots: dict[str, str], as_of: dt.datetime, days: dict[str, int] | None = None) -> DataFrame:
    """What the manifest of a table written by day holds: day, tier (by age), place (by folder; hot is the stream's own), rows, bytes.

    No data file is read. ``roots`` names the folder of each tier that has one.
    """
    rows = [
        (e.part, day_tier(e.part, as_of, days), next((t for t, r in roots.items() if e.folder.startswith(f"{r}/run=")), "hot"), e.rows, e.bytes)
        for e in live(spark, path)
        if e.part is not None
    ]
    listed = spark.createDataFrame(rows, "day string, tier string, place string, rows bigint, bytes bigint")
    return listed.groupBy("day", "tier", "place").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def move_tiers(spark: SparkSession, path: str, roots: dict[str, str], as_of: dt.datetime, days: dict[str, int] | None = None) -> DataFrame:
    """Moves whole days into the folder of their tier: one job and one commit a tier, all files of a day put together.

    Days in place and tiers without a root stay where they are, so a second run moves nothing. Late rows of a day that
    has moved are moved by the next run. Returns what moved: day, tier, rows, bytes (as they were before).
    """
    moved = []
    for tier, root in roots.items():
        picked = [
            e for e in live(spark, path) if e.part is not None and day_tier(e.part, as_of, days) == tier and not e.folder.startswith(f"{root}/run=")
        ]
        if picked:
            relocate(spark, path, picked, root, f"tier-{tier}", "day", ORDER, FILES)
            moved += [(e.part, tier, e.rows, e.bytes) for e in picked]
    return spark.createDataFrame(moved, "day string, tier string, rows bigint, bytes bigint")
