"""Streaming dedup, latest state, rollup and alert feed."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from convoy.operators.cooldown import apply_cooldown
from convoy.operators.dedup import EVENT_KEYS, dedup_exact
from convoy.operators.rollup import ROLLUP_KEYS, hourly_rollup, merge_rollups, rollup_aggregates
from convoy.operators.state import latest_state
from convoy.sources.batches import current_run, live, read_batches, take_out, write_batch


HORIZON = dt.timedelta(hours=1)
#: How far behind the newest stored arrival a copy may still come and be known as one.
LATENESS = dt.timedelta(days=2)


def _ms(span: dt.timedelta) -> int:
    return int(span.total_seconds() * 1000)


def first_in_horizon(
    df: DataFrame, keys: tuple[str, ...] = EVENT_KEYS, horizon: dt.timedelta = HORIZON, time_col: str = "received_at", order: str = "arrival"
) -> DataFrame:
    """The rows that a memory of ``horizon`` lets through: a key's first arrival, then the first one at least a horizon
    after the row let through before it, and so on.

    Copies collapse before the shuffle; only keys whose copies lie a horizon or more apart go through the chain, which
    works in slices of time, however many copies a key has.
    """
    at = F.unix_millis(time_col)
    rest = [c for c in df.columns if c not in keys]
    firsts = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(time_col, order)).alias("_first"), (F.max(at) - F.min(at) >= _ms(horizon)).alias("_wide")
    )
    one = firsts.where(~F.col("_wide")).select(*keys, "_first.*").select(*df.columns)
    wide = firsts.where("_wide").select(*[F.col(k).alias(f"_of_{k}") for k in keys])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    several = df.join(wide, same, "left_semi")
    return one.unionByName(apply_cooldown(several, _ms(horizon) / 60_000, keys, time_col, (time_col, order)))


def unseen_by_key(
    df: DataFrame, seen: DataFrame, keys: tuple[str, ...] = EVENT_KEYS, horizon: dt.timedelta = HORIZON, time_col: str = "received_at", order: str = "arrival"
) -> DataFrame:
    """Rows that lie a horizon or more from every stored arrival of their key, and of those the ones of :func:`first_in_horizon`.

    One shuffle of rows and stored arrivals, and one group per key that holds all of its copies: for keys of few copies. Rows
    without a time are left out, as by the chain.
    """
    reach, never = _ms(horizon), F.lit(-(2**62))
    rest = [c for c in df.columns if c not in keys]
    rows = df.where(F.col(time_col).isNotNull()).select(*keys, F.struct(*rest).alias("_row"))
    arrivals = seen.select(*keys, F.unix_millis(time_col).alias("_stored"))
    groups = rows.unionByName(arrivals, allowMissingColumns=True).groupBy(*keys).agg(F.collect_list("_row").alias("_rows"), F.collect_list("_stored").alias("_stored"))
    # times with their places in the group are sorted, not the rows, whose types may have no order
    placed = F.transform("_rows", lambda x, i: F.struct(x[time_col].alias("time"), x[order].alias("order"), i.alias("i"), F.unix_millis(x[time_col]).alias("t")))
    apart = F.filter(placed, lambda x: ~F.exists("_stored", lambda s: F.abs(x["t"] - s) < reach))
    picked = F.aggregate(
        F.sort_array(apart),
        F.struct(never.alias("last"), F.array().cast("array<int>").alias("at")),
        lambda acc, x: F.when(x["t"] - acc["last"] >= reach, F.struct(x["t"].alias("last"), F.array_append(acc["at"], x["i"]).alias("at"))).otherwise(acc),
        lambda acc: F.transform(acc["at"], lambda i: F.get("_rows", i)),
    )
    alone = (F.size("_rows") == 1) & (F.size("_stored") == 0)
    return groups.select(*keys, F.explode(F.when(alone, F.col("_rows")).otherwise(picked)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


#: Hash buckets in which the copies of a micro-batch's keys are counted, and the rows that any of them may hold without being crowded.
BUCKETS, FEW = 4096, 10_000


def crowded(counts: dict[int, int], few: int = FEW) -> list[int]:
    """Hash buckets with more than ``few`` rows and four times the mean. A key outside of them has no more copies than that."""
    bound = max(few, 4 * sum(counts.values()) // BUCKETS)
    return sorted(b for b, n in counts.items() if n > bound)


def unseen(
    batch: DataFrame,
    seen_path: str,
    batch_id: int,
    keys: tuple[str, ...] = EVENT_KEYS,
    horizon: dt.timedelta = HORIZON,
    time_col: str = "received_at",
    order: str = "arrival",
    lateness: dt.timedelta = LATENESS,
    run: str | None = None,
    few: int = FEW,
) -> DataFrame:
    """The rows of a micro-batch that are no copies: none of the key was stored within ``horizon``, here or in another batch.

    The horizon runs from a key's stored arrival and is not renewed by the copies that it silences, so for rows that
    come in order of arrival the result is that of one pass over all of them, however they are cut into batches. A row
    that comes out of order is a copy if a stored one lies within the horizon on either side; an unseen key is kept however late.
    Stored arrivals lie in folders by stretches of time, and only those within reach of the batch are read. Copies are counted
    in hash buckets first: keys of crowded buckets (``few``) go through the chain in slices, all others through one group per key.
    """
    spark = batch.sparkSession
    reach = _ms(horizon)
    at, bucket = F.unix_millis(time_col), F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    counted = batch.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high")).collect()
    times = [t for r in counted for t in (r.low, r.high) if t is not None]
    if not times:
        return batch
    low, high = min(times), max(times)
    own, width = (run or current_run(spark), batch_id), slot_ms(horizon, lateness)

    def near(e) -> bool:
        return (e.run, e.batch_id) != own and (low - reach) // width <= int(e.part) <= (high + reach) // width

    schema = T.StructType([*[batch.schema[k] for k in keys], batch.schema[time_col]]).add("slot", T.LongType())
    seen = read_batches(spark, seen_path, schema, near)
    close = F.abs(F.unix_millis(f"e.{time_col}") - F.unix_millis(f"s.{time_col}")) < reach
    same = reduce(lambda x, y: x & y, [F.col(f"e.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])

    def apart(rows: DataFrame) -> DataFrame:
        return rows.alias("e").join(seen.alias("s"), same & close, "left_anti")

    if high - low < reach:  # a batch shorter than the horizon lets a key through once
        return dedup_exact(apart(batch), keys, (time_col, order))
    full = crowded({r.bucket: r.n for r in counted}, few)
    if not full:
        return unseen_by_key(batch, seen, keys, horizon, time_col, order)
    in_full = bucket.isin(full)
    return unseen_by_key(batch.where(~in_full), seen.where(~in_full), keys, horizon, time_col, order).unionByName(
        first_in_horizon(apart(batch.where(in_full)), keys, horizon, time_col, order)
    )


def slot_ms(horizon: dt.timedelta, lateness: dt.timedelta) -> int:
    """Width of the stretches of arrival time in which remembered arrivals lie: few folders, and little kept too long."""
    return max(_ms(horizon), _ms(lateness) // 4)


def remember(
    stored: DataFrame, seen_path: str, batch_id: int, keys: tuple[str, ...] = EVENT_KEYS, horizon: dt.timedelta = HORIZON,
    time_col: str = "received_at", lateness: dt.timedelta = LATENESS, run: str | None = None,
) -> None:
    """Add the arrivals that a batch stored to the remembered ones."""
    slot = F.floor(F.unix_millis(time_col) / F.lit(slot_ms(horizon, lateness))).alias("slot")
    write_batch(stored.select(*keys, time_col, slot), batch_id, seen_path, "slot", run)


def forget(
    spark: SparkSession, seen_path: str, batch_id: int, horizon: dt.timedelta = HORIZON, lateness: dt.timedelta = LATENESS, run: str | None = None
) -> DataFrame:
    """Deletes stretches of remembered arrivals that end horizon and lateness before the newest one; returns what went.

    The batch that is being worked on does not count, so its replay forgets the same.
    """
    own, width = (run or current_run(spark), batch_id), slot_ms(horizon, lateness)
    slots = [int(e.part) for e in live(spark, seen_path) if (e.run, e.batch_id) != own]
    # the newest arrival is as late as the begin of its stretch, or later; a stretch ends where the next begins
    bound = max(slots, default=0) * width - _ms(horizon) - _ms(lateness)
    return take_out(spark, seen_path, lambda e: (e.run, e.batch_id) != own and (int(e.part) + 1) * width <= bound, "forget")


def dedup_batches(
    path: str,
    keys: tuple[str, ...] = EVENT_KEYS,
    horizon: dt.timedelta = HORIZON,
    time_col: str = "received_at",
    order: str = "arrival",
    lateness: dt.timedelta = LATENESS,
):
    """Micro-batch sink that drops copies of a key within the horizon of its stored arrival.

    Rows go to ``path/rows``, arrivals to ``path/seen``, where those beyond horizon and lateness are deleted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = f"{path}/seen"
        forget(batch.sparkSession, seen, batch_id, horizon, lateness)
        kept = unseen(batch, seen, batch_id, keys, horizon, time_col, order, lateness)
        stored = write_batch(kept, batch_id, f"{path}/rows")
        remember(stored, seen, batch_id, keys, horizon, time_col, lateness)

    return write


def rollup_partials(path: str):
    """Micro-batch sink: the batch's own rollup. Readers merge."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(hourly_rollup(batch), batch_id, path)

    return write


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return merge_rollups(read_batches(spark, path).drop("run", "batch_id"))


def hourly_rollup_stream(stream: DataFrame, late: str | None = None, **limits) -> DataFrame:
    """The rollup as a tumbling window, in update mode.

    Every row counts, however late: without ``late`` the state keeps all hours, one row per vehicle and
    hour. ``late`` bounds the state with a watermark; Spark leaves out rows that come later still, so let
    :func:`route_late` take them to a table of their own first.
    """
    limits = {"idle_kmh": 1.0, "over_kmh": 110.0, "low_pct": 10.0, **limits}
    timed = stream if late is None else stream.withWatermark("ts", late)
    return (
        timed.groupBy("fleet_id", "vin", F.window("ts", "1 hour").alias("w"))
        .agg(*rollup_aggregates(**limits))
        .withColumn("hour", F.col("w.start"))
        .drop("w")
    )


def route_late(path: str, late: dt.timedelta):
    """Micro-batch sink in front of :func:`hourly_rollup_stream`: splits a batch by what the window can still take.

    Rows of hours that ended ``late`` before the newest event of earlier batches are rolled up into ``path/late``; the others
    are stored in ``path/on_time``. A window with that watermark which follows the finished batches of ``path/on_time``
    has never passed one of them, as its newest event is none newer. ``path/newest`` has each batch's newest event.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = current_run(spark)
        before = lambda e: (e.run, e.batch_id) != (run, batch_id)
        newest = read_batches(spark, f"{path}/newest", T.StructType().add("ts", "timestamp"), before).agg(F.max(F.unix_millis("ts"))).first()[0]
        ended = F.floor(F.unix_millis("ts") / 3_600_000) * 3_600_000 + 3_600_000
        passed = F.lit(False) if newest is None else ended <= newest - _ms(late)
        write_batch(hourly_rollup(batch.where(passed)), batch_id, f"{path}/late")
        write_batch(batch.where(~passed), batch_id, f"{path}/on_time")
        write_batch(batch.agg(F.max("ts").alias("ts")), batch_id, f"{path}/newest")

    return write


def read_window_rollup(spark: SparkSession, windows: str, late: str) -> DataFrame:
    """Hours of the window's own rows and of the late ones, merged."""
    return merge_rollups(read_updated(spark, windows), read_batches(spark, late).drop("run", "batch_id"))


def updated_rows(path: str):
    """Micro-batch sink for update mode: every batch's changed rows under its number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, path)

    return write


def read_updated(spark: SparkSession, path: str, keys: tuple[str, ...] = ROLLUP_KEYS) -> DataFrame:
    """The newest version of every row written by :func:`updated_rows`."""
    rows = read_batches(spark, path)
    rest = [c for c in rows.columns if c not in (*keys, "run", "batch_id")]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("_row"))
        .select(*keys, "_row.*")
    )


def latest_partials(path: str):
    """Micro-batch sink: the batch's latest row per vehicle. Readers merge."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(latest_state(batch), batch_id, path)

    return write


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return latest_state(read_batches(spark, path).drop("run", "batch_id"))


def alert_feed(stream: DataFrame, tenant_id: int) -> DataFrame:
    """A tenant's alerts as they appear."""
    return stream.filter(F.col("tenant_id") == tenant_id)
