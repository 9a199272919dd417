"""The five rules in one pass over the events: hits before the cooldown.

Events are dealt once, by vehicle and slice of time. Where a slice begins depends on what lies before it only through a few
numbers: the moving average, whether the vehicle stood idle and since when, and the times of the last hour's fault
codes and ten minutes' brakes. The last are few and are dealt to the next slice with the events. The others
are a summary of each slice: the average as coefficients of the one it starts from, the idling as open
at either end. Summaries merge in order, so one scan per vehicle over one row per slice gives every
slice its start, and a second reading of the same dealt events finds the hits.

Inside a task rows stream through in Arrow batches, and what a batch leaves open goes on to the next,
so no slice is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from convoy.schemas import RULE_SEVERITY
from convoy.operators.rule_columns import deviations, long_idlings, window_counts

SUMMARY = (
    "vin string, _slice bigint, n bigint, ref double, decay double, mean_0 double, p double, q double, r double, "
    "breaks boolean, since bigint, last_idle bigint"
)
START = "vin string, _slice bigint, n0 bigint, mean0 double, var0 double, since0 bigint, told0 boolean"
HITS = "vin string, code string, t bigint, seq bigint, pos int, number double, whole bigint, text string"
NONE = -(2**62)


def _groups(pdf: pd.DataFrame) -> Iterator[tuple[tuple, slice]]:
    """Stretches of one vehicle and slice in a batch sorted by them."""
    vin, part = pdf["vin"].to_numpy(), pdf["_slice"].to_numpy()
    change = np.flatnonzero((vin[1:] != vin[:-1]) | (part[1:] != part[:-1])) + 1
    for a, b in zip([0, *change], [*change, len(pdf)], strict=True):
        if a < b:
            yield (vin[a], part[a]), slice(a, b)


class _Average:
    """The moving average after some samples as a function of the one before them (see ewma.py)."""

    def __init__(self, ref: float):
        self.n, self.ref, self.decay, self.offset, self.p, self.q, self.r = 0, ref, 1.0, 0.0, 0.0, 0.0, 0.0

    def add(self, x: np.ndarray, alpha: float) -> None:
        keep, n = 1 - alpha, len(x)
        at = np.arange(n)
        means = pd.Series(np.append(self.ref, x)).ewm(alpha=alpha, adjust=False).mean().to_numpy()
        c, weight = x - means[:-1], alpha * keep ** (n - at)
        decay, offset = keep**n, means[-1] - self.ref
        p, q, r = (weight * c * c).sum(), 2 * (weight * c * keep**at).sum(), (weight * keep ** (2 * at)).sum()
        # these samples' function of what those before them leave
        a0, k = self.decay, self.offset
        self.p, self.q, self.r = decay * self.p + p - q * k + r * k * k, decay * self.q + q * a0 - 2 * r * a0 * k, decay * self.r + r * a0 * a0
        self.decay, self.offset, self.n = decay * a0, decay * k + offset, self.n + n


def _summarise(alpha: float, moving_kmh: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, average, idle, done = None, None, None, []

        def close() -> None:
            if key is not None and average is not None:
                a = average
                done.append((*key, a.n, a.ref, a.decay, a.ref + a.offset, a.p, a.q, a.r, *idle))

        for pdf in batches:
            own, t, speed = pdf["own"].to_numpy(bool), pdf["t"].to_numpy(np.int64), pdf["speed_kmh"].to_numpy(np.float64)
            still_all = pdf["engine_on"].to_numpy(bool) & (speed < moving_kmh)
            for this, rows in _groups(pdf):
                if this != key:
                    close()
                    key, average, idle = this, None, None
                mine = own[rows]
                if not mine.any():
                    continue
                x, at, still = speed[rows][mine], t[rows][mine], still_all[rows][mine]
                if average is None:
                    average, idle = _Average(float(x[0])), (False, NONE, NONE)
                average.add(x, alpha)
                breaks, since, last = idle
                if still.all():
                    since, last = since if since != NONE else int(at[0]), int(at[-1])
                else:
                    breaks, cut = True, int(np.flatnonzero(~still)[-1])
                    since, last = (int(at[cut + 1]), int(at[-1])) if cut + 1 < len(at) else (NONE, NONE)
                idle = (breaks, since, last)
            if done:
                yield pd.DataFrame(done, columns=_names(SUMMARY))
                done = []
        close()
        yield pd.DataFrame(done, columns=_names(SUMMARY))

    return run


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _chain(idle_ms: int):
    """The start of every slice, from the summaries in order of vehicle and slice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vin = None
        for pdf in batches:
            rows = []
            for this, part, n, ref, decay, mean_0, p, q, r, breaks, open_, last in pdf.itertuples(index=False, name=None):
                if this != vin:
                    vin, count, mean, var, since, told = this, 0, ref, 0.0, NONE, False
                rows.append((vin, part, count, mean, var, since, told))
                u = mean - ref
                mean, var = decay * u + mean_0, max(0.0, decay * var + p - q * u + r * u * u)
                count += n
                # an idling that was open goes on through a slice without a break
                since = open_ if breaks or since == NONE else since
                told = since != NONE and last - since >= idle_ms
            yield pd.DataFrame(rows, columns=_names(START))

    return run


class _Walk:
    """What one slice's rows so far leave to the next of them."""

    def __init__(self, n: int, mean: float, var: float, since: int, told: bool):
        self.average, self.since, self.told = (n, mean, var), None if since == NONE else since, told
        self.past: dict[str, np.ndarray] = {}

    def counts(self, code: str, t: np.ndarray, window: int) -> np.ndarray:
        past = self.past.get(code, np.zeros(0, np.int64))
        n = window_counts(past, t, window)
        both = np.append(past, t)
        self.past[code] = both[both > t[-1] - window]
        return n


def _hits(params: dict):
    wait, alpha, warmup, moving = params["idle_ms"], params["alpha"], params["warmup"], params["moving_kmh"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = walk = None
        for pdf in batches:
            own, t, speed = pdf["own"].to_numpy(bool), pdf["t"].to_numpy(np.int64), pdf["speed_kmh"].to_numpy(np.float64)
            still, brake = pdf["engine_on"].to_numpy(bool) & (speed < moving), pdf["brake"].to_numpy(bool)
            size = np.array([0 if c is None else len(c) for c in pdf["codes"]], np.int64)
            n0, mean0, var0, since0, told0 = (pdf[c].to_numpy() for c in _names(START)[2:])
            found: list[tuple[str, np.ndarray, object, object, object, object]] = []
            z_all = np.zeros(len(pdf))
            for this, rows in _groups(pdf):
                if this != key:
                    k = rows.start
                    key, walk = this, _Walk(int(n0[k]), float(mean0[k]), float(var0[k]), int(since0[k]), bool(told0[k]))
                at = np.arange(rows.start, rows.stop)
                b = at[brake[rows]]
                if len(b):
                    n = walk.counts("", t[b], params["brake_ms"])
                    hit = own[b] & (n >= params["brake_n"])
                    found.append(("HARSH_BRAKE_BURST", b[hit], 0, np.nan, n[hit], None))
                listed = at[size[rows] > 0]
                if len(listed):
                    row = np.repeat(listed, size[listed])
                    code = np.concatenate([np.asarray(c, object) for c in pdf["codes"].iloc[listed]])
                    pos = np.arange(len(row)) - np.repeat(np.cumsum(size[listed]) - size[listed], size[listed])
                    for name in set(code):
                        k = np.flatnonzero(code == name)
                        n = walk.counts(name, t[row[k]], params["code_ms"])
                        hit = own[row[k]] & (n >= params["code_n"])
                        found.append(("DTC_REPEAT", row[k][hit], pos[k][hit], np.nan, n[hit], name))
                mine = at[own[rows]]
                if not len(mine):
                    continue
                hit, minutes, walk.since, walk.told = long_idlings(t[mine], still[mine], walk.since, walk.told, wait)
                found.append(("IDLING_EXCESSIVE", mine[hit], 0, np.nan, minutes, None))
                z_all[mine], *walk.average = deviations(speed[mine], *walk.average, alpha, warmup)
            fast = np.flatnonzero(own & (z_all > params["z"]) & (speed > params["min_kmh"]))
            found.append(("OVERSPEED_ANOMALY", fast, 0, z_all[fast], -1, None))
            fuel = pdf["fuel_pct"].to_numpy(np.float64)
            low = np.flatnonzero(own & (fuel < params["low_pct"]))
            found.append(("LOW_FUEL", low, 0, fuel[low], -1, None))
            yield _table(pdf, t, speed, found)

    return run


def _table(pdf: pd.DataFrame, t: np.ndarray, speed: np.ndarray, found: list) -> pd.DataFrame:
    found = [f for f in found if len(f[1])]
    row = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    spread = lambda k, dtype: np.concatenate([np.full(len(f[1]), f[k], dtype) for f in found]) if found else np.zeros(0, dtype)
    return pd.DataFrame(
        {
            "vin": pdf["vin"].to_numpy()[row], "code": spread(0, object), "t": t[row], "seq": pdf["seq"].to_numpy()[row],
            "pos": spread(2, np.int32), "number": spread(3, np.float64), "whole": spread(4, np.int64), "text": spread(5, object),
            "speed_kmh": speed[row],
        }
    )


def rule_hits(df: DataFrame, params: dict, slice_ms: int) -> DataFrame:
    """Hits of all five rules: ``vin, code, severity, ts, seq, pos, detail``; params as the streaming rules take them."""
    code_ms, brake_ms = params["code_ms"], params["brake_ms"]
    width = max(slice_ms, code_ms, brake_ms)
    t = F.unix_millis("ts")
    slot = F.floor(t / F.lit(width))
    end = (slot + 1) * width
    brake = F.coalesce(F.col("evt") == "HARSH_BRAKE", F.lit(False))
    codes = F.when(F.size("dtc") > 0, F.col("dtc"))
    shown = F.when((codes.isNotNull() & (t > end - code_ms)) | (brake & (t > end - brake_ms)), F.array(slot, slot + 1)).otherwise(F.array(slot))
    rows = df.select(
        F.col("vin").cast("string").alias("vin"), t.alias("t"), F.col("seq").cast("bigint").alias("seq"), slot.alias("_slot"),
        F.coalesce("engine_on", F.lit(False)).alias("engine_on"), F.col("speed_kmh").cast("double").alias("speed_kmh"),
        F.col("fuel_pct").cast("double").alias("fuel_pct"), brake.alias("brake"), codes.alias("codes"), F.explode(shown).alias("_slice"),
    ).withColumn("own", F.col("_slot") == F.col("_slice")).drop("_slot")
    # the only shuffle of the events; a row costs far more than its bytes tell, so partitions are not put together by size
    dealt = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "vin", "_slice")
    order = ("vin", "_slice", "t", "seq")
    starts = (
        dealt.sortWithinPartitions(*order)
        .mapInPandas(_summarise(params["alpha"], params["moving_kmh"]), SUMMARY)
        .repartition("vin")
        .sortWithinPartitions("vin", "_slice")
        .mapInPandas(_chain(params["idle_ms"]), START)
    )
    # a slice that holds rows of the one before only has no start of its own
    keys = ("vin", "_slice")
    side = starts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in _names(START) if c not in keys])
    same = F.col("vin").eqNullSafe(F.col("_of_vin")) & F.col("_slice").eqNullSafe(F.col("_of__slice"))
    joined = dealt.join(side, same, "left").drop("_of_vin", "_of__slice")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip(_names(START)[2:], (0, 0.0, 0.0, NONE, False), strict=True)})
    hits = joined.sortWithinPartitions(*order).mapInPandas(_hits(params), HITS + ", speed_kmh double")
    code = F.col("code")
    detail = (
        F.when(code == "IDLING_EXCESSIVE", F.to_json(F.struct(F.col("whole").alias("idle_minutes"))))
        .when(code == "HARSH_BRAKE_BURST", F.to_json(F.struct(F.col("whole").alias("count_10min"))))
        .when(code == "DTC_REPEAT", F.to_json(F.struct(F.col("text").alias("code"), F.col("whole").alias("count_1h"))))
        .when(code == "OVERSPEED_ANOMALY", F.to_json(F.struct("speed_kmh", F.round("number", 1).alias("z"))))
        .otherwise(F.to_json(F.struct(F.col("number").alias("fuel_pct"))))
    )
    severity = F.coalesce(*[F.when(code == k, v) for k, v in RULE_SEVERITY.items()])
    types = dict(df.dtypes)
    return hits.select(
        "vin", "code", severity.alias("severity"), F.timestamp_millis("t").alias("ts"), F.col("seq").cast(types["seq"]).alias("seq"), "pos", detail.alias("detail")
    )
