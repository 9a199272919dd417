"""The five rules as one stateful operator per vehicle, on columns.

A call takes a vehicle's rows of one micro-batch as arrays in (ts, seq) order. Every rule is a function of
those arrays and of what it remembers, and names the rows it hits; one more function thins the hits
of a rule to one per cooldown. Remembered are the open idling, the moving average, the event times that
a count may still need, and each rule's last alert. Across micro-batches rows count in arrival order.
A call holds eight narrow columns per row; the trigger bounds how many rows that is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convoy.operators.rule_columns import MINUTE, deviations, long_idlings, spaced, window_counts
from convoy.schemas import RULE_SEVERITY

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALERTS = "vin string, code string, severity string, ts_ms bigint, seq bigint, pos int, detail string"
#: What is remembered of a vehicle: open idling, moving average, event times by fault code (harsh brakes under the empty one), last alerts.
VEHICLE = "since bigint, told boolean, n bigint, mean double, var double, times map<string,array<bigint>>, last map<string,bigint>"
ALERT = Row(*[x.split()[0] for x in ALERTS.split(", ")])
NO_POS = np.zeros(0, np.int64)
#: Rows that are held as Python values at a time, before they become arrays.
CHUNK = 10_000


def _columns(rows: Iterator[Row]) -> list:
    """ts_ms, seq, engine_on, speed_kmh, harsh braking, dtc (a list) and fuel_pct of a call's rows, in (ts, seq) order."""
    parts = []
    while chunk := list(islice(rows, CHUNK)):
        _, t, seq, on, speed, evt, dtc, fuel = zip(*chunk)
        parts.append((
            np.array(t, np.int64), np.array(seq, np.int64), np.array(on, bool), np.array(speed, np.float64),
            np.array([e == "HARSH_BRAKE" for e in evt], bool), dtc, np.array(fuel, np.float64),
        ))
    t, seq, on, speed, brake, dtc, fuel = parts[0] if len(parts) == 1 else [
        list(chain.from_iterable(c)) if isinstance(c[0], tuple) else np.concatenate(c) for c in zip(*parts)
    ]
    order = np.lexsort((seq, t))
    return [*(c[order] for c in (t, seq, on, speed, brake)), [dtc[i] for i in order], fuel[order]]


class RuleProcessor(StatefulProcessor):
    """One read and one write of state per vehicle and micro-batch, and arrays in between: most calls hold few rows."""

    def __init__(self, params: dict, ttl_ms: int | None):
        self.p, self.ttl = params, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.vehicle = handle.getValueState("vehicle", VEHICLE, self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        p = self.p
        since, told, n, mean, var, recent, alerted = self.vehicle.get() or (None, False, 0, 0.0, 0.0, {}, {})
        t, seq, on, speed, brake, dtc, fuel = _columns(rows)

        still = on & (speed < p["moving_kmh"])
        at, minutes, since, told = long_idlings(t, still, since, bool(told), p["idle_ms"])
        found = {"IDLING_EXCESSIVE": (at, NO_POS, lambda i, r: {"idle_minutes": int(minutes[i])})}
        z, n, mean, var = deviations(speed, n, mean, var, p["alpha"], p["warmup"])
        fast = np.flatnonzero((z > p["z"]) & (speed > p["min_kmh"]))
        found["OVERSPEED_ANOMALY"] = fast, NO_POS, lambda i, r: {"speed_kmh": float(speed[r]), "z": round(float(z[r]), 1)}
        found["LOW_FUEL"] = np.flatnonzero(fuel < p["low_pct"]), NO_POS, lambda i, r: {"fuel_pct": float(fuel[r])}
        repeats, recent = self._repeats(t, brake, dtc, recent or {})
        found |= repeats

        alerts, last = [], dict(alerted or {})
        for code in sorted(found):
            row, pos, detail = found[code]
            for i in spaced(t[row], last.get(code), p["cooldown_ms"]) if len(row) else ():
                r = int(row[i])
                last[code] = int(t[r])
                alerts.append(ALERT(key[0], code, RULE_SEVERITY[code], last[code], int(seq[r]), int(pos[i]) if len(pos) else 0, json.dumps(detail(i, r))))
        self.vehicle.update((since, told, int(n), float(mean), float(var), recent, last))
        yield from alerts

    def _repeats(self, t: np.ndarray, brake: np.ndarray, dtc: list, recent: dict):
        """Harsh brakes and fault codes: counts per window, over rows and the times still remembered; and what to remember."""
        p = self.p
        kinds: dict[str, tuple[list, list]] = {"": (np.flatnonzero(brake).tolist(), [])}
        for i, codes in enumerate(dtc):
            for pos, code in enumerate(codes or ()):
                if code is not None:
                    rows, places = kinds.setdefault(code, ([], []))
                    rows.append(i)
                    places.append(pos)
        past, found, newest = dict(recent), {"DTC_REPEAT": [], "HARSH_BRAKE_BURST": []}, int(t[-1])
        for code, (rows, places) in kinds.items():
            if not rows:
                continue
            name, window, least = ("DTC_REPEAT", p["code_ms"], p["code_n"]) if code else ("HARSH_BRAKE_BURST", p["brake_ms"], p["brake_n"])
            before, row = np.array(past.get(code, ()), np.int64), np.array(rows)
            n = window_counts(before, t[row], window)
            found[name] += [(rows[i], places[i] if code else 0, code, int(n[i])) for i in np.flatnonzero(n >= least)]
            past[code] = np.sort(np.append(before, t[row]))
        kept = {}
        for k, v in past.items():
            times = np.asarray(v, np.int64)
            times = times[times > newest - (p["code_ms"] if k else p["brake_ms"])].tolist()
            if times:
                kept[k] = times
        out = {}
        for name, hits in found.items():
            hits = sorted(hits)
            told = [{"code": c, "count_1h": m} if c else {"count_10min": m} for _, _, c, m in hits]
            row, pos = (np.array([h[k] for h in hits], np.int64) for k in (0, 1))
            out[name] = row, pos, lambda i, r, told=told: told[i]
        return out, kept

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that multi-variable state needs; set it before the stream starts."""
    spark.conf.set(PROVIDER, ROCKSDB)


def evaluate_rules_stream(
    stream: DataFrame,
    idle_minutes: float = 10,
    cooldown_minutes: float = 15,
    moving_kmh: float = 1.0,
    brake_n: int = 3,
    brake_minutes: float = 10,
    code_n: int = 3,
    code_minutes: float = 60,
    z: float = 4,
    min_kmh: float = 100,
    alpha: float = 0.05,
    warmup: int = 30,
    low_pct: float = 10,
    state_ttl_ms: int | None = None,
) -> DataFrame:
    """Alerts of a stream of deduplicated events. State is kept for good unless a TTL is given."""
    params = {
        "idle_ms": int(idle_minutes * MINUTE),
        "cooldown_ms": int(cooldown_minutes * MINUTE),
        "moving_kmh": moving_kmh,
        "brake_n": brake_n,
        "brake_ms": int(brake_minutes * MINUTE),
        "code_n": code_n,
        "code_ms": int(code_minutes * MINUTE),
        "z": z,
        "min_kmh": min_kmh,
        "alpha": alpha,
        "warmup": warmup,
        "low_pct": low_pct,
    }
    rows = stream.select(
        "vin", F.unix_millis("ts").alias("ts_ms"), "seq", "engine_on", "speed_kmh", "evt", "dtc", "fuel_pct"
    )
    alerts = rows.groupBy("vin").transformWithState(
        RuleProcessor(params, state_ttl_ms), ALERTS, "Append", "None"
    )
    return alerts.withColumn("ts", F.timestamp_millis("ts_ms")).drop("ts_ms")
