"""Cooldown of repeated hits per vehicle and rule, computed in parallel slices.

A hit is emitted iff its time is at least the cooldown after the last emission. Within a slice of
event time the outcome depends on the earlier slices only through that last emission, as a step
function: entry time -> last emission inside the slice. Slices yield their steps in parallel, the
steps are chained per (vehicle, rule), and each slice is walked from its true entry.

Hits at the same millisecond collapse first, so a slice holds at most one row per millisecond,
however many hits there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from convoy.functions.plan import join_back

SLICE = "_key string, _slice bigint"
STEPS = SLICE + ", upto bigint, exit bigint"
START = SLICE + ", last bigint"
NEVER = -(2**62)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple | None]:
    """(key, slice, sorted times, last) of every slice of a partition sorted by (key, slice, t).

    A slice may span batches; it is handed on once it is complete. None marks the end of a batch.
    """
    name = None
    for pdf in batches:
        if not len(pdf):
            continue
        keys, slots, times = (pdf[c].to_numpy() for c in ("_key", "_slice", "t"))
        last = pdf["last"].to_numpy() if "last" in pdf.columns else np.full(len(pdf), NEVER)
        change = (keys[1:] != keys[:-1]) | (slots[1:] != slots[:-1])
        edges = [0, *(np.flatnonzero(change) + 1), len(pdf)]
        for a, b in zip(edges[:-1], edges[1:]):
            if name != (keys[a], slots[a]):
                if name is not None:
                    yield *name, np.concatenate(held), held_last
                name, held, held_last = (keys[a], slots[a]), [], int(last[a])
            held.append(times[a:b])
        yield None
    if name is not None:
        yield *name, np.concatenate(held), held_last
        yield None


def _slice_steps(slot: int, times: np.ndarray, cooldown: int, width: int):
    """(latest entry time, last emission) of each step of one slice."""
    following = np.searchsorted(times, times + cooldown)
    exit_at = np.arange(len(times))  # the last emission reached from each hit
    while True:
        nxt = following[exit_at]
        ahead = nxt < len(times)
        if not ahead.any():
            break
        exit_at = np.where(ahead, nxt, exit_at)
    # emissions before this slice leave entries at most a cooldown into it
    entries = np.searchsorted(times, slot * width + cooldown) + 1
    reach, final = times[:entries], times[exit_at][:entries]
    change = np.append(final[1:] != final[:-1], True)
    return reach[change], final[change]


def _steps(cooldown: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, slots, reach, final = [], [], [], []
        for item in _slices(batches):
            if item is not None:
                key, slot, times, _ = item
                upto, last = _slice_steps(slot, times, cooldown, width)
                keys += [key] * len(upto)
                slots += [slot] * len(upto)
                reach.append(upto)
                final.append(last)
            elif keys:
                yield pd.DataFrame(
                    {"_key": keys, "_slice": slots, "upto": np.concatenate(reach), "exit": np.concatenate(final)}
                )
                keys, slots, reach, final = [], [], [], []

    return run


def _chain(cooldown: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = part = None
        for pdf in batches:
            rows = []
            for this, slot, upto, final in pdf.itertuples(index=False, name=None):
                if this != key:
                    key, part, last = this, None, NEVER
                if slot != part:
                    part, entry, open_ = slot, last + cooldown, True
                    rows.append((this, slot, last))
                if open_ and entry <= upto:
                    last, open_ = final, False
            yield pd.DataFrame(rows, columns=["_key", "_slice", "last"])

    return run


def _walk(cooldown: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = []
        for item in _slices(batches):
            if item is not None:
                key, _, times, last = item
                at = int(np.searchsorted(times, last + cooldown))
                while at < len(times):
                    kept.append((key, int(times[at])))
                    at = int(np.searchsorted(times, times[at] + cooldown))
            else:
                yield pd.DataFrame(kept, columns=["_key", "_t"])
                kept = []

    return run


def apply_cooldown(
    hits: DataFrame,
    minutes: float = 15,
    keys: tuple[str, ...] = ("vin", "code"),
    time_col: str = "ts",
    ties: tuple[str, ...] = ("seq", "pos"),
) -> DataFrame:
    """The hits that survive the cooldown, greedily in order of time, then of ``ties``."""
    cooldown = int(minutes * 60000)
    if cooldown <= 0:
        return hits
    width = 4 * cooldown
    rest = [c for c in hits.columns if c not in keys]
    tie = [c for c in ties if c in rest]
    first = (
        hits.withColumn("_t", F.unix_millis(time_col))
        .groupBy(*keys, "_t")
        .agg(F.min_by(F.struct(*rest), F.struct(*tie)).alias("_hit"))
        .withColumn("_key", F.to_json(F.array(*[F.col(k).cast("string") for k in keys])))
    )
    times = first.select(
        "_key", F.floor(F.col("_t") / F.lit(width)).alias("_slice"), F.col("_t").alias("t")
    )
    groups = ["_key", "_slice"]
    times = times.repartition(*groups)
    starts = (
        times.sortWithinPartitions(*groups, "t")
        .mapInPandas(_steps(cooldown, width), STEPS)
        .repartition("_key")
        .sortWithinPartitions("_key", "_slice", "upto")
        .mapInPandas(_chain(cooldown), START)
    )
    kept = (
        join_back(times, starts, groups)
        .sortWithinPartitions(*groups, "t")
        .mapInPandas(_walk(cooldown), "_key string, _t bigint")
    )
    return first.join(kept, ["_key", "_t"], "left_semi").select(*keys, "_hit.*").select(
        *hits.columns
    )
