"""Exponentially weighted mean, variance and z-score per vehicle, computed in parallel slices.

The recurrence is

    d = x - mean;  mean += alpha * d;  var = (1 - alpha) * (var + alpha * d * d)

With the starting mean ``m`` written as ``ref + u``, the state after a slice is linear in ``u`` for the
mean and quadratic in ``u`` for the variance. So a slice of any length shrinks to six numbers:

    mean = decay * u + mean_0,   var = decay * var_start + p - q * u + r * u * u

Slices are summarised in parallel, chained per vehicle (one row per slice), and replayed in
parallel from their true starting state. A slice is a span of event time, so even a vehicle with
most of the rows is spread over as many tasks as it has slices. Rows stream through in Arrow
batches; no slice is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from convoy.functions.plan import join_back

BLOCK = 64
SIDE = "_key string, _slice bigint, "
SUMMARY = SIDE + "n bigint, ref double, decay double, mean_0 double, p double, q double, r double"
START = SIDE + "n0 bigint, mean0 double, var0 double"


class _Blocks:
    """Rows of one batch laid out as short runs, each inside one (key, slice)."""

    def __init__(self, pdf: pd.DataFrame):
        keys, slices = pdf["_key"].to_numpy(), pdf["_slice"].to_numpy()
        size = len(pdf)
        new = np.ones(size, dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (slices[1:] != slices[:-1])
        group_start = np.maximum.accumulate(np.where(new, np.arange(size), 0))
        offset = np.arange(size) - group_start
        self.column = offset % BLOCK
        first = self.column == 0
        self.row = np.cumsum(first) - 1
        self.start = np.flatnonzero(first)
        self.new = new[self.start]
        self.length = np.diff(np.append(self.start, size))
        self.keys, self.slices = keys[self.start], slices[self.start]
        self.x = np.zeros((len(self.start), BLOCK))
        self.x[self.row, self.column] = pdf["x"].to_numpy(dtype=float)

    def live(self, j: int) -> np.ndarray:
        return np.flatnonzero(self.length > j)

    def steps(self) -> range:
        return range(int(self.length.max()))

    def summaries(self, ref: np.ndarray, alpha: float) -> np.ndarray:
        """Per run: decay, mean offset from ref, p, q, r (columns)."""
        keep = 1 - alpha
        out = np.zeros((len(ref), 5))
        out[:, 0] = 1.0
        for j in self.steps():
            i = self.live(j)
            decay, offset, p, q, r = out[i].T
            c = self.x[i, j] - ref[i] - offset
            out[i] = np.column_stack(
                [
                    decay * keep,
                    offset + alpha * c,
                    keep * (p + alpha * c * c),
                    keep * (q + 2 * alpha * c * decay),
                    keep * (r + alpha * decay * decay),
                ]
            )
        return out


def _refs(blocks: _Blocks, carried: float | None) -> np.ndarray:
    """Each run's reference value: the first value of its (key, slice)."""
    refs = np.empty(len(blocks.start))
    ref = carried
    for b in range(len(refs)):
        if blocks.new[b] or ref is None:
            ref = blocks.x[b, 0]
        refs[b] = ref
    return refs


def _summarise(alpha: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None  # [key, slice, n, ref, decay, mean offset, p, q, r] of the open slice
        for pdf in batches:
            if not len(pdf):
                continue
            blocks = _Blocks(pdf)
            if state is not None:
                blocks.new[0] = (state[0], state[1]) != (blocks.keys[0], blocks.slices[0])
            refs = _refs(blocks, None if state is None else state[3])
            parts = blocks.summaries(refs, alpha)
            done = []
            for b, (decay, offset, p, q, r) in enumerate(parts):
                if blocks.new[b]:
                    if state is not None:
                        done.append(_closed(state))
                    state = [blocks.keys[b], blocks.slices[b], 0, refs[b], 1.0, 0.0, 0.0, 0.0, 0.0]
                # run's function applied to the open slice's function of u
                _, _, n, _, a0, k, p0, q0, r0 = state
                state[2] = n + int(blocks.length[b])
                state[4] = decay * a0
                state[5] = decay * k + offset
                state[6] = decay * p0 + p - q * k + r * k * k
                state[7] = decay * q0 + q * a0 - 2 * r * a0 * k
                state[8] = decay * r0 + r * a0 * a0
            if done:
                yield pd.DataFrame(done, columns=_names(SUMMARY))
        if state is not None:
            yield pd.DataFrame([_closed(state)], columns=_names(SUMMARY))

    return run


def _closed(state: list) -> list:
    key, part, n, ref, decay, offset, p, q, r = state
    return [key, part, n, ref, decay, ref + offset, p, q, r]


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Starting state of every slice, from the summaries in (key, slice) order."""
    key = None
    for pdf in batches:
        rows = []
        for row in pdf.itertuples(index=False, name=None):
            this, part, n, ref, decay, mean_0, p, q, r = row
            if this != key:
                key, count, mean, var = this, 0, ref, 0.0
            rows.append((this, part, count, mean, var))
            u = mean - ref
            mean, var = decay * u + mean_0, max(0.0, decay * var + p - q * u + r * u * u)
            count += n
        yield pd.DataFrame(rows, columns=_names(START))


def _replay(alpha: float, warmup: int, columns: list[str]):
    keep = 1 - alpha

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = ref = state = None  # slice, its reference and (n, mean, var) after the rows so far
        for pdf in batches:
            if not len(pdf):
                continue
            blocks = _Blocks(pdf)
            blocks.new[0] = here != (blocks.keys[0], blocks.slices[0])
            refs = _refs(blocks, ref)
            n, mean, var = (
                pdf[c].to_numpy(dtype=float)[blocks.start] for c in ("n0", "mean0", "var0")
            )
            for b, (decay, offset, p, q, r) in enumerate(blocks.summaries(refs, alpha)):
                if not blocks.new[b]:
                    n[b], mean[b], var[b] = state
                u = mean[b] - refs[b]
                state = (
                    n[b] + blocks.length[b],
                    decay * u + refs[b] + offset,
                    max(0.0, decay * var[b] + p - q * u + r * u * u),
                )
            here, ref = (blocks.keys[-1], blocks.slices[-1]), refs[-1]
            z = np.zeros_like(blocks.x)
            for j in blocks.steps():
                i = blocks.live(j)
                sd = np.sqrt(var[i])
                d = blocks.x[i, j] - mean[i]
                ready = (n[i] >= warmup) & (sd > 1e-9)
                z[i, j] = np.where(ready, d / np.where(ready, sd, 1.0), 0.0)
                mean[i] += alpha * d
                var[i] = keep * (var[i] + alpha * d * d)
                n[i] += 1
            out = pdf[columns].copy()
            out["z"] = z[blocks.row, blocks.column]
            yield out

    return run


def ewma_z(
    df: DataFrame,
    value: str = "speed_kmh",
    key: str = "vin",
    alpha: float = 0.05,
    warmup: int = 30,
    slice_ms: int = 300_000,
) -> DataFrame:
    """(key, ts, seq, value, z): each sample against the state before it, in (ts, seq) order.

    z is 0 until ``warmup`` samples were seen or while the deviation is at most 1e-9.
    """
    part = F.floor(F.unix_millis("ts") / F.lit(slice_ms))
    rows = df.select(
        F.col(key).cast("string").alias("_key"),
        part.alias("_slice"),
        "ts",
        "seq",
        F.col(value).cast("double").alias("x"),
    ).repartition("_key", "_slice")  # one shuffle serves the summaries and the replay
    order = ["_key", "_slice", "ts", "seq"]
    starts = (
        rows.sortWithinPartitions(*order)
        .mapInPandas(_summarise(alpha), SUMMARY)
        .repartition("_key")
        .sortWithinPartitions("_key", "_slice")
        .mapInPandas(_chain, START)
    )
    types = dict(df.dtypes)
    kept = ["_key", "ts", "seq", "x"]
    schema = f"_key string, ts timestamp, seq {types['seq']}, x double, z double"
    return (
        join_back(rows, starts, ["_key", "_slice"])
        .sortWithinPartitions(*order)
        .mapInPandas(_replay(alpha, warmup, kept), schema)
        .select(
            F.col("_key").cast(types[key]).alias(key),
            "ts",
            "seq",
            F.col("x").cast(types[value]).alias(value),
            "z",
        )
    )
