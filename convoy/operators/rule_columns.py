"""The rules on a vehicle's rows as arrays in (ts, seq) order, with what earlier rows left open."""

from __future__ import annotations

import numpy as np
import pandas as pd

MINUTE = 60_000
#: Below so many samples a plain loop is faster than setting up pandas' moving average.
SHORT = 256


def long_idlings(t: np.ndarray, still: np.ndarray, since: int | None, told: bool, wait: int):
    """Rows at which an idling has lasted ``wait``, one per idling, the minutes so far, and the open idling.

    ``since`` is when an idling that was open before these rows began, ``told`` whether it was reported.
    """
    fresh = still & ~np.concatenate([[since is not None], still[:-1]])
    run = np.cumsum(fresh)  # 0: the one that was open
    begun = np.concatenate([[t[0] if since is None else since], t[fresh]])[run]
    due = np.flatnonzero(still & ~fresh & (t - begun >= wait) & ~((run == 0) & told))
    # an idling ends with the first row that is not still
    ended = np.cumsum(~still)
    _, first = np.unique(np.stack([run[due], ended[due]]), axis=1, return_index=True) if len(due) else (None, due)
    hits = np.sort(due[first])
    minutes = np.floor((t[hits] - begun[hits]) / MINUTE + 0.5).astype(np.int64)
    if not still[-1]:
        return hits, minutes, None, False
    told_now = bool((ended[hits] == ended[-1]).any() or (told and run[-1] == 0 and not ended[-1]))
    return hits, minutes, int(begun[-1]), told_now


def window_counts(past: np.ndarray, t: np.ndarray, window: int) -> np.ndarray:
    """For each of the times ``t`` (ascending): how many of ``past`` and of ``t`` up to it are later than t - window."""
    edge = t - window
    return len(past) - np.searchsorted(past, edge, "right") + np.arange(1, len(t) + 1) - np.searchsorted(t, edge, "right")


def _smoothed(value: float, samples: list[float], alpha: float) -> list[float]:
    """pandas' ``ewm(alpha, adjust=False).mean()`` over ``value`` and the samples, step by step as it computes it."""
    new = 1.0 / (1.0 + (1.0 - alpha) / alpha)
    old = 1.0 - new
    whole = old + new
    out = [value]
    for x in samples:
        if value != x:
            value = (old * value + new * x) / whole
        out.append(value)
    return out


def deviations(x: np.ndarray, n: int, mean: float, var: float, alpha: float, warmup: int):
    """Each sample's deviation from the moving average before it, and the average after all of them."""
    lead = np.zeros(0)
    if not n:
        n, mean, var, x, lead = 1, float(x[0]), 0.0, x[1:], np.zeros(1)

    def smoothed(start: float, values: np.ndarray) -> np.ndarray:
        if len(values) < SHORT and not np.isnan(values).any():
            return np.array(_smoothed(float(start), values.tolist(), alpha))
        return pd.Series(np.append(start, values)).ewm(alpha=alpha, adjust=False).mean().to_numpy()

    means = smoothed(mean, x)
    off = x - means[:-1]
    variances = smoothed(var, (1 - alpha) * off * off)
    spread = np.sqrt(variances[:-1])
    ready = (n + np.arange(len(x)) >= warmup) & (spread > 1e-9)
    z = np.divide(off, spread, out=np.zeros(len(x)), where=ready)
    return np.append(lead, z), n + len(x), float(means[-1]), float(variances[-1])


def spaced(t: np.ndarray, last: int | None, gap: int) -> list[int]:
    """Of ascending times those that are reported: each at least ``gap`` after the one reported before."""
    out, at = [], 0
    while True:
        if last is not None:
            at = max(at, int(np.searchsorted(t, last + gap)))
        if at >= len(t):
            return out
        out.append(at)
        last, at = int(t[at]), at + 1
