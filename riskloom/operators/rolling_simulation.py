"""Monte-Carlo risk at every window end: full path counts, no simulation is ever exchanged.

Draws come from a counter: a 32-bit mixer of (seed, tag, simulation, step).  They
are worked out in blocks, are the same for every window end (so neighbouring
ends differ by their data, not by noise) and can be redrawn in SQL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from riskloom.operators.time_blocks import each_block

#: Tags of the draws.
TAGS = {"iid": 1, "block": 2, "normal_a": 3, "normal_b": 4, "student_a": 5, "student_b": 6, "filtered": 7}
METHODS = ("iid", "block", "normal", "student", "filtered")
#: Window ends of one task at a time: an end is work enough.
ENDS = 128
#: Steps of a path are numbered below this.
STEPS = 64
_M1, _M2 = np.uint32(0x7FEB352D), np.uint32(0x846CA68B)
COLUMNS = "method string, horizon int, confidence_level double, var double, cvar double"


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words (two multiplications, three shifts)."""
    x = x ^ (x >> np.uint32(16))
    x = x * _M1
    x = x ^ (x >> np.uint32(15))
    x = x * _M2
    return x ^ (x >> np.uint32(16))


def draws(seed: int, tag: str, n_sims: int, steps: int) -> np.ndarray:
    """(n_sims x steps) uniforms inside (0, 1); simulation and step are numbered from 1."""
    key = mix32(np.array([seed * 16 + TAGS[tag]], np.uint32))[0]
    count = np.arange(1, n_sims + 1, dtype=np.uint32)[:, None] * np.uint32(STEPS) + np.arange(1, steps + 1, dtype=np.uint32)
    return (mix32(count ^ key) + 0.5) / 4294967296.0


def mix32_sql(x: str) -> str:
    """The same mixer on an unsigned 64-bit expression below 2^32."""
    low = lambda e: f"(({e}) & 4294967295::UBIGINT)"
    step = lambda e, k: f"xor({e}, {e} >> {k})"
    a = low(f"{step(x, 16)} * {int(_M1)}::UBIGINT")
    b = low(f"{step(a, 15)} * {int(_M2)}::UBIGINT")
    return step(b, 16)


def draw_sql(seed: int, tag: str, sim: str = "sim", step: str = "step") -> str:
    key = int(mix32(np.array([seed * 16 + TAGS[tag]], np.uint32))[0])
    return f"(({mix32_sql(f'xor(CAST({sim} * {STEPS} + {step} AS UBIGINT), {key}::UBIGINT)')}) + 5e-1) / 4294967296e0"


def _normals(seed: int, kind: str, n: int, steps: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(draws(seed, f"{kind}_a", n, steps))) * np.cos(2 * math.pi * draws(seed, f"{kind}_b", n, steps))


def _students(seed: int, dof: float, n: int, steps: int) -> np.ndarray:
    t = np.sqrt(dof * (draws(seed, "student_a", n, steps) ** (-2 / dof) - 1)) * np.cos(2 * math.pi * draws(seed, "student_b", n, steps))
    return math.sqrt((dof - 2) / dof) * t


def shared_draws(window: int, n_sims: int, steps: int, seed: int, block: int, dof: float, methods: Sequence[str]) -> dict[str, np.ndarray]:
    """What does not depend on the data: positions in the window, and standardised steps."""
    out = {}
    if "iid" in methods:
        out["iid"] = (draws(seed, "iid", n_sims, steps) * window).astype(np.int64)
    if "block" in methods:
        starts = (draws(seed, "block", n_sims, -(-steps // block)) * (window - block + 1)).astype(np.int64)
        step = np.arange(steps)
        out["block"] = starts[:, step // block] + step % block
    if "filtered" in methods:
        out["filtered"] = (draws(seed, "filtered", n_sims, steps) * window).astype(np.int64)
    if "normal" in methods:
        out["normal"] = _normals(seed, "normal", n_sims, steps)
    if "student" in methods:
        out["student"] = _students(seed, dof, n_sims, steps)
    return out


def tail(loss: np.ndarray, confidence: Sequence[float]) -> list[tuple[float, float]]:
    """Loss at rank floor(c n) and the mean at or beyond it; only the tail is ordered."""
    n = len(loss)
    ranks = [min(int(math.floor(c * n)), n - 1) for c in confidence]
    least = np.partition(loss, min(ranks))[min(ranks)]
    end = np.sort(loss[loss >= least])  # with the losses that equal the least one
    found = []
    for k in ranks:
        var = end[k - n]
        found.append((var, end[np.searchsorted(end, var):].mean()))
    return found


def residuals(windows: np.ndarray, lam: float, floor: float) -> tuple[np.ndarray, ...]:
    """Mean, standardised residuals and next variance of each window under exponential weights."""
    mu = windows.mean(axis=1)
    v = windows[:, 0] ** 2
    z = np.empty(windows.shape)
    for k in range(windows.shape[1]):
        if k:
            v = lam * v + (1 - lam) * windows[:, k - 1] ** 2
        z[:, k] = (windows[:, k] - mu) / (np.sqrt(np.maximum(v, floor)) + 1e-10)
    return mu, z, lam * v + (1 - lam) * windows[:, -1] ** 2


def rolling_monte_carlo(
    rets: DataFrame, window: int, confidence: Sequence[float], horizons: Sequence[int], n_sims: int = 20_000, methods: Sequence[str] = METHODS,
    seed: int = 7, block: int = 5, dof: float = 5.0, lam: float = 0.94, floor: float = 1e-12, ends: int = ENDS,
) -> DataFrame:
    """(asset, date, method, horizon, confidence_level, var, cvar) at every window end, paths of the longest horizon serving all.

    Rows stand only where the loss at the level is positive, and windows without
    variation have none.
    """
    steps = max(horizons)
    if steps >= STEPS or window < block:
        raise ValueError("paths are shorter than 64 steps, and a window holds a block")
    names = [m for m in METHODS if m in methods]

    def compute(windows: np.ndarray) -> dict[str, np.ndarray]:
        shared = shared_draws(window, n_sims, steps, seed, block, dof, names)
        linear = {}  # parametric totals are mu h + sigma Z: the tail of Z serves every end
        for m in names:
            if m in ("normal", "student"):
                linear[m] = {h: tail(-shared[m][:, :h].sum(axis=1), confidence) for h in horizons}
        mean, sd = windows.mean(axis=1), windows.std(axis=1, ddof=1)
        residual = residuals(windows, lam, floor) if "filtered" in names else None
        rows: list[tuple] = []
        for i in np.flatnonzero(sd > 0).tolist():
            for m in names:
                if m in linear:
                    found = {h: [(-mean[i] * h + sd[i] * q, -mean[i] * h + sd[i] * e) for q, e in linear[m][h]] for h in horizons}
                else:
                    if m == "filtered":
                        mu, z, start = residual
                        v, total = np.full(n_sims, start[i]), np.zeros(n_sims)
                        sums = {}
                        for k in range(steps):
                            r = mu[i] + np.sqrt(np.maximum(v, floor)) * z[i, shared[m][:, k]]
                            total = total + r
                            v = lam * v + (1 - lam) * r * r
                            sums[k + 1] = total
                    else:
                        path = windows[i][shared[m]]
                        sums = {h: path[:, :h].sum(axis=1) for h in horizons}
                    found = {h: tail(-sums[h], confidence) for h in horizons}
                for h in horizons:
                    for c, (var, cvar) in zip(confidence, found[h]):
                        if var > 0 and math.isfinite(cvar):
                            rows.append((i, m, h, c, var, cvar))
        cols = list(zip(*rows)) or [()] * 6
        return {
            "end": np.array(cols[0], np.int64), "method": np.array(cols[1], str).astype(object), "horizon": np.array(cols[2], np.int32),
            "confidence_level": np.array(cols[3], float), "var": np.array(cols[4], float), "cvar": np.array(cols[5], float),
        }

    return each_block(rets, window, compute, COLUMNS, ends)
