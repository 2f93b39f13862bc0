"""Tail, volatility and Student-t fits of every window end, over time blocks.

Same results as the row-wise fits in ``evt`` and ``volatility``, but a window is
neither copied per end nor per grid point: a task holds a block of ends, orders
its windows at once and moves all grid points through the window in one fold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from riskloom.operators.evt import FALLBACK_QUANTILES, MIN_BETA, XI_BOUNDS
from riskloom.operators.time_blocks import each_block
from riskloom.operators.volatility import garch_grid

TAIL = "r double, n int, estimation_window int, threshold_quantile double, threshold double, num_exceedances int, xi double, beta double"
GARCH = (
    "r double, omega double, alpha double, beta double, persistence double, unconditional_variance double, sigma_last double, sigma double, log_likelihood double"
)
STUDENT = "r double, dof double, mu double, scale double, log_likelihood double"


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(np.broadcast(a, b).shape, np.nan), where=b != 0)


def sorted_quantile(s: np.ndarray, q: float) -> np.ndarray:
    """Linear quantile of each ascending row."""
    at = q * (s.shape[1] - 1)
    low = math.floor(at)
    high = min(low + 1, s.shape[1] - 1)
    return s[:, low] + (s[:, high] - s[:, low]) * (at - low)


def tail_fit(s: np.ndarray, q: float, min_exceedances: int, mode: str) -> dict[str, np.ndarray]:
    """Threshold and generalised Pareto fit of rows of ascending losses."""
    rows = len(s)
    u, n = np.zeros(rows), np.full(rows, -1)
    for level in (q, *FALLBACK_QUANTILES):  # the first level with enough exceedances, else the last
        open_ = (n < 0) | (n < min_exceedances)
        t = sorted_quantile(s, level)
        count = (s > t[:, None]).sum(axis=1)
        u, n = np.where(open_, t, u), np.where(open_, count, n)
    width = s.shape[1]
    above = np.arange(width)[None, :] >= (width - n)[:, None]
    x = np.where(above, s - u[:, None], 0.0)
    rank = np.arange(width)[None, :] - (width - n)[:, None]
    m0 = _divide(x.sum(axis=1), n.astype(float))
    weight = _divide((n[:, None] - 1.0 - rank), (n - 1.0)[:, None])
    m1 = _divide(np.where(above, x * weight, 0.0).sum(axis=1), n.astype(float))
    xv = _divide((np.where(above, x - m0[:, None], 0.0) ** 2).sum(axis=1), n.astype(float))
    with np.errstate(invalid="ignore"):
        if mode == "textbook":
            below, xi, beta = m0 - 2 * m1, 2 - _divide(m0, m0 - 2 * m1), _divide(2 * m0 * m1, m0 - 2 * m1)
        else:
            below, xi, beta = m0 - m1, _divide(3 * m1 - m0, m0 - m1), _divide(m0 * m1, m0 - m1)
        simple = (n < 3) | (np.abs(below) < 1e-10)
        usable = (xv > 0) & (m0 > 0)
        ratio = _divide(m0 * m0, xv)
        xi = np.where(simple, np.where(usable, 0.5 * (1 - ratio), 0.0), xi)
        beta = np.where(simple, np.where(usable, 0.5 * m0 * (1 + ratio), np.maximum(m0, MIN_BETA)), beta)
    return {"threshold": u, "num_exceedances": n, "xi": np.where(n > 0, np.clip(xi, *XI_BOUNDS), np.nan), "beta": np.where(n > 0, np.maximum(beta, MIN_BETA), np.nan)}


def pot_parameters(rets: DataFrame, window: int, quantiles: Sequence[float], min_exceedances: int, mode: str = "textbook") -> DataFrame:
    """As ``evt.pot_parameters`` at step 1: one row per window end and threshold quantile."""

    def compute(windows: np.ndarray) -> dict[str, np.ndarray]:
        s = np.sort(-windows, axis=1)
        parts = [tail_fit(s, q, min_exceedances, mode) for q in quantiles]
        k, m = len(s), len(parts)
        out = {c: np.concatenate([p[c] for p in parts]) for c in ("threshold", "num_exceedances", "xi", "beta")}
        undefined = out["num_exceedances"] == 0
        for c in ("xi", "beta"):
            out[c] = np.ma.array(out[c], mask=undefined)
        return out | {
            "end": np.tile(np.arange(k), m), "r": np.tile(windows[:, -1], m), "n": np.full(k * m, window), "estimation_window": np.full(k * m, window),
            "threshold_quantile": np.repeat(np.array(quantiles, float), k),
        }

    return each_block(rets, window, compute, TAIL)


def garch_forecasts(rets: DataFrame, window: int, grid: Sequence[dict] | None = None) -> DataFrame:
    """As ``volatility.garch_forecasts`` at step 1 and lag 1: the window ends the day before."""
    points = sorted(((g["alpha"], g["beta"]) for g in grid or garch_grid()))
    alpha, beta = (np.array(x)[None, :] for x in zip(*points))

    def compute(rows: np.ndarray) -> dict[str, np.ndarray]:
        w = rows[:, :-1]
        e2 = (w - w.mean(axis=1)[:, None]) ** 2
        target = e2.mean(axis=1)
        ok = target > 0
        omega = target[:, None] * (1 - alpha - beta)
        v = np.repeat(np.where(ok, target, 1.0)[:, None], alpha.shape[1], axis=1)
        likelihood, last = np.zeros(v.shape), v
        for t in range(window):
            last = v
            likelihood -= 0.5 * (np.log(v) + e2[:, t:t + 1] / v)
            v = omega + alpha * e2[:, t:t + 1] + beta * v
        best = likelihood.argmax(axis=1)  # of equals the least alpha, then beta
        i = np.arange(len(w))
        masked = lambda x: np.ma.array(x, mask=~ok)
        a, b = alpha[0, best], beta[0, best]
        return {
            "r": rows[:, -1], "omega": omega[i, best], "alpha": a, "beta": b, "persistence": a + b, "unconditional_variance": target,
            "sigma_last": masked(np.sqrt(last[i, best])), "sigma": np.where(ok, np.sqrt(v[i, best]), np.sqrt(target)), "log_likelihood": masked(likelihood[i, best]),
        }

    return each_block(rets, window + 1, compute, GARCH)


def student_dof(rets: DataFrame, window: int, dofs: Sequence[float] = (2.1, 3, 4, 5, 6, 8, 10, 15, 20, 30, 50)) -> DataFrame:
    """As ``volatility.student_dof`` at step 1; windows without variation have no row."""

    def compute(w: np.ndarray) -> dict[str, np.ndarray]:
        mu, sd = w.mean(axis=1), w.std(axis=1, ddof=1)
        keep = np.flatnonzero(sd > 0)
        w, mu, sd = w[keep], mu[keep], sd[keep]
        best = np.full(len(keep), -np.inf)
        dof, scale = np.zeros(len(keep)), np.zeros(len(keep))
        for v in sorted(map(float, dofs)):
            own = sd * math.sqrt((v - 2) / v)
            z = (w - mu[:, None]) / own[:, None]
            norm = math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi)
            ll = -(v + 1) / 2 * np.log1p(z * z / v).sum(axis=1) + w.shape[1] * (norm - np.log(own))
            better = ll > best
            best, dof, scale = np.where(better, ll, best), np.where(better, v, dof), np.where(better, own, scale)
        return {"end": keep, "r": w[:, -1] if len(w) else np.zeros(0), "dof": dof, "mu": mu, "scale": scale, "log_likelihood": best}

    return each_block(rets, window, compute, STUDENT)
