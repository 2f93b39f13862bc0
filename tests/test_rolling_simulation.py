"""Monte-Carlo at every window end, against plain loops."""

import datetime as dt
import math

import numpy as np
import pytest

from riskloom.operators import rolling_simulation as mc
from riskloom.operators.time_blocks import each_block


def mix(x):
    x ^= x >> 16
    x = x * 0x7FEB352D % 2**32
    x ^= x >> 15
    x = x * 0x846CA68B % 2**32
    return x ^ x >> 16


def u(seed, tag, sim, step):
    return (mix((sim * 64 + step) ^ mix(seed * 16 + mc.TAGS[tag])) + 0.5) / 2**32


def path(method, w, sim, steps, seed, block, dof, lam=0.94):
    n, mu = len(w), sum(w) / len(w)
    sd = math.sqrt(sum((x - mu) ** 2 for x in w) / (n - 1))
    if method == "iid":
        return [w[int(u(seed, "iid", sim, k) * n)] for k in range(1, steps + 1)]
    if method == "block":
        return [w[int(u(seed, "block", sim, (k - 1) // block + 1) * (n - block + 1)) + (k - 1) % block] for k in range(1, steps + 1)]
    if method in ("normal", "student"):
        out = []
        for k in range(1, steps + 1):
            a, b = u(seed, f"{method}_a", sim, k), u(seed, f"{method}_b", sim, k)
            radius = math.sqrt(-2 * math.log(a)) if method == "normal" else math.sqrt((dof - 2) / dof) * math.sqrt(dof * (a ** (-2 / dof) - 1))
            out.append(mu + sd * radius * math.cos(2 * math.pi * b))
        return out
    v = [w[0] ** 2]
    for x in w[:-1]:
        v.append(lam * v[-1] + (1 - lam) * x * x)
    z = [(x - mu) / (math.sqrt(max(s, 1e-12)) + 1e-10) for x, s in zip(w, v)]
    now, out = lam * v[-1] + (1 - lam) * w[-1] ** 2, []
    for k in range(1, steps + 1):
        r = mu + math.sqrt(max(now, 1e-12)) * z[int(u(seed, "filtered", sim, k) * n)]
        now = lam * now + (1 - lam) * r * r
        out.append(r)
    return out


@pytest.mark.parametrize("ends", [512, 7])
def test_every_end_and_method_equals_loops(spark, panel, ends):
    df, m = panel
    window, sims, conf, hor = 20, 40, [0.9, 0.95], [1, 3]
    got = {(r.asset, r.date, r.method, r.horizon, r.confidence_level): (r["var"], r.cvar) for r in mc.rolling_monte_carlo(df, window, conf, hor, sims, seed=3, block=4, ends=ends).collect()}
    want = {}
    start = dt.date(2020, 1, 1)
    for a in range(2):
        for e in range(window - 1, 60):
            w = m[e - window + 1:e + 1, a].tolist()
            for method in mc.METHODS:
                paths = [path(method, w, s, 3, 3, 4, 5.0) for s in range(1, sims + 1)]
                for h in hor:
                    loss = sorted(-sum(p[:h]) for p in paths)
                    for c in conf:
                        var = loss[math.floor(c * sims)]
                        tail = [x for x in loss if x >= var]
                        if var > 0:
                            want[f"X{a}", start + dt.timedelta(days=7 * e), method, h, c] = (var, sum(tail) / len(tail))
    mine = {k: v for k, v in got.items() if k[0] in ("X0", "X1")}
    assert mine.keys() == want.keys() and len(got) > len(mine)
    assert all(np.allclose(mine[k], want[k], atol=1e-12) for k in want)


def test_blocks_see_every_whole_window_once(spark, panel):
    df, m = panel
    for block in (1, 5, 64):
        rows = each_block(df, 13, lambda w: {"total": w.sum(axis=1)}, "total double", block).collect()
        got = {(r.asset, r.date): r.total for r in rows}
        assert len(rows) == len(got) == 4 * 48
        assert all(abs(got[f"X{a}", dt.date(2020, 1, 1) + dt.timedelta(days=7 * e)] - m[e - 12:e + 1, a].sum()) < 1e-12 for a in range(4) for e in range(12, 60))


def test_short_constant_and_missing_series(spark):
    days = [dt.date(2021, 1, 1) + dt.timedelta(days=i) for i in range(12)]
    rows = [("short", d, 0.1) for d in days[:5]] + [("flat", d, 0.0) for d in days] + [("gap", d, None if i == 3 else (-1) ** i * 0.01 * i) for i, d in enumerate(days)]
    out = mc.rolling_monte_carlo(spark.createDataFrame(rows, "asset string, date date, r double"), 8, [0.9], [1], 50, seed=1)
    found = out.select("asset", "date").distinct().collect()
    assert {r.asset for r in found} == {"gap"} and len(found) == 4
    assert mc.rolling_monte_carlo(spark.createDataFrame([], "asset string, date date, r double"), 8, [0.9], [1], 50).count() == 0
