"""Distribution constants used as literal configuration columns.

A handful of (confidence, degrees of freedom) pairs is evaluated on the driver
and enters the plan as literals, so no per-row special function is needed.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

_STD = NormalDist()


def normal_quantile(p: float) -> float:
    return _STD.inv_cdf(p)


def normal_pdf(x: float) -> float:
    return math.exp(-0.5 * x * x) / math.sqrt(2.0 * math.pi)


def t_pdf(x: float, df: float) -> float:
    log_norm = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return math.exp(log_norm - (df + 1) / 2 * math.log1p(x * x / df))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_upper_tail(x: float, df: float) -> float:
    """P(T > x) for x >= 0."""
    return 0.5 * incomplete_beta(df / 2, 0.5, df / (df + x * x))


@lru_cache(maxsize=None)
def t_quantile(p: float, df: float) -> float:
    """Student-t quantile by bisection on the upper tail."""
    if p == 0.5:
        return 0.0
    tail = min(p, 1 - p)
    lo, hi = 0.0, 1.0
    while t_upper_tail(hi, df) > tail:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        if t_upper_tail(mid, df) > tail:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2 if p > 0.5 else -(lo + hi) / 2


def es_factor_normal(confidence: float) -> float:
    """Expected shortfall of a standard normal loss beyond its VaR."""
    return normal_pdf(normal_quantile(confidence)) / (1 - confidence)


def es_factor_t(confidence: float, df: float) -> float:
    """Expected shortfall of a standard Student-t loss beyond its VaR."""
    q = t_quantile(confidence, df)
    return t_pdf(q, df) / (1 - confidence) * (df + q * q) / (df - 1)


# Chi-square 95 % critical points for one and two degrees of freedom.
CHI2_CRITICAL_1 = 3.841458820694124
CHI2_CRITICAL_2 = 5.991464547107979
TRADING_DAYS = 252
