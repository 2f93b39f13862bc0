"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chebyshev fit of the complementary error function
# (relative error below 1.2e-7 everywhere).
ERFC_COEFFICIENTS = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    poly = reduce(lambda acc, c: F.lit(c) + t * acc, reversed(ERFC_COEFFICIENTS[:-1]), F.lit(ERFC_COEFFICIENTS[-1]))
    tail = t * F.exp(-z * z + poly)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / (2.0 ** 0.5))


def chi2_sf(x: Column, df: int) -> Column:
    """Upper-tail chi-square probability for one or two degrees of freedom."""
    positive = F.greatest(x, F.lit(0.0))
    if df == 2:
        return F.when(x.isNotNull(), F.exp(-positive / 2.0))
    if df == 1:
        return F.when(x.isNotNull(), F.least(F.lit(1.0), erfc(F.sqrt(positive / 2.0))))
    raise ValueError("df must be 1 or 2")


def horizon_scale(h: Column, rule: str = "sqrt_time") -> Column:
    """sqrt(h) for square-root-of-time scaling, h for linear scaling."""
    if rule == "sqrt_time":
        return F.sqrt(h.cast("double"))
    if rule == "linear":
        return h.cast("double")
    raise ValueError(f"unknown scaling rule {rule!r}")


def uniform_draw(*keys: Column | str | int) -> Column:
    """Reproducible uniform draw in (0, 1) from the given keys.

    A digest of the keys, not ``rand()``: retries and repartitioning give the
    same draw, and any SQL engine with md5 can recompute it.
    """
    parts = [F.lit(str(k)) if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k) for k in keys]
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    word = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return (word + 0.5) / 4294967296.0


def literal_rows(rows: Sequence[dict]) -> Column:
    """Array of structs from a short list of literal records."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])


def fan_out(df, cfg: Column):
    """Explode a literal parameter array and flatten its fields."""
    return df.withColumn("__cfg", F.explode(cfg)).select(*df.columns, "__cfg.*")


# --- statistics of an array<double> column -------------------------------------------------


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_mean(a: Column) -> Column:
    return ratio(array_sum(a), F.size(a).cast("double"))


def array_quantile(sorted_a: Column, q: Column | float) -> Column:
    """Linear-interpolated quantile of an ascending array (numpy/pandas default)."""
    q = F.lit(q) if isinstance(q, float) else q
    pos = q * (F.size(sorted_a) - 1)
    lo = F.floor(pos)
    a, b = F.get(sorted_a, lo.cast("int")), F.get(sorted_a, F.ceil(pos).cast("int"))
    return a + (b - a) * (pos - lo)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def max_drawdown(returns: Column) -> Column:
    """Largest peak-to-trough loss (positive) of compounded simple returns."""
    start = F.struct(F.lit(1.0).alias("c"), F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("d"))

    def step(s: Column, r: Column) -> Column:
        c = s["c"] * (1.0 + r)
        m = F.greatest(s["m"], c)
        return F.struct(c.alias("c"), m.alias("m"), F.least(s["d"], (c - m) / m).alias("d"))

    return F.aggregate(returns, start, step, lambda s: F.abs(s["d"]))
