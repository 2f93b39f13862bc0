"""Peaks-over-threshold tail models per rolling window.

Each window is one row holding its losses (bounded by the window length), so the
threshold, the exceedances and the fit are expressions on that row: a window's
members are never exploded or re-joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import array_mean, array_quantile, fan_out, horizon_scale, literal_rows, ratio
from riskloom.operators.rolling import window_arrays

# Quantiles tried in turn when a threshold leaves too few exceedances.
FALLBACK_QUANTILES = [0.90, 0.85, 0.80, 0.75, 0.70]
XI_BOUNDS = (-0.5, 0.5)
MIN_BETA = 0.001


def with_threshold(windows: DataFrame, quantiles: Sequence[float], min_exceedances: int, fallback: Sequence[float] = FALLBACK_QUANTILES) -> DataFrame:
    """Adds the loss threshold and its exceedance count for each requested quantile.

    The first quantile leaving at least ``min_exceedances`` losses above it wins;
    if none does, the last one tried is kept.
    """
    out = windows.withColumn("s", F.sort_array("losses"))
    out = fan_out(out, literal_rows([{"threshold_quantile": float(q)} for q in quantiles]))
    tried = F.concat(F.array(F.col("threshold_quantile")), F.array(*[F.lit(float(q)) for q in fallback]))
    out = out.withColumn("tried", F.transform(tried, lambda q: array_quantile(F.col("s"), q)))
    counted = F.transform("tried", lambda u: F.struct(u.alias("u"), F.size(F.filter("s", lambda x: x > u)).alias("n")))
    out = out.withColumn("tried", counted)
    good = F.filter("tried", lambda t: t["n"] >= min_exceedances)
    out = out.withColumn("pick", F.coalesce(F.get(good, F.lit(0)), F.element_at("tried", -1)))
    return out.withColumn("threshold", F.col("pick.u")).withColumn("num_exceedances", F.col("pick.n")).drop("tried", "pick")


def exceedances(sorted_losses: Column, threshold: Column) -> Column:
    """Losses above the threshold, less the threshold, ascending."""
    return F.transform(F.filter(sorted_losses, lambda x: x > threshold), lambda x: x - threshold)


def gpd_fit(df: DataFrame, mode: str = "textbook") -> DataFrame:
    """Shape and scale by probability-weighted moments of the exceedances.

    ``textbook`` uses xi = 2 - m0/(m0 - 2 m1), beta = 2 m0 m1/(m0 - 2 m1);
    ``reference`` uses xi = (3 m1 - m0)/(m0 - m1), beta = m0 m1/(m0 - m1).
    Fewer than three exceedances, or equal moments, fall back to mean and variance.
    """
    x = df.withColumn("x", exceedances(F.col("s"), F.col("threshold")))
    n = F.size("x")
    # Weight of the k-th smallest of n is (n - 1 - k) / (n - 1).
    weighted = F.transform("x", lambda v, k: v * ratio((n - 1 - k).cast("double"), (n - 1).cast("double")))
    x = x.withColumn("m0", array_mean(F.col("x"))).withColumn("m1", array_mean(weighted))
    m0, m1 = F.col("m0"), F.col("m1")
    x = x.withColumn("xv", ratio(F.aggregate("x", F.lit(0.0), lambda s, v: s + (v - m0) * (v - m0)), n.cast("double")))
    if mode == "textbook":
        xi, beta = 2 - ratio(m0, m0 - 2 * m1), ratio(2 * m0 * m1, m0 - 2 * m1)
        degenerate = F.abs(m0 - 2 * m1) < 1e-10
    else:
        xi, beta = ratio(3 * m1 - m0, m0 - m1), ratio(m0 * m1, m0 - m1)
        degenerate = F.abs(m0 - m1) < 1e-10
    v = F.col("xv")
    moments_ok = (v > 0) & (m0 > 0)
    xi_m = F.when(moments_ok, 0.5 * (1 - m0 * m0 / v)).otherwise(0.0)
    beta_m = F.when(moments_ok, 0.5 * m0 * (1 + m0 * m0 / v)).otherwise(F.greatest(m0, F.lit(MIN_BETA)))
    simple = (n < 3) | degenerate
    lo, hi = XI_BOUNDS
    fitted_xi = F.greatest(F.lit(lo), F.least(F.lit(hi), F.when(simple, xi_m).otherwise(xi)))
    fitted_beta = F.greatest(F.lit(MIN_BETA), F.when(simple, beta_m).otherwise(beta))
    return x.withColumn("xi", F.when(n > 0, fitted_xi)).withColumn("beta", F.when(n > 0, fitted_beta)).drop("x", "m0", "m1", "xv", "s", "losses")


def evt_var_cvar(params: DataFrame, grid: Column) -> DataFrame:
    """Tail VaR (at least 0.1 % above the threshold) and expected shortfall, scaled to the horizon.

    NULL where a value is not defined: a tail emptier than the level, or xi >= 1.
    """
    out = fan_out(params, grid)
    u, xi, beta = F.col("threshold"), F.col("xi"), F.col("beta")
    p = ratio(1 - F.col("confidence_level"), F.col("num_exceedances") / F.col("n"))
    flat = F.abs(xi) < 1e-8
    raw = F.when(flat, u - beta * F.log(p)).otherwise(u + beta / xi * (F.pow(p, -xi) - 1))
    v1 = F.greatest(raw, u * 1.001)
    scale = horizon_scale(F.col("horizon"))
    out = out.withColumn("v1", F.when(F.col("num_exceedances") > 0, v1))
    out = out.withColumn("v1", F.when(F.col("v1") > u, F.col("v1")))
    es = F.col("v1") + F.when(flat, beta).otherwise((beta + xi * (F.col("v1") - u)) / (1 - xi))
    return out.withColumn("var", F.col("v1") * scale).withColumn("cvar", F.when(xi < 1, es) * scale).drop("v1")


def pot_parameters(
    rets: DataFrame, window: int, quantiles: Sequence[float], min_exceedances: int, step: int = 1, mode: str = "textbook", latest_only: bool = False
) -> DataFrame:
    """Threshold, exceedance count and fitted tail of every window end (or the last one per asset)."""
    losses = rets.withColumn("loss", -F.col("r"))
    w = window_arrays(losses, window, step, value="loss").withColumnsRenamed({"w": "losses"})
    w = w.select("asset", "date", (-F.col("current")).alias("r"), "losses", F.size("losses").alias("n"), F.lit(window).alias("estimation_window"))
    if latest_only:
        last = F.max_by(F.struct("date", "r", "losses", "n", "estimation_window"), "date")
        w = w.groupBy("asset").agg(last.alias("k")).select("asset", "k.*")
    return gpd_fit(with_threshold(w, quantiles, min_exceedances), mode)


def evt_series(rets: DataFrame, window: int, quantiles: Sequence[float], min_exceedances: int, confidence: Sequence[float], horizons: Sequence[int], step: int = 1, mode: str = "textbook") -> DataFrame:
    """Rolling peaks-over-threshold VaR/CVaR with their parameters."""
    grid = literal_rows([{"confidence_level": float(c), "horizon": h} for c in confidence for h in horizons])
    return evt_var_cvar(pot_parameters(rets, window, quantiles, min_exceedances, step, mode), grid)


def tail_parameters_summary(params: DataFrame) -> DataFrame:
    """Mean shape and scale, stability of the shape, share of shapes at their bounds."""
    lo, hi = XI_BOUNDS
    at_bound = ((F.col("xi") <= lo) | (F.col("xi") >= hi)).cast("double")
    return params.groupBy("asset", "threshold_quantile", "estimation_window").agg(
        F.avg("xi").alias("mean_xi"), F.avg("beta").alias("mean_beta"), F.stddev_pop("xi").alias("xi_stability"),
        F.avg(at_bound * 100).alias("xi_bound_pct"), F.avg("num_exceedances").alias("mean_exceedances"),
    )
