"""Tail models on daily prices, and distances of generated returns: every window end, windows of one and two years.

The weekly queries beside these step over window ends; here the step is 1.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import literal_rows
from riskloom.operators import evt, fidelity, risk, rolling, scenarios, sliding_fits, volatility
from riskloom.plans.base import CONFIDENCE, DAILY_WINDOWS, HORIZONS, log_returns
from riskloom.plans.registry import query
from riskloom.plans.tail_queries import PARAM_DOUBLES, pot_ctes, student_fit_sql, student_risk_sql
from riskloom.session import materialise

QUANTILES, MIN_EXCEEDANCES = [0.95], 50
N_SIMS, SEED, BLOCK, DOF, LONGEST = 20_000, 7, 5, 5.0, 10
METHODS = ("iid", "block", "normal", "student", "filtered")


def each_window(series, rets: DataFrame, windows: Sequence[int] = DAILY_WINDOWS) -> DataFrame:
    """``series(rets, window)`` of all windows, told apart by ``estimation_window``."""
    parts = [series(rets, w).withColumn("estimation_window", F.lit(w)) for w in windows]
    return reduce(DataFrame.unionByName, parts)


def daily(spark, sf) -> DataFrame:
    return log_returns(spark, sf, "day")


for _w in DAILY_WINDOWS:
    pot_ctes(f"potd{_w}", "log_returns_day", _w, 1, MIN_EXCEEDANCES, QUANTILES)
_POT = " UNION ALL ".join(f"SELECT * FROM potd{w}_params" for w in DAILY_WINDOWS)
_EVT = " UNION ALL ".join(f"SELECT * FROM potd{w}_series" for w in DAILY_WINDOWS)


def tails(spark, sf) -> DataFrame:
    return reduce(DataFrame.unionByName, [sliding_fits.pot_parameters(daily(spark, sf), w, QUANTILES, MIN_EXCEEDANCES) for w in DAILY_WINDOWS])


@query("pot_parameters_daily", "R15 R16 R17 R20", _POT, PARAM_DOUBLES, 7)
def pot_parameters_daily(spark, sf):
    return tails(spark, sf)


@query("evt_var_cvar_daily", "R18 R19 R20", _EVT, PARAM_DOUBLES + " confidence_level var cvar", 6)
def evt_var_cvar_daily(spark, sf):
    return evt.evt_var_cvar(tails(spark, sf), literal_rows([{"confidence_level": float(c), "horizon": h} for c in CONFIDENCE for h in HORIZONS]))


def garch(spark, sf) -> DataFrame:
    return each_window(lambda r, w: sliding_fits.garch_forecasts(r, w), daily(spark, sf))


@query("garch_volatility_daily", "R11 R8 R9", digits=6)
def garch_volatility_daily(spark, sf):
    return risk.volatility_to_risk(garch(spark, sf), risk.student_grid(CONFIDENCE, HORIZONS, 6.0))


@query("garch_diagnostics_daily", "R12 A11 P19", digits=6)
def garch_diagnostics_daily(spark, sf):
    return volatility.garch_diagnostics(garch(spark, sf)).groupBy("asset", "estimation_window").agg(
        F.avg("persistence").alias("mean_persistence"), (F.stddev_samp("persistence") / F.avg("persistence")).alias("cv_persistence"),
        F.avg("half_life").alias("mean_half_life"), F.avg("long_run_volatility").alias("mean_long_run_volatility"),
        F.avg((~F.col("stationary")).cast("double") * 100).alias("non_stationary_pct"))


@query("garch_forecast_bias_daily", "A12", digits=6)
def garch_forecast_bias_daily(spark, sf):
    def bias(r, w):
        return volatility.forecast_bias(sliding_fits.garch_forecasts(r, w))

    return each_window(bias, daily(spark, sf))


def student(spark, sf) -> DataFrame:
    return each_window(lambda r, w: sliding_fits.student_dof(r, w), daily(spark, sf))


_FITS = " UNION ALL ".join(f"SELECT *, CAST({w} AS INTEGER) AS estimation_window FROM ({student_fit_sql('log_returns_day', w, 1)})" for w in DAILY_WINDOWS)
_FIT_DOUBLES = "r dof mu scale log_likelihood"


@query("student_dof_daily", "R23", _FITS, _FIT_DOUBLES, 6)
def student_dof_daily(spark, sf):
    return student(spark, sf)


@query("student_var_cvar_daily", "R22", student_risk_sql(f"({_FITS})"), _FIT_DOUBLES + " confidence_level var cvar var_low var_high", 6)
def student_var_cvar_daily(spark, sf):
    return volatility.student_var_cvar(student(spark, sf), CONFIDENCE)


def method_paths(windows: DataFrame, n_sims: int, longest: int = LONGEST) -> dict[str, DataFrame]:
    """Paths of every method from the same windows, one row per simulation; a longer path begins with the shorter one."""
    sims = scenarios.simulations(windows, n_sims)
    return {
        "iid": scenarios.iid_paths(sims, longest, SEED), "block": scenarios.block_paths(sims, longest, BLOCK, SEED),
        "normal": scenarios.normal_paths(sims, longest, SEED), "student": scenarios.student_paths(sims, longest, DOF, SEED),
        "filtered": scenarios.filtered_paths(windows, n_sims, longest, seed=SEED),
    }


def method_sums(windows: DataFrame, n_sims: int, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """(method, asset, date, sim, horizon, total) of all methods."""
    parts = [scenarios.horizon_sums(p, horizons).withColumn("method", F.lit(m)) for m, p in method_paths(windows, n_sims, max(horizons)).items()]
    return reduce(DataFrame.unionByName, parts)


def generated_samples(spark, sf, n_sims: int = N_SIMS) -> DataFrame:
    """(method, sample, value): daily returns of the latest year of all assets, and one-day draws of each method from it."""
    latest = rolling.latest_per_key(rolling.window_arrays(daily(spark, sf), DAILY_WINDOWS[0]), ["asset"]).drop("current")
    latest = materialise(latest, "latest-windows")  # one row per asset, read by every method
    drawn = method_sums(latest, n_sims, [1]).select("method", F.lit(fidelity.GENERATED).alias("sample"), F.col("total").alias("value"))
    methods = F.explode(F.array(*[F.lit(m) for m in METHODS])).alias("method")
    real = latest.select(methods, "w").select("method", F.lit(fidelity.REAL).alias("sample"), F.explode("w").alias("value"))
    return real.unionByName(drawn)


@query("generated_sample_distances", "Q1 Q2", digits=7)
def generated_sample_distances(spark, sf):
    samples = materialise(generated_samples(spark, sf), "generated-samples")
    return fidelity.distances(samples, ["method"]).select("wasserstein", "ks_statistic", "method")
