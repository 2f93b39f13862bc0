"""Queries for VaR and expected-shortfall estimates and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import constants as K
from riskloom.operators import backtest, risk
from riskloom.plans.base import CONFIDENCE, HORIZONS, KEYS, d, log_returns, normal_values, simple_returns
from riskloom.plans.registry import cte, query


def _hist_sql(levels) -> str:
    parts = [
        f"""SELECT asset, {d(c)} AS confidence_level, -any_value(q) AS var, -avg(r) FILTER (WHERE r <= q) AS cvar FROM simple_returns
        JOIN (SELECT asset, quantile_cont(r, {d(1 - c)}) AS q FROM simple_returns GROUP BY asset) USING (asset) GROUP BY asset""" for c in levels]
    return " UNION ALL ".join(parts)


@query("historical_var_cvar", "R3", _hist_sql(CONFIDENCE), "confidence_level var cvar")
def historical_var_cvar(spark, sf):
    return risk.historical_var_cvar(simple_returns(spark, sf), ["asset"], CONFIDENCE)


@query("parametric_var_cvar", "R4 F3", f"""
    SELECT asset, confidence_level, -(mu + z * sigma) AS var, -mu + es * sigma AS cvar
    FROM (SELECT asset, avg(r) AS mu, stddev_samp(r) AS sigma FROM simple_returns GROUP BY asset) CROSS JOIN {normal_values()} WHERE horizon = 1""",
       "confidence_level var cvar")
def parametric_var_cvar(spark, sf):
    return risk.parametric_var_cvar(simple_returns(spark, sf), ["asset"], CONFIDENCE)


@query("confidence_sensitivity", "R28", f"""
    SELECT *, var - lag(var) OVER w AS var_step, cvar - lag(cvar) OVER w AS cvar_step FROM ({_hist_sql([0.9, 0.95, 0.99])})
    WINDOW w AS (PARTITION BY asset ORDER BY confidence_level)""", "confidence_level var cvar var_step cvar_step")
def confidence_sensitivity(spark, sf):
    return risk.confidence_sensitivity(simple_returns(spark, sf), ["asset"])


@query("order_statistic_var_cvar", "R6", " UNION ALL ".join(f"""
    SELECT asset, {d(c)} AS confidence_level, any_value(v) AS var, greatest(any_value(v), avg(loss) FILTER (WHERE loss >= v)) AS cvar FROM (
      SELECT *, greatest(0e0, max(CASE WHEN rk = least(floor({d(c)} * n), n - 1) THEN loss END) OVER (PARTITION BY asset)) AS v FROM (
        SELECT asset, -r AS loss, row_number() OVER (PARTITION BY asset ORDER BY -r) - 1 AS rk, count(*) OVER (PARTITION BY asset) AS n FROM simple_returns)) GROUP BY asset"""
    for c in CONFIDENCE), "confidence_level var cvar")
def order_statistic_var_cvar(spark, sf):
    losses = simple_returns(spark, sf).select("asset", (-F.col("r")).alias("loss"))
    return risk.order_statistic_by_group(losses, ["asset"], CONFIDENCE)


@query("quantile_var_cvar", "R7", " UNION ALL ".join(f"""
    SELECT asset, {d(c)} AS confidence_level, any_value(v) AS var, avg(-r) FILTER (WHERE -r >= v) AS cvar FROM simple_returns
    JOIN (SELECT asset, quantile_cont(-r, {d(c)}) AS v FROM simple_returns GROUP BY asset) USING (asset) GROUP BY asset""" for c in CONFIDENCE),
       "confidence_level var cvar")
def quantile_var_cvar(spark, sf):
    losses = simple_returns(spark, sf).select("asset", (-F.col("r")).alias("loss"))
    return risk.quantile_var_cvar(losses, ["asset"], CONFIDENCE)


DOF = 5.0
_T = ", ".join(f"({d(c)}, {h}, {d(K.t_quantile(1 - c, DOF))}, {d(K.es_factor_t(c, DOF))})" for c in CONFIDENCE for h in HORIZONS)


@query("volatility_to_risk_student", "R8 R9 F3", f"""
    SELECT asset, confidence_level, horizon, sigma, -z * sigma * sqrt(horizon) AS var, es * sigma * sqrt(horizon) AS cvar
    FROM (SELECT asset, stddev_samp(r) AS sigma FROM log_returns GROUP BY asset) CROSS JOIN (VALUES {_T}) AS cfg(confidence_level, horizon, z, es)""",
       "confidence_level sigma var cvar")
def volatility_to_risk_student(spark, sf):
    vols = log_returns(spark, sf).groupBy("asset").agg(F.stddev_samp("r").alias("sigma"))
    return risk.volatility_to_risk(vols, risk.student_grid(CONFIDENCE, HORIZONS, DOF))


cte("ewma_series", f"""
    SELECT asset, date, r, sqrt(greatest(v, 1e-12)) AS sigma, confidence_level, horizon, 52 AS estimation_window,
           -z * sqrt(greatest(v, 1e-12)) * sqrt(horizon) AS var, es * sqrt(greatest(v, 1e-12)) * sqrt(horizon) AS cvar
    FROM ewma_forecast CROSS JOIN {normal_values()}""")


def ewma_series(spark, sf, rets=None):
    return risk.ewma_var_cvar(log_returns(spark, sf) if rets is None else rets, 52, CONFIDENCE, HORIZONS)


@query("ewma_var_cvar", "R10", "SELECT * FROM ewma_series", "r sigma confidence_level var cvar")
def ewma_var_cvar(spark, sf):
    return ewma_series(spark, sf)


cte("hist_levels", f"SELECT * FROM (VALUES {', '.join(f'({d(c)}, {h})' for c in CONFIDENCE for h in HORIZONS)}) AS v(confidence_level, horizon)")
cte("hist_quantile", " UNION ALL ".join(f"""
    SELECT asset, date, rn, current AS r, {d(c)} AS confidence_level, quantile_cont(-r, {d(c)}) AS v FROM ewma_members GROUP BY asset, date, rn, current""" for c in CONFIDENCE))
cte("hist_series", """
    SELECT q.asset, q.date, q.r, 52 AS estimation_window, q.confidence_level, h.horizon, greatest(any_value(q.v), 0e0) * sqrt(h.horizon) AS var,
           greatest(avg(-m.r) FILTER (WHERE -m.r >= q.v), 0e0) * sqrt(h.horizon) AS cvar
    FROM hist_quantile q JOIN ewma_members m ON m.asset = q.asset AND m.rn = q.rn JOIN hist_levels h ON h.confidence_level = q.confidence_level
    GROUP BY q.asset, q.date, q.r, q.confidence_level, h.horizon""")


def historical_series(spark, sf, rets=None):
    return risk.historical_var_series(log_returns(spark, sf) if rets is None else rets, 52, CONFIDENCE, HORIZONS)


@query("historical_var_series", "R3 R7", "SELECT * FROM hist_series", "r confidence_level var cvar")
def historical_var_series(spark, sf):
    return historical_series(spark, sf)


cte("hist_flagged", "SELECT *, -r AS loss, -r > var AS violation, -r > cvar AS cvar_violation FROM hist_series WHERE var > 0")


@query("cvar_violations", "B2 J2", "SELECT asset, date, confidence_level, horizon, violation, cvar_violation FROM hist_flagged", "confidence_level")
def cvar_violations(spark, sf):
    return backtest.with_violations(historical_series(spark, sf)).select("asset", "date", "confidence_level", "horizon", "violation", "cvar_violation")


@query("cvar_exceedance_bundle", "B9", f"""
    SELECT *, num_exceedances / n AS exceedance_rate, num_exceedances / n / (1 - confidence_level) AS exceedance_ratio,
           CASE WHEN num_exceedances <= (CASE WHEN 250 * (1 - confidence_level) < 5 THEN 4 ELSE 20 END) * n / 250e0 THEN 'green'
                WHEN num_exceedances <= (CASE WHEN 250 * (1 - confidence_level) < 5 THEN 9 ELSE 30 END) * n / 250e0 THEN 'yellow' ELSE 'red' END AS traffic_light_zone
    FROM (SELECT {KEYS}, count(*) AS n, count(*) FILTER (WHERE cvar_violation) AS num_exceedances, avg(loss - cvar) FILTER (WHERE cvar_violation) AS mean_exceedance,
                 max(loss - cvar) FILTER (WHERE cvar_violation) AS max_exceedance FROM hist_flagged GROUP BY {KEYS})""",
       "confidence_level mean_exceedance max_exceedance exceedance_rate exceedance_ratio")
def cvar_exceedance_bundle(spark, sf):
    return backtest.cvar_exceedance(backtest.with_violations(historical_series(spark, sf)))


@query("cvar_exceedances", "M4", f"""
    SELECT {KEYS}, avg(loss - cvar) FILTER (WHERE cvar_violation) AS mean_exceedance, max(loss - cvar) FILTER (WHERE cvar_violation) AS max_exceedance,
           stddev_samp(loss - cvar) FILTER (WHERE cvar_violation) AS std_exceedance,
           avg(greatest(confidence_level * (loss - cvar), (confidence_level - 1) * (loss - cvar))) AS quantile_loss_score,
           sqrt(avg((loss - cvar) * (loss - cvar)) FILTER (WHERE cvar_violation)) AS rmse_violations, sqrt(avg((loss - cvar) * (loss - cvar))) AS rmse_all
    FROM hist_flagged GROUP BY {KEYS}""", "confidence_level mean_exceedance max_exceedance std_exceedance quantile_loss_score rmse_violations rmse_all")
def cvar_exceedances(spark, sf):
    return backtest.tail_metrics(backtest.with_violations(historical_series(spark, sf)), on="cvar")


@query("time_sliced_cvar_backtest", "T2 T3", f"""
    SELECT {KEYS}, slice_type, slice, min(date) AS start_date, max(date) AS end_date, count(*) AS total_observations, count(*) FILTER (WHERE violation) AS num_violations,
           avg(CAST(cvar_violation AS INTEGER)) AS cvar_hit_rate, avg(loss - cvar) FILTER (WHERE cvar_violation) AS mean_cvar_exceedance,
           max(loss - cvar) FILTER (WHERE cvar_violation) AS max_cvar_exceedance, count(*) FILTER (WHERE violation) / count(*) AS hit_rate,
           count(*) * (1 - confidence_level) AS expected_violations, count(*) FILTER (WHERE violation) / count(*) / (1 - confidence_level) AS violation_ratio
    FROM (SELECT *, 'year' AS slice_type, CAST(year(date) AS VARCHAR) AS slice FROM hist_flagged
          UNION ALL SELECT *, 'quarter', year(date) || 'Q' || quarter(date) FROM hist_flagged
          UNION ALL SELECT *, 'month', strftime(date, '%Y-%m') FROM hist_flagged)
    GROUP BY {KEYS}, slice_type, slice""", "confidence_level cvar_hit_rate mean_cvar_exceedance max_cvar_exceedance hit_rate expected_violations violation_ratio")
def time_sliced_cvar_backtest(spark, sf):
    return backtest.time_slices(backtest.with_violations(historical_series(spark, sf)))


@query("slice_returns_with_risk", "J10", """
    WITH rs AS (SELECT asset, year(date) AS y, exp(sum(ln(1 + r))) - 1 AS slice_return FROM simple_returns GROUP BY ALL),
    ks AS (SELECT asset, year(date) AS y, stddev_samp(r) AS volatility FROM simple_returns GROUP BY ALL)
    SELECT asset, 'year' AS slice_type, CAST(y AS VARCHAR) AS slice, slice_return, volatility FROM rs JOIN ks USING (asset, y)""", "slice_return volatility")
def slice_returns_with_risk(spark, sf):
    from riskloom.functions.periods import with_periods

    s = with_periods(simple_returns(spark, sf), slice_types=("year",)).groupBy("asset", "slice_type", "slice")
    gains = s.agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("slice_return"))
    risks = s.agg(F.stddev_samp("r").alias("volatility"))
    return backtest.slice_with_returns(risks, gains, ["asset"])
