"""Backtest queries over the parametric VaR series."""

from __future__ import annotations

from riskloom.operators import backtest
from riskloom.plans.base import ACCURACY_DOUBLES, KEYS, daily_flagged, log_returns, varcov_flagged, varcov_series
from riskloom.plans.registry import query


@query("varcov_backtest", "B1 B3 B4 B5 B6 B7 B8 W9 F5 R2", "SELECT * FROM accuracy", ACCURACY_DOUBLES)
def varcov_backtest(spark, sf):
    return backtest.accuracy(varcov_flagged(spark, sf))


@query("varcov_backtest_daily", "R2 B8", "SELECT * FROM accuracy_day", ACCURACY_DOUBLES)
def varcov_backtest_daily(spark, sf):
    return backtest.accuracy(daily_flagged(spark, sf))


@query("varcov_var_series", "R1 R2 F2 F3 J13 W2", "SELECT * FROM varcov", "confidence_level r var")
def varcov_var_series(spark, sf):
    return varcov_series(spark, sf)


@query("violation_transitions", "W9", f"SELECT {KEYS}, n00, n01, n10, n11 FROM accuracy", "confidence_level")
def violation_transitions(spark, sf):
    return backtest.transitions(varcov_flagged(spark, sf))


@query("tail_exceedances", "M1 M2 M3", f"""
    SELECT {KEYS}, avg(loss - var) FILTER (WHERE violation) AS mean_exceedance, max(loss - var) FILTER (WHERE violation) AS max_exceedance,
           stddev_samp(loss - var) FILTER (WHERE violation) AS std_exceedance,
           avg(greatest(confidence_level * (loss - var), (confidence_level - 1) * (loss - var))) AS quantile_loss_score,
           sqrt(avg((loss - var) * (loss - var)) FILTER (WHERE violation)) AS rmse_violations, sqrt(avg((loss - var) * (loss - var))) AS rmse_all
    FROM flagged GROUP BY {KEYS}""", "confidence_level mean_exceedance max_exceedance std_exceedance quantile_loss_score rmse_violations rmse_all")
def tail_exceedances(spark, sf):
    return backtest.tail_metrics(varcov_flagged(spark, sf))


@query("time_sliced_backtest", "T1 F1", f"""
    SELECT {KEYS}, slice_type, slice, min(date) AS start_date, max(date) AS end_date, count(*) AS total_observations,
           count(*) FILTER (WHERE violation) AS num_violations, count(*) FILTER (WHERE violation) / count(*) AS hit_rate,
           count(*) * (1 - confidence_level) AS expected_violations, count(*) FILTER (WHERE violation) / count(*) / (1 - confidence_level) AS violation_ratio
    FROM (SELECT *, 'year' AS slice_type, CAST(year(date) AS VARCHAR) AS slice FROM flagged
          UNION ALL SELECT *, 'quarter', year(date) || 'Q' || quarter(date) FROM flagged
          UNION ALL SELECT *, 'month', strftime(date, '%Y-%m') FROM flagged)
    GROUP BY {KEYS}, slice_type, slice HAVING count(*) >= 4""", "confidence_level hit_rate expected_violations violation_ratio")
def time_sliced_backtest(spark, sf):
    return backtest.time_slices(varcov_flagged(spark, sf), min_obs=4)


MOMENT_SQL = """count(r) AS n, avg(r) AS m1, avg(r * r) AS m2, avg(r * r * r) AS m3, avg(r * r * r * r) AS m4"""


@query("distribution_tests", "M6 A9", f"""
    SELECT asset, n, skewness, kurtosis, n / 6e0 * (skewness * skewness + kurtosis * kurtosis / 4) AS jarque_bera_statistic,
           exp(-n / 12e0 * (skewness * skewness + kurtosis * kurtosis / 4)) AS jarque_bera_p_value
    FROM (SELECT asset, n, (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / pow(m2 - m1 * m1, 15e-1) AS skewness,
                 (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / pow(m2 - m1 * m1, 2) - 3 AS kurtosis
          FROM (SELECT asset, {MOMENT_SQL} FROM log_returns GROUP BY asset))""", "skewness kurtosis jarque_bera_statistic jarque_bera_p_value", 6)
def distribution_tests(spark, sf):
    return backtest.distribution_metrics(log_returns(spark, sf), ["asset"])


@query("tail_shape", "M7", """
    WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY r) AS rk, count(*) OVER (PARTITION BY asset) AS n FROM log_returns),
    tail AS (SELECT *, min(abs(r)) OVER (PARTITION BY asset) AS u FROM ranked WHERE rk <= greatest(10, n // 10) AND r < 0),
    hill AS (SELECT asset, 1 / nullif(avg(ln(abs(r) / u)), 0) AS hill_tail_index, count(*) AS tail_rows FROM tail GROUP BY asset),
    q AS (SELECT asset, quantile_cont(r, 1e-2) AS q1, quantile_cont(r, 5e-2) AS q5, quantile_cont(r, 1e-1) AS q10 FROM log_returns GROUP BY asset),
    c AS (SELECT asset, any_value(q1) AS q1, any_value(q5) AS q5, any_value(q10) AS q10, avg(-r) FILTER (WHERE r <= q1) AS cvar_99,
                 avg(-r) FILTER (WHERE r <= q5) AS cvar_95, avg(-r) FILTER (WHERE r <= q10) AS cvar_90 FROM log_returns JOIN q USING (asset) GROUP BY asset)
    SELECT asset, cvar_99, cvar_95, cvar_90, -q1 AS extreme_var_99, cvar_99 >= -q1 AND cvar_95 >= -q5 AND cvar_90 >= -q10 AS cvar_at_least_var,
           cvar_99 >= cvar_95 AND cvar_95 >= cvar_90 AS cvar_monotone, hill_tail_index, tail_rows FROM c LEFT JOIN hill USING (asset)""",
       "cvar_99 cvar_95 cvar_90 extreme_var_99 hill_tail_index", 6)
def tail_shape(spark, sf):
    return backtest.tail_shape(log_returns(spark, sf), ["asset"])


@query("tail_ratios", "M8 E8", """
    WITH q AS (SELECT asset, quantile_cont(r, 5e-2) AS q5, quantile_cont(r, 95e-2) AS q95 FROM log_returns GROUP BY asset),
    e AS (SELECT asset, any_value(q5) AS q5, any_value(q95) AS q95, avg(r) FILTER (WHERE r <= q5) AS es FROM log_returns JOIN q USING (asset) GROUP BY asset)
    SELECT asset, abs(any_value(q95) / any_value(q5)) AS tail_ratio, -any_value(q5) AS var, -any_value(es) AS cvar, any_value(es) / any_value(q5) AS cvar_over_var,
           -min(r) AS worst_loss, -avg(r) FILTER (WHERE r <= es) AS expected_loss_beyond_cvar, var_pop(r) FILTER (WHERE r < 0) AS semivariance
    FROM log_returns JOIN e USING (asset) GROUP BY asset""", "tail_ratio var cvar cvar_over_var worst_loss expected_loss_beyond_cvar semivariance")
def tail_ratios(spark, sf):
    return backtest.tail_ratios(log_returns(spark, sf), ["asset"])
