"""Queries for tail models, volatility grids and discretised loss laws."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from riskloom.functions import constants as K
from riskloom.operators import discretise, evt, portfolio, risk, volatility
from riskloom.plans.base import CONFIDENCE, HORIZONS, d, log_returns, simple_returns
from riskloom.plans.portfolio_queries import mu_cov
from riskloom.plans.registry import cte, query
from riskloom.sources import tables

WINDOW, STEP, MIN_EXC, QS = 104, 4, 8, [0.95, 0.90]

def pot_ctes(name: str, rets: str, window: int, step: int, least: int, quantiles: list[float]) -> None:
    """Sub-queries NAME_members ... NAME_params and NAME_series: peaks over threshold of every ``step``-th window end."""
    cte(f"{name}_ranked", f"SELECT asset, date, r, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn FROM {rets}")
    cte(f"{name}_members", f"""
        SELECT e.asset, e.date, e.r, -m.r AS loss FROM {name}_ranked e JOIN {name}_ranked m ON m.asset = e.asset AND m.rn > e.rn - {window} AND m.rn <= e.rn
        WHERE e.rn >= {window} AND (e.rn - {window}) % {step} = 0""")
    tried = [(q, [q, *evt.FALLBACK_QUANTILES]) for q in quantiles]
    levels = sorted({x for _, qs in tried for x in qs})
    cte(f"{name}_quantiles", f"SELECT asset, date, any_value(r) AS r, unnest([{', '.join(d(q) for q in levels)}]) AS lvl, unnest(quantile_cont(loss, [{', '.join(d(q) for q in levels)}])) AS u FROM {name}_members GROUP BY asset, date")
    cte(f"{name}_counts", f"""
        SELECT q.asset, q.date, q.r, q.lvl, q.u, count(*) FILTER (WHERE m.loss > q.u) AS nu FROM {name}_quantiles q JOIN {name}_members m ON m.asset = q.asset AND m.date = q.date GROUP BY 1, 2, 3, 4, 5""")
    cte(f"{name}_threshold", " UNION ALL ".join(f"""
        SELECT asset, date, any_value(r) AS r, {d(q)} AS threshold_quantile,
               coalesce(arg_min(u, pos) FILTER (WHERE nu >= {least}), arg_max(u, pos)) AS threshold, coalesce(arg_min(nu, pos) FILTER (WHERE nu >= {least}), arg_max(nu, pos)) AS nu
        FROM {name}_counts JOIN (VALUES {', '.join(f'({k}, {d(x)})' for k, x in enumerate(qs))}) AS t(pos, lvl) USING (lvl) GROUP BY asset, date""" for q, qs in tried))
    cte(f"{name}_moments", f"""
        SELECT asset, date, r, threshold_quantile, threshold, nu, avg(x) AS m0, avg(x * (nu - rk) / (nu - 1e0)) AS m1, var_pop(x) AS xv FROM (
          SELECT t.*, m.loss - t.threshold AS x, row_number() OVER (PARTITION BY t.asset, t.date, t.threshold_quantile ORDER BY m.loss) AS rk
          FROM {name}_threshold t JOIN {name}_members m ON m.asset = t.asset AND m.date = t.date AND m.loss > t.threshold) GROUP BY 1, 2, 3, 4, 5, 6""")

    def fit(xi: str, beta: str) -> str:
        return f"""
        SELECT asset, date, r, {window} AS n, {window} AS estimation_window, threshold_quantile, threshold, CAST(nu AS INTEGER) AS num_exceedances,
               greatest(-5e-1, least(5e-1, {xi})) AS xi, greatest(1e-3, {beta}) AS beta FROM {name}_moments"""

    cte(f"{name}_params", fit("2 - m0 / (m0 - 2 * m1)", "2 * m0 * m1 / (m0 - 2 * m1)"))
    cte(f"{name}_params_reference", fit("(3 * m1 - m0) / (m0 - m1)", "m0 * m1 / (m0 - m1)"))
    cte(f"{name}_series", f"""
        SELECT * EXCLUDE (v1), v1 * sqrt(horizon) AS var,
               (v1 + CASE WHEN abs(xi) < 1e-8 THEN beta ELSE (beta + xi * (v1 - threshold)) / (1 - xi) END) * sqrt(horizon) AS cvar
        FROM (SELECT * EXCLUDE (v), CASE WHEN v > threshold THEN v END AS v1 FROM (
          SELECT p.*, confidence_level, horizon, greatest(threshold * 1001e-3, CASE WHEN abs(xi) < 1e-8 THEN threshold - beta * ln((1 - confidence_level) / (num_exceedances / n))
                 ELSE threshold + beta / xi * (pow((1 - confidence_level) / (num_exceedances / n), -xi) - 1) END) AS v FROM {name}_params p CROSS JOIN hist_levels))""")


pot_ctes("pot", "log_returns", WINDOW, STEP, MIN_EXC, QS)
cte("evt_series", "SELECT * FROM pot_series")
PARAM_DOUBLES = "r threshold_quantile threshold xi beta"


def pot_parameters(spark, sf, **kw):
    return evt.pot_parameters(log_returns(spark, sf), WINDOW, QS, MIN_EXC, STEP, **kw)


@query("pot_parameters", "R15 R16 R17 R20", "SELECT * FROM pot_params", PARAM_DOUBLES, 7)
def pot_parameters_query(spark, sf):
    return pot_parameters(spark, sf)


@query("pot_parameters_reference_mode", "R17", "SELECT * FROM pot_params_reference", PARAM_DOUBLES, 7)
def pot_parameters_reference_mode(spark, sf):
    return pot_parameters(spark, sf, mode="reference")


@query("pot_latest_parameters", "R21", "SELECT * FROM pot_params QUALIFY row_number() OVER (PARTITION BY asset, threshold_quantile ORDER BY date DESC) = 1", PARAM_DOUBLES, 7)
def pot_latest_parameters(spark, sf):
    return pot_parameters(spark, sf, latest_only=True)


def evt_series(spark, sf, rets=None):
    return evt.evt_series(log_returns(spark, sf) if rets is None else rets, WINDOW, QS, MIN_EXC, CONFIDENCE, HORIZONS, STEP)


@query("evt_var_cvar", "R18 R19 R20", "SELECT * FROM evt_series", PARAM_DOUBLES + " confidence_level var cvar", 6)
def evt_var_cvar(spark, sf):
    return evt_series(spark, sf)


@query("tail_parameters_summary", "M5 P19", """
    SELECT asset, threshold_quantile, estimation_window, avg(xi) AS mean_xi, avg(beta) AS mean_beta, stddev_pop(xi) AS xi_stability,
           avg(CASE WHEN xi <= -5e-1 OR xi >= 5e-1 THEN 1e2 ELSE 0e0 END) AS xi_bound_pct, avg(num_exceedances) AS mean_exceedances FROM pot_params GROUP BY ALL""",
       "threshold_quantile mean_xi mean_beta xi_stability xi_bound_pct mean_exceedances", 6)
def tail_parameters_summary(spark, sf):
    return evt.tail_parameters_summary(pot_parameters(spark, sf))


_GRID = ", ".join(f"({d(g['alpha'])}, {d(g['beta'])})" for g in volatility.garch_grid())
cte("garch_members", """
    SELECT e.asset, e.date, e.r AS current, m.rn - e.rn + 53 AS k, m.r FROM ranked_returns e JOIN ranked_returns m ON m.asset = e.asset AND m.rn >= e.rn - 52 AND m.rn < e.rn
    WHERE e.rn >= 53 AND (e.rn - 53) % 4 = 0""")
cte("garch_e2", "SELECT *, avg(e2) OVER (PARTITION BY asset, date) AS target FROM (SELECT asset, date, current, k, pow(r - avg(r) OVER (PARTITION BY asset, date), 2) AS e2 FROM garch_members)")
cte("garch_scan", f"""
    SELECT asset, date, current AS r, target, alpha, beta, target * (1 - alpha - beta) AS omega, CAST(1 AS BIGINT) AS k, target * (1 - alpha - beta) + alpha * e2 + beta * target AS v, target AS v_last,
           -5e-1 * (ln(target) + e2 / target) AS ll FROM garch_e2 CROSS JOIN (VALUES {_GRID}) AS g(alpha, beta) WHERE k = 1
    UNION ALL SELECT s.asset, s.date, s.r, s.target, s.alpha, s.beta, s.omega, s.k + 1, s.omega + s.alpha * e.e2 + s.beta * s.v, s.v, s.ll - 5e-1 * (ln(s.v) + e.e2 / s.v)
    FROM garch_scan s JOIN garch_e2 e ON e.asset = s.asset AND e.date = s.date AND e.k = s.k + 1""")
cte("garch_fit", """
    SELECT asset, date, r, omega, alpha, beta, alpha + beta AS persistence, target AS unconditional_variance, sqrt(v_last) AS sigma_last, sqrt(v) AS sigma, ll AS log_likelihood
    FROM garch_scan WHERE k = 52 QUALIFY row_number() OVER (PARTITION BY asset, date ORDER BY ll DESC, alpha, beta) = 1""")
_T6 = ", ".join(f"({d(c)}, {h}, {d(K.t_quantile(1 - c, 6.0))}, {d(K.es_factor_t(c, 6.0))})" for c in CONFIDENCE for h in HORIZONS)
FIT_DOUBLES = "r omega alpha beta persistence unconditional_variance sigma_last sigma log_likelihood"


def garch(spark, sf):
    return volatility.garch_forecasts(log_returns(spark, sf), 52, 4)


@query("garch_volatility", "R11 R8 R9", f"""
    SELECT g.*, confidence_level, horizon, -z * sigma * sqrt(horizon) AS var, es * sigma * sqrt(horizon) AS cvar FROM garch_fit g CROSS JOIN (VALUES {_T6}) AS c(confidence_level, horizon, z, es)""",
       FIT_DOUBLES + " confidence_level var cvar", 6)
def garch_volatility(spark, sf):
    return risk.volatility_to_risk(garch(spark, sf), risk.student_grid(CONFIDENCE, HORIZONS, 6.0))


@query("garch_diagnostics", "R12 A11 P19", """
    SELECT asset, avg(persistence) AS mean_persistence, stddev_samp(persistence) / avg(persistence) AS cv_persistence, avg(ln(5e-1) / ln(persistence)) AS mean_half_life,
           avg(sqrt(omega / (1 - persistence))) AS mean_long_run_volatility, avg(CASE WHEN persistence >= 1 THEN 1e2 ELSE 0e0 END) AS non_stationary_pct FROM garch_fit GROUP BY asset""",
       "mean_persistence cv_persistence mean_half_life mean_long_run_volatility non_stationary_pct", 6)
def garch_diagnostics(spark, sf):
    return volatility.garch_diagnostics(garch(spark, sf)).groupBy("asset").agg(
        F.avg("persistence").alias("mean_persistence"), (F.stddev_samp("persistence") / F.avg("persistence")).alias("cv_persistence"),
        F.avg("half_life").alias("mean_half_life"), F.avg("long_run_volatility").alias("mean_long_run_volatility"),
        F.avg((~F.col("stationary")).cast("double") * 100).alias("non_stationary_pct"))


@query("garch_forecast_bias", "A12", """
    SELECT asset, avg(sigma - sigma_last) AS mean_error, sqrt(avg(pow(sigma - sigma_last, 2))) AS rmse, count(*) AS n FROM garch_fit GROUP BY asset""", "mean_error rmse", 6)
def garch_forecast_bias(spark, sf):
    return volatility.forecast_bias(garch(spark, sf))


_DOFS = (2.1, 3, 4, 5, 6, 8, 10, 15, 20, 30, 50)
_DOF_ROWS = ", ".join(f"({d(v)}, {d(math.sqrt((v - 2) / v))}, {d(math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi))})" for v in _DOFS)


def student_fit_sql(rets: str, window: int, step: int) -> str:
    """The best point of the grid for every ``step``-th window end."""
    return f"""
    SELECT asset, date, r, dof, mu, scale, ll AS log_likelihood FROM (
      SELECT asset, date, r, dof, mu, sd * shrink AS scale, sum(-(dof + 1) / 2 * ln(1 + pow((x - mu) / (sd * shrink), 2) / dof)) + count(*) * (any_value(norm) - ln(sd * shrink)) AS ll FROM (
        SELECT *, avg(x) OVER w AS mu, stddev_samp(x) OVER w AS sd FROM (
          SELECT e.asset, e.date, e.r, m.r AS x FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn FROM {rets}) e
          JOIN (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn FROM {rets}) m ON m.asset = e.asset AND m.rn > e.rn - {window} AND m.rn <= e.rn
          WHERE e.rn >= {window} AND (e.rn - {window}) % {step} = 0)
        WINDOW w AS (PARTITION BY asset, date)) CROSS JOIN (VALUES {_DOF_ROWS}) AS v(dof, shrink, norm) GROUP BY asset, date, r, dof, mu, sd, shrink)
    QUALIFY row_number() OVER (PARTITION BY asset, date ORDER BY ll DESC, dof) = 1"""


cte("student_fit", student_fit_sql("log_returns", 104, 13))
_T_ROWS = ", ".join(f"({d(v)}, {d(c)}, {d(K.t_quantile(c, v))}, {d(K.es_factor_t(c, v))})" for v in map(float, _DOFS) for c in CONFIDENCE)


@query("student_dof", "R23", "SELECT * FROM student_fit", "r dof mu scale log_likelihood", 6)
def student_dof(spark, sf):
    return volatility.student_dof(log_returns(spark, sf), 104, 13)


def student_risk_sql(fits: str) -> str:
    return f"""
    SELECT *, var * 95e-2 AS var_low, var * 105e-2 AS var_high FROM (
      SELECT f.*, t.confidence_level, -mu + q * scale AS var, -mu + es * scale AS cvar FROM {fits} f JOIN (VALUES {_T_ROWS}) AS t(dof, confidence_level, q, es) ON t.dof = f.dof)"""


@query("student_var_cvar", "R22", student_risk_sql("student_fit"), "r dof mu scale log_likelihood confidence_level var cvar var_low var_high", 6)
def student_var_cvar(spark, sf):
    return volatility.student_var_cvar(volatility.student_dof(log_returns(spark, sf), 104, 13), CONFIDENCE)


@query("winsorised_returns", "F6", """
    SELECT asset, date, greatest(lo, least(hi, r)) AS r FROM simple_returns JOIN (
      SELECT asset, quantile_cont(r, 1e-2) AS lo, quantile_cont(r, 99e-2) AS hi FROM simple_returns GROUP BY asset) USING (asset)""", "r")
def winsorised_returns(spark, sf):
    return discretise.winsorise(simple_returns(spark, sf), ["asset"], "r", 0.01, 0.99)


@query("robust_scores", "F7", """
    WITH s AS (SELECT asset, avg(r) AS mean, stddev_samp(r) AS std, median(r) AS median FROM simple_returns GROUP BY asset),
    m AS (SELECT asset, median(abs(r - median)) AS mad FROM simple_returns JOIN s USING (asset) GROUP BY asset)
    SELECT asset, date, r, mean, std, median, mad, CASE WHEN mad > 0 THEN mad * 14826e-4 ELSE std END AS robust_scale, (r - mean) / std AS z,
           (r - median) / CASE WHEN mad > 0 THEN mad * 14826e-4 ELSE std END AS robust_z, r AS restored FROM simple_returns JOIN s USING (asset) JOIN m USING (asset)""",
       "r mean std median mad robust_scale z robust_z restored", 7)
def robust_scores(spark, sf):
    s = discretise.robust_scores(simple_returns(spark, sf), ["asset"], "r")
    return s.withColumn("restored", discretise.inverse_robust(F.col("robust_z"), F.col("median"), F.col("robust_scale")))


@query("uniform_grid", "F8", """
    SELECT asset, bin, count(*) AS n, lo + (bin + 5e-1) * step AS centre FROM (
      SELECT asset, lo, step, CAST(greatest(0, least(31, floor((r - lo) / step))) AS INTEGER) AS bin FROM simple_returns JOIN (
        SELECT asset, quantile_cont(r, 5e-3) AS lo, (quantile_cont(r, 995e-3) - quantile_cont(r, 5e-3)) / 32 AS step FROM simple_returns GROUP BY asset) USING (asset))
    GROUP BY asset, bin, lo, step""", "centre")
def uniform_grid(spark, sf):
    g = discretise.uniform_grid(simple_returns(spark, sf), ["asset"], "r", 32)
    return g.groupBy("asset", "bin").agg(F.count("*").alias("n"), F.first("centre").alias("centre"))


_QLEV = [0.01 + 0.98 * k / 15 for k in range(16)]


@query("quantile_grid", "F9", f"""
    SELECT asset, CAST(lvl AS INTEGER) AS level, loss, (loss - first_value(loss) OVER w) / (last_value(loss) OVER w - first_value(loss) OVER w) AS scaled FROM (
      {' UNION ALL '.join(f'SELECT asset, {k} AS lvl, quantile_cont(-r, {d(q)}) AS loss FROM simple_returns GROUP BY asset' for k, q in enumerate(_QLEV))})
    WINDOW w AS (PARTITION BY asset ORDER BY lvl ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", "loss scaled")
def quantile_grid(spark, sf):
    losses = simple_returns(spark, sf).select("asset", (-F.col("r")).alias("loss"))
    return discretise.quantile_grid(losses, ["asset"], "loss", 16)


from riskloom.functions.columns import ERFC_COEFFICIENTS  # noqa: E402


def erfc_sql(x: str) -> str:
    t = f"(1e0 / (1e0 + 5e-1 * abs({x})))"
    poly = d(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({d(c)} + {t} * {poly})"
    tail = f"({t} * exp(-({x}) * ({x}) + {poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {tail} ELSE 2e0 - {tail} END)"


def cdf_sql(x: str) -> str:
    return f"(5e-1 * {erfc_sql(f'(-({x}) / 1.4142135623730951e0)')})"


BITS = 5
cte("law_cells", f"""
    SELECT c AS cell, -4e0 + c * 25e-2 AS z0, ({cdf_sql('-4e0 + (c + 1) * 25e-2')} - {cdf_sql('-4e0 + c * 25e-2')}) / (1 - 2 * {cdf_sql('-4e0')}) AS p
    FROM (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS c)""")
cte("asset_law", "SELECT asset, cell, mu + sigma * (z0 + 125e-3) AS x, p FROM (SELECT asset, -avg(r) AS mu, stddev_samp(r) AS sigma FROM simple_returns GROUP BY asset) CROSS JOIN law_cells")


def asset_law(spark, sf):
    m = simple_returns(spark, sf).groupBy("asset").agg((-F.avg("r")).alias("mu"), F.stddev_samp("r").alias("sigma"))
    return discretise.normal_law(m, ["asset"], BITS)


@query("discretised_normal_law", "F10", "SELECT * FROM asset_law", "x p", 7)
def discretised_normal_law(spark, sf):
    return asset_law(spark, sf)


@query("discretised_cdf_and_tail", "R25", """
    SELECT a.asset, a.cell, a.x, a.p, sum(b.p) FILTER (WHERE b.cell <= a.cell) AS cdf, sum(b.p * greatest(0e0, b.x - a.x)) AS tail_expectation
    FROM asset_law a JOIN asset_law b ON a.asset = b.asset GROUP BY 1, 2, 3, 4""", "x p cdf tail_expectation", 7)
def discretised_cdf_and_tail(spark, sf):
    return discretise.cdf_and_tail(asset_law(spark, sf), ["asset"])


@query("portfolio_discretised_var_cvar", "R24 R27", f"""
    WITH law AS (SELECT portfolio_id, cell, -expected_return / 52 + ex_ante_volatility * (z0 + 125e-3) AS x, p FROM ex_ante CROSS JOIN law_cells),
    c AS (SELECT *, sum(p) OVER (PARTITION BY portfolio_id ORDER BY cell) AS cdf FROM law),
    v AS ({' UNION ALL '.join(f"SELECT portfolio_id, {d(q)} AS confidence_level, min(x) FILTER (WHERE cdf >= {d(q)} - 1e-12) AS var FROM c GROUP BY 1" for q in CONFIDENCE)})
    SELECT portfolio_id, confidence_level, var, var + sum(p * greatest(0e0, x - var)) / (1 - confidence_level) AS cvar FROM v JOIN law USING (portfolio_id) GROUP BY 1, 2, 3""",
       "confidence_level var cvar", 6)
def portfolio_discretised_var_cvar(spark, sf):
    mu, cov = mu_cov(spark, sf)
    e = portfolio.ex_ante(tables.weights(spark, sf), mu, cov)
    laws = e.select("portfolio_id", (-F.col("expected_return") / 52).alias("mu"), F.col("ex_ante_volatility").alias("sigma"))
    return discretise.scaled_var_cvar(laws, ["portfolio_id"], BITS, CONFIDENCE)
