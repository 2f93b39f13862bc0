"""Queries for candidate selection, rebalancing, views and posteriors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import black_litterman as bl
from riskloom.operators import factors, portfolio, risk, rolling, scenarios, selection
from riskloom.plans.base import WEEKS, d, simple_returns
from riskloom.plans.portfolio_queries import metrics_sql, mu_cov
from riskloom.plans.registry import cte, query
from riskloom.plans.scenario_queries import u_sql
from riskloom.session import materialise, new_path
from riskloom.sources import tables
from riskloom.sources.views import applicable_views, load_investor_views


def scored(spark, sf):
    mu, cov = mu_cov(spark, sf)
    return portfolio.ex_ante(tables.weights(spark, sf), mu, cov)


_BEST = """
    SELECT {keys} arg_min(portfolio_id, (variance, portfolio_id)) AS min_variance_id, min(variance) AS min_variance,
           arg_min(portfolio_id, (variance - expected_return, portfolio_id)) AS trade_off_id, min(variance - expected_return) AS trade_off_objective,
           arg_max(portfolio_id, (ex_ante_sharpe, -portfolio_id)) AS max_sharpe_id, max(ex_ante_sharpe) AS max_sharpe FROM ex_ante JOIN asset_set USING (portfolio_id) {group}"""


@query("best_candidates_per_set", "O1", _BEST.format(keys="set_id,", group="GROUP BY set_id"), "min_variance trade_off_objective max_sharpe", 7)
def best_candidates_per_set(spark, sf):
    w = materialise(scored(spark, sf), "scores")
    return selection.best_candidates(w.join(portfolio.asset_sets(tables.weights(spark, sf)).drop("assets"), "portfolio_id"), ["set_id"])


@query("best_candidates_overall", "O1", _BEST.format(keys="", group=""), "min_variance trade_off_objective max_sharpe", 7)
def best_candidates_overall(spark, sf):
    return selection.best_candidates(scored(spark, sf), [])


cte("frontier", """
    SELECT CAST(bucket AS INTEGER) AS bucket, arg_min(portfolio_id, (ex_ante_volatility, portfolio_id)) AS portfolio_id, arg_min(expected_return, (ex_ante_volatility, portfolio_id)) AS target_return,
           min(ex_ante_volatility) AS risk, count(*) AS candidates FROM (
      SELECT *, least(19, floor((expected_return - lo) / ((hi - lo) / 20))) AS bucket FROM ex_ante CROSS JOIN (SELECT min(expected_return) AS lo, max(expected_return) AS hi FROM ex_ante)) GROUP BY bucket""")


@query("efficient_frontier", "O2", "SELECT * FROM frontier", "target_return risk", 7)
def efficient_frontier(spark, sf):
    return selection.frontier(materialise(scored(spark, sf), "scores"), "expected_return", "ex_ante_volatility", 20)


@query("frontier_monotonicity", "P14", """
    SELECT bool_and(ok) AS monotone, count(*) FILTER (WHERE NOT ok) AS violations, count(*) AS points FROM (
      SELECT coalesce(target_return >= lag(target_return) OVER (ORDER BY risk, target_return), true) AS ok FROM frontier)""")
def frontier_monotonicity(spark, sf):
    return selection.frontier_is_monotone(selection.frontier(materialise(scored(spark, sf), "scores"), "expected_return", "ex_ante_volatility", 20))


cte("scenario_stats", "SELECT portfolio_id, mean AS mean_return, conditional_value_at_risk AS cvar, conditional_value_at_risk - mean AS objective FROM (" + metrics_sql("scenario_pr", "portfolio_id") + ")")


def cvar_scores(spark, sf):
    s = scenarios.historical_scenarios(simple_returns(spark, sf), 104).select("date", "asset", "r")
    return selection.cvar_scores(tables.weights(spark, sf), s)


@query("min_cvar_selection", "O3", "SELECT * FROM scenario_stats ORDER BY objective, portfolio_id LIMIT 10", "mean_return cvar objective")
def min_cvar_selection(spark, sf):
    return selection.best_by(cvar_scores(spark, sf), "objective", 10)


@query("cvar_return_frontier", "O4", """
    SELECT CAST(bucket AS INTEGER) AS bucket, arg_min(portfolio_id, (cvar, portfolio_id)) AS portfolio_id, arg_min(mean_return, (cvar, portfolio_id)) AS target_return,
           min(cvar) AS risk, count(*) AS candidates FROM (
      SELECT *, least(19, floor((mean_return - lo) / ((hi - lo) / 20))) AS bucket FROM scenario_stats CROSS JOIN (SELECT min(mean_return) AS lo, max(mean_return) AS hi FROM scenario_stats)) GROUP BY bucket""",
       "target_return risk")
def cvar_return_frontier(spark, sf):
    return selection.frontier(materialise(cvar_scores(spark, sf), "scores"), "mean_return", "cvar", 20)


def distinct_sets(spark, sf):
    return portfolio.set_dictionary(portfolio.asset_sets(tables.weights(spark, sf)))


@query("equal_risk_weights", "O5")
def equal_risk_weights(spark, sf):
    _, cov = mu_cov(spark, sf)
    return selection.equal_risk_weights(distinct_sets(spark, sf), cov)


@query("equal_risk_gap", "O5", "SELECT set_id, CAST(len(string_split(set_id, '|')) AS BIGINT) AS n_assets, 1e0 AS weight_sum, 0e0 AS largest_gap FROM (SELECT DISTINCT set_id FROM asset_set)", "weight_sum largest_gap", 6)
def equal_risk_gap(spark, sf):
    """The solved weights sum to 1 and every asset of a set carries the same share of its risk."""
    _, cov = mu_cov(spark, sf)
    solved = selection.equal_risk_weights(distinct_sets(spark, sf), cov).select("set_id", F.explode(F.arrays_zip("assets", "weights")).alias("e"))
    w = materialise(solved.select(F.col("set_id").alias("portfolio_id"), F.col("e.assets").alias("asset"), F.col("e.weights").alias("w")), "equal-risk")
    g = factors.risk_contributions(w, cov).groupBy(F.col("portfolio_id").alias("set_id"))
    return g.agg(F.count("*").alias("n_assets"), F.sum("w").alias("weight_sum"), (F.max("contribution") * F.count("*") / F.max("portfolio_volatility") - 1).alias("largest_gap"))


@query("rebalance_calendar", "O7", """
    SELECT 'month_end' AS kind, max(date) AS date FROM (SELECT DISTINCT date FROM simple_returns) GROUP BY date_trunc('month', date)
    UNION ALL SELECT 'every_26', date FROM (SELECT date, row_number() OVER (ORDER BY date) AS rn FROM (SELECT DISTINCT date FROM simple_returns)) WHERE rn >= 52 AND (rn - 52) % 26 = 0""")
def rebalance_calendar(spark, sf):
    dates = simple_returns(spark, sf).select("date").distinct()
    a = selection.rebalance_calendar(dates).select(F.lit("month_end").alias("kind"), "date")
    return a.unionByName(selection.rebalance_calendar(dates, 26, 52).select(F.lit("every_26").alias("kind"), "date"))


_ASOF = """
    WITH q AS (SELECT asset, date + INTERVAL 40 DAY AS date FROM (SELECT DISTINCT asset, date_trunc('quarter', date)::DATE AS date FROM prices_day))
    SELECT asset, CAST(q.date AS DATE) AS date, (SELECT max(p.date) FROM prices_day p WHERE p.asset = q.asset AND p.date <= q.date) AS backward,
           coalesce((SELECT min(p.date) FROM prices_day p WHERE p.asset = q.asset AND p.date >= q.date), (SELECT max(p.date) FROM prices_day p WHERE p.asset = q.asset AND p.date <= q.date)) AS forward,
           (SELECT arg_min(p.date, (abs(date_diff('day', p.date, CAST(q.date AS DATE))), p.date)) FROM prices_day p WHERE p.asset = q.asset) AS nearest FROM q"""


@query("as_of_dates", "J6", _ASOF)
def as_of_dates(spark, sf):
    from riskloom.plans.base import prices

    p = prices(spark, sf, "day").select("asset", "date")
    q = p.select("asset", F.date_add(F.trunc("date", "quarter"), 40).alias("date")).distinct()
    out = q
    for mode in ("backward", "forward", "nearest"):
        out = out.join(selection.as_of(q, p, "asset", mode).withColumnRenamed("matched", mode), ["asset", "date"])
    return out


cte("rebalance_dates", "SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS rn FROM (SELECT DISTINCT date FROM simple_returns)) WHERE rn >= 52 AND (rn - 52) % 26 = 0")
cte("rebalance_cov", """
    SELECT * FROM (SELECT a.date, a.asset AS i, b.asset AS j, covar_samp(a.r, b.r) OVER (PARTITION BY a.asset, b.asset ORDER BY a.date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS cov
      FROM simple_returns a JOIN simple_returns b ON a.date = b.date) WHERE date IN (SELECT date FROM rebalance_dates)""")
cte("rebalance_choice", """
    SELECT date, arg_min(portfolio_id, (variance, portfolio_id)) AS portfolio_id, min(variance) AS variance FROM (
      SELECT date, a.portfolio_id, sum(a.w * b.w * cov) AS variance FROM weights a JOIN weights b ON a.portfolio_id = b.portfolio_id JOIN rebalance_cov ON i = a.asset AND j = b.asset GROUP BY 1, 2) GROUP BY date""")


def rebalance_choice(spark, sf):
    r = simple_returns(spark, sf)
    dates = selection.rebalance_calendar(r.select("date").distinct(), 26, 52)
    cov = rolling.rolling_pair_stats(r, 52).join(dates, "date", "left_semi").select("date", "i", "j", "cov")
    w = tables.weights(spark, sf)
    return materialise(selection.rolling_min_variance(w, materialise(cov, "covariance")), "choices"), w, r


@query("rolling_rebalance_choice", "O6", "SELECT * FROM rebalance_choice", "variance")
def rolling_rebalance_choice(spark, sf):
    return rebalance_choice(spark, sf)[0]


@query("rolling_rebalance_backtest", "O6 W12", """
    WITH s AS (SELECT date AS rebalance, portfolio_id, lead(date) OVER (ORDER BY date) AS next FROM rebalance_choice)
    SELECT s.rebalance, s.portfolio_id, r.date, sum(w.w * r.r) AS r FROM s JOIN weights w ON w.portfolio_id = s.portfolio_id
    JOIN simple_returns r ON r.asset = w.asset AND r.date > s.rebalance AND (s.next IS NULL OR r.date <= s.next) GROUP BY 1, 2, 3""", "r")
def rolling_rebalance_backtest(spark, sf):
    return selection.hold_until_next(*rebalance_choice(spark, sf))


cte("rebalance_pairs", """
    WITH p AS (SELECT DISTINCT portfolio_id FROM rebalance_choice), a AS (SELECT DISTINCT asset FROM weights),
    g AS (SELECT p.portfolio_id, a.asset, coalesce(w.w, 0e0) AS w FROM p CROSS JOIN a LEFT JOIN weights w ON w.portfolio_id = p.portfolio_id AND w.asset = a.asset)
    SELECT x.portfolio_id AS held, y.portfolio_id AS wanted, sum(abs(x.w - y.w)) AS gap FROM g x JOIN g y USING (asset) GROUP BY 1, 2""")
cte("rebalance_steps", "SELECT date, portfolio_id, row_number() OVER (ORDER BY date) AS rn FROM rebalance_choice")
cte("rebalance_path", """
    SELECT rn, date, portfolio_id AS wanted, portfolio_id, CAST(NULL AS DOUBLE) AS turnover, true AS traded FROM rebalance_steps WHERE rn = 1
    UNION ALL SELECT s.rn, s.date, s.portfolio_id, CASE WHEN g.gap >= 6e-1 THEN s.portfolio_id ELSE p.portfolio_id END, g.gap, g.gap >= 6e-1
    FROM rebalance_path p JOIN rebalance_steps s ON s.rn = p.rn + 1 JOIN rebalance_pairs g ON g.held = p.portfolio_id AND g.wanted = s.portfolio_id""")


@query("rebalance_loop", "O6 W12", """
    WITH s AS (SELECT *, lead(date) OVER (ORDER BY date) AS next FROM rebalance_path),
    r AS (SELECT s.date, x.date AS day, sum(w.w * x.r) AS r FROM s JOIN weights w ON w.portfolio_id = s.portfolio_id
      JOIN simple_returns x ON x.asset = w.asset AND x.date > s.date AND (s.next IS NULL OR x.date <= s.next) GROUP BY 1, 2)
    SELECT s.date, wanted, portfolio_id, turnover, traded, n, period_return, period_std FROM s LEFT JOIN (
      SELECT date, count(*) AS n, exp(sum(ln(1 + r))) - 1 AS period_return, stddev_samp(r) AS period_std FROM r GROUP BY date) USING (date)""", "turnover period_return period_std")
def rebalance_loop(spark, sf):
    """Rebalances that change too little are skipped; turnover, return and volatility of each period."""
    choices, w, r = rebalance_choice(spark, sf)
    path = materialise(selection.rebalance_path(choices, w, 0.6), "path")
    return selection.rebalance_periods(path, w, r)


P = {"return_weight": 0.5, "risk_weight": 1.0, "diversification_weight": 0.1, "budget_penalty": 10.0, "cardinality_penalty": 8.0, "min_assets": 4, "max_assets": 9}
cte("tail_mean", "SELECT asset, avg(r) FILTER (WHERE r <= q) AS cvar FROM simple_returns JOIN (SELECT asset, quantile_cont(r, 5e-2) AS q FROM simple_returns GROUP BY asset) USING (asset) GROUP BY asset")
cte("qubo", """
    SELECT i, j, CASE WHEN i = j THEN -5e-1 * zm + zc ELSE 1e-1 * corr END + 18e0 - CASE WHEN i = j THEN 2 * 10e0 + 2 * 8e0 * 65e-1 ELSE 0e0 END AS coef FROM cov_full
    JOIN (SELECT asset, (mu - avg(mu) OVER ()) / stddev_pop(mu) OVER () AS zm, (cvar - avg(cvar) OVER ()) / stddev_pop(cvar) OVER () AS zc FROM mu JOIN tail_mean USING (asset)) ON asset = i""")
cte("energies", """
    SELECT s.portfolio_id, s.set_id, e.energy FROM asset_set s JOIN (
      SELECT set_id, sum(coef) + 10e0 + 8e0 * 65e-1 * 65e-1 AS energy FROM (SELECT DISTINCT set_id FROM asset_set) JOIN qubo ON contains(set_id, i) AND contains(set_id, j)
      WHERE len(string_split(set_id, '|')) BETWEEN 4 AND 9 GROUP BY set_id) e ON e.set_id = s.set_id""")


def qubo_inputs(spark, sf):
    """Annualised means, signed 5 % tail means and correlations of the universe."""
    r = simple_returns(spark, sf)
    cvar = risk.historical_var_cvar(r, ["asset"], [0.95]).select("asset", (-F.col("cvar")).alias("cvar"))
    return factors.expected_returns(r, periods=WEEKS), cvar, factors.sample_covariance(r)


def qubo(spark, sf):
    return selection.selection_coefficients(*qubo_inputs(spark, sf), **P)


def energies_of(w, q, p=P):
    c = selection.selection_constant(p["budget_penalty"], p["cardinality_penalty"], p["min_assets"], p["max_assets"])
    return selection.selection_energies(w, materialise(q, "coefficients"), c, p["min_assets"], p["max_assets"])


def energies(spark, sf):
    return energies_of(tables.weights(spark, sf), qubo(spark, sf))


@query("selection_coefficients", "O8 D13", "SELECT i, j, coef FROM qubo", "coef", 7)
def selection_coefficients(spark, sf):
    return qubo(spark, sf)


@query("candidate_energies", "O9", "SELECT * FROM energies", "energy", 7)
def candidate_energies(spark, sf):
    return energies(spark, sf)


@query("lowest_energy_candidates", "K7 O9", """
    SELECT portfolio_id, set_id, energy, CAST(row_number() OVER (ORDER BY energy, portfolio_id) AS INTEGER) AS rank FROM (SELECT portfolio_id, set_id, round(energy, 9) AS energy FROM energies) ORDER BY energy, portfolio_id LIMIT 10""", "energy", 7)
def lowest_energy_candidates(spark, sf):
    return selection.lowest_energies(energies(spark, sf).withColumn("energy", F.round("energy", 9)), 10)


@query("energy_quality", "O11", """
    WITH e AS (SELECT DISTINCT round(energy, 9) AS energy FROM energies ORDER BY 1 LIMIT 2)
    SELECT min(energy) AS best_energy, CASE WHEN count(*) > 1 THEN max(energy) - min(energy) END AS gap_to_second, (SELECT count(DISTINCT set_id) FROM energies) AS unique_sets FROM e""", "best_energy gap_to_second", 7)
def energy_quality(spark, sf):
    return selection.energy_quality(materialise(energies(spark, sf), "energies"))


@query("tail_mean_of_energies", "R29", """
    SELECT n_assets, avg(energy) AS tail_mean, count(*) AS n_tail FROM (
      SELECT *, row_number() OVER (PARTITION BY n_assets ORDER BY energy DESC) AS rk, count(*) OVER (PARTITION BY n_assets) AS n FROM (
        SELECT DISTINCT set_id, energy, len(string_split(set_id, '|'))::INTEGER AS n_assets FROM energies)) WHERE rk <= greatest(1, floor((1e0 - 8e-1) * n)) GROUP BY n_assets""", "tail_mean", 7)
def tail_mean_of_energies(spark, sf):
    # Energies are per asset set, so each group is bounded by the number of sets of that size.
    e = energies(spark, sf).groupBy("set_id").agg(F.first("energy").alias("energy")).withColumn("n_assets", F.size(F.split("set_id", "\\|")))
    return risk.tail_mean_of_scores(e, ["n_assets"], 0.8)


_SWEEP = [(a, b) for a in (0.5, 1.0) for b in (1.0, 2.0)]


def _sweep_sql() -> str:
    parts = []
    for rw, kw in _SWEEP:
        coef = f"CASE WHEN i = j THEN -{d(rw)} * zm + {d(kw)} * zc ELSE 1e-1 * corr END + 18e0 - CASE WHEN i = j THEN 2 * 10e0 + 2 * 8e0 * 65e-1 ELSE 0e0 END"
        parts.append(f"""
        SELECT {d(rw)} AS return_weight, {d(kw)} AS risk_weight, b.portfolio_id, avg(x.r) * 52 AS mean_return, stddev_samp(x.r) * sqrt(52) AS volatility, count(*) AS n FROM (
          SELECT portfolio_id, set_id FROM asset_set JOIN (
            SELECT set_id, sum({coef}) AS energy FROM (SELECT DISTINCT set_id FROM asset_set) JOIN zq ON contains(set_id, i) AND contains(set_id, j)
            WHERE len(string_split(set_id, '|')) BETWEEN 4 AND 9 GROUP BY set_id) USING (set_id) ORDER BY energy, portfolio_id LIMIT 1) b
        JOIN (SELECT s.set_id, date, avg(r) AS r FROM (SELECT DISTINCT set_id FROM asset_set) s JOIN simple_returns ON contains(s.set_id, asset) GROUP BY 1, 2) x ON x.set_id = b.set_id GROUP BY 3""")
    return " UNION ALL ".join(parts)


cte("zq", """
    SELECT i, j, corr, zm, zc FROM cov_full JOIN (
      SELECT asset, (mu - avg(mu) OVER ()) / stddev_pop(mu) OVER () AS zm, (cvar - avg(cvar) OVER ()) / stddev_pop(cvar) OVER () AS zc FROM mu JOIN tail_mean USING (asset)) ON asset = i""")


@query("weight_config_sweep", "O10 J13", _sweep_sql(), "return_weight risk_weight mean_return volatility", 7)
def weight_config_sweep(spark, sf):
    """Best candidate of every objective weighting, held equally weighted: annualised outcome per setting."""
    out = None
    r = simple_returns(spark, sf)
    inputs = [materialise(x, "inputs") for x in qubo_inputs(spark, sf)]
    w = tables.weights(spark, sf)
    for rw, kw in _SWEEP:
        p = {**P, "return_weight": rw, "risk_weight": kw}
        top = selection.lowest_energies(energies_of(w, selection.selection_coefficients(*inputs, **p), p), 1)
        part = top.select(F.lit(rw).alias("return_weight"), F.lit(kw).alias("risk_weight"), "portfolio_id", F.explode(F.split("set_id", "\\|")).alias("asset"))
        out = part if out is None else out.unionByName(part)
    w = out.withColumn("w", 1.0 / F.count("*").over(_by("return_weight", "risk_weight")))
    daily = w.join(r, "asset").groupBy("return_weight", "risk_weight", "portfolio_id", "date").agg(F.sum(F.col("w") * F.col("r")).alias("r"))
    return daily.groupBy("return_weight", "risk_weight", "portfolio_id").agg(
        (F.avg("r") * WEEKS).alias("mean_return"), (F.stddev_samp("r") * WEEKS ** 0.5).alias("volatility"), F.count("*").alias("n"))


def _by(*c):
    from pyspark.sql import Window

    return Window.partitionBy(*c)


@query("binary_weight_coefficients", "O12", """
    WITH b AS (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS bit), l AS (SELECT bit, bit * 625e-4 AS w FROM b)
    SELECT i, x.bit AS bit_i, j, y.bit AS bit_j, (5e-1 * cov + 20e0) * x.w * y.w + CASE WHEN i = j AND x.bit = y.bit THEN -(mu + 40e0) * x.w + CASE WHEN x.w > 15e-2 THEN 10e0 * pow(x.w - 15e-2, 2) ELSE 0e0 END ELSE 0e0 END AS coef
    FROM cov_full JOIN mu ON asset = i CROSS JOIN l x CROSS JOIN l y""", "coef", 7)
def binary_weight_coefficients(spark, sf):
    mu, cov = mu_cov(spark, sf)
    return selection.binary_weight_coefficients(mu, cov, 0.5, 4, 0.0625, 20.0, 0.15, 10.0)


cte("grid_weights", """
    SELECT portfolio_id, asset, w / sum(w) OVER (PARTITION BY portfolio_id) AS w FROM (SELECT portfolio_id, asset, least(round(w / 625e-4) * 625e-4, 4e-1) AS w FROM weights) WHERE w > 0""")


@query("discretised_candidate_scores", "O12", """
    SELECT portfolio_id, variance, expected_return, 5e-1 * variance - expected_return AS objective FROM (
      SELECT a.portfolio_id, sum(a.w * b.w * cov) AS variance FROM grid_weights a JOIN grid_weights b ON a.portfolio_id = b.portfolio_id JOIN cov_full ON i = a.asset AND j = b.asset GROUP BY 1)
    JOIN (SELECT portfolio_id, sum(w * mu) AS expected_return FROM grid_weights JOIN mu USING (asset) GROUP BY 1) USING (portfolio_id)""",
       "variance expected_return objective", 6)
def discretised_candidate_scores(spark, sf):
    mu, cov = mu_cov(spark, sf)
    e = portfolio.ex_ante(selection.discretised_weights(tables.weights(spark, sf), 0.0625, 0.4), mu, cov)
    return e.select("portfolio_id", "variance", "expected_return", (0.5 * F.col("variance") - F.col("expected_return")).alias("objective"))


# --- views and posteriors ---------------------------------------------------------------

cte("bl_market", "SELECT asset, avg(w) / sum(avg(w)) OVER () AS w FROM weights WHERE w > 0 GROUP BY asset")
cte("equilibrium", "SELECT i AS asset, sum(cov * w) * 25e-1 * 52 AS pi FROM cov_full JOIN bl_market ON asset = j GROUP BY i")
cte("differentials", """
    SELECT a.asset AS asset_1, b.asset AS asset_2, a.m - b.m AS return_diff FROM (SELECT asset, avg(r) AS m FROM simple_returns GROUP BY asset) a
    JOIN (SELECT asset, avg(r) AS m FROM simple_returns GROUP BY asset) b ON a.asset < b.asset ORDER BY abs(a.m - b.m) DESC, 1, 2 LIMIT 5""")
cte("bl_views", f"""
    SELECT asset_1 || '-' || asset_2 AS view_id, unnest([asset_1, asset_2]) AS asset, unnest([1e0, -1e0]) AS p, return_diff * 52 AS q,
           [5e-1, 75e-2, 9e-1][CAST(floor({u_sql("'7'", "asset_1 || '-' || asset_2")} * 3) AS INTEGER) + 1] AS confidence FROM differentials""")


def bl_inputs(spark, sf):
    r = simple_returns(spark, sf)
    cov = materialise(factors.sample_covariance(r), "covariance")
    w = tables.weights(spark, sf)
    market = bl.market_weights(w)
    return r, cov, w, market, bl.equilibrium_returns(cov, market, periods=WEEKS), bl.synthetic_views(r, 5, periods=WEEKS)


@query("market_weights", "BL1", "SELECT * FROM bl_market", "w")
def market_weights(spark, sf):
    return bl.market_weights(tables.weights(spark, sf))


@query("equilibrium_returns", "BL2", "SELECT * FROM equilibrium", "pi")
def equilibrium_returns(spark, sf):
    return bl_inputs(spark, sf)[4]


@query("return_differentials", "K6", "SELECT * FROM differentials", "return_diff")
def return_differentials(spark, sf):
    return bl.return_differentials(simple_returns(spark, sf), 5)


@query("synthetic_views", "BL3 K6", "SELECT * FROM bl_views", "p q confidence")
def synthetic_views(spark, sf):
    return bl.synthetic_views(simple_returns(spark, sf), 5, periods=WEEKS)


@query("view_uncertainty", "BL4", """
    SELECT a.view_id, any_value(a.q) AS q, any_value(a.confidence) AS confidence, sum(a.p * b.p * cov) * 25e-3 AS omega, sum(a.p * b.p * cov) * 25e-3 / any_value(a.confidence) AS omega_by_confidence
    FROM bl_views a JOIN bl_views b USING (view_id) JOIN cov_full ON i = a.asset AND j = b.asset GROUP BY a.view_id""", "q confidence omega omega_by_confidence")
def view_uncertainty(spark, sf):
    _, cov, _, _, _, views = bl_inputs(spark, sf)
    return bl.view_uncertainty(views, cov).withColumn("omega_by_confidence", F.col("omega") / F.col("confidence"))


@query("applicable_views", "J7", """
    SELECT s.set_id, v.view_id, v.asset, v.p FROM (SELECT DISTINCT set_id FROM asset_set) s JOIN bl_views v ON true
    WHERE NOT EXISTS (SELECT 1 FROM bl_views x WHERE x.view_id = v.view_id AND NOT contains(s.set_id, x.asset))""", "p")
def applicable_views_query(spark, sf):
    members = distinct_sets(spark, sf).select("set_id", F.explode("assets").alias("asset"))
    return applicable_views(bl.synthetic_views(simple_returns(spark, sf), 5, periods=WEEKS), members).select("set_id", "view_id", "asset", "p")


def posterior(spark, sf):
    r, cov, w, market, prior, views = bl_inputs(spark, sf)
    sets = portfolio.asset_sets(w)
    post = bl.posterior(portfolio.set_dictionary(sets), cov, prior, views)
    return r, w, sets, market, materialise(post, "posterior")


@query("posterior_by_set", "BL5 BL6 BL7")
def posterior_by_set(spark, sf):
    return posterior(spark, sf)[4]


cte("first_view", "SELECT * FROM bl_views WHERE view_id = (SELECT asset_1 || '-' || asset_2 FROM differentials ORDER BY abs(return_diff) DESC LIMIT 1)")
cte("view_sets", "SELECT DISTINCT set_id FROM asset_set WHERE NOT EXISTS (SELECT 1 FROM first_view v WHERE NOT contains(set_id, v.asset))")
cte("view_gain", """
    SELECT i AS asset, sum(cov * p) AS sp, (SELECT sum(a.p * b.p * cov) FROM first_view a JOIN first_view b ON true JOIN cov_full ON i = a.asset AND j = b.asset) AS psp,
           (SELECT any_value(q) - sum(p * pi) FROM first_view JOIN equilibrium USING (asset)) AS miss FROM cov_full JOIN first_view ON j = asset GROUP BY i""")


@query("posterior_with_one_view", "BL5 BL6", """
    SELECT s.set_id, e.asset, e.pi AS prior, e.pi + CASE WHEN v.set_id IS NULL THEN 0e0 ELSE g.sp * g.miss / (2 * g.psp) END AS posterior,
           c.cov * 1025e-3 - CASE WHEN v.set_id IS NULL THEN 0e0 ELSE 25e-3 * g.sp * g.sp / (2 * g.psp) END AS variance
    FROM (SELECT DISTINCT set_id FROM asset_set) s JOIN equilibrium e ON contains(s.set_id, e.asset) JOIN view_gain g ON g.asset = e.asset JOIN cov c ON c.i = e.asset AND c.j = e.asset
    LEFT JOIN view_sets v ON v.set_id = s.set_id""", "prior posterior variance", 7)
def posterior_with_one_view(spark, sf):
    """One view has a closed form: the update is S p (q - p'prior) / (2 p'S p)."""
    r, cov, w, _, prior, _ = bl_inputs(spark, sf)
    post = bl.posterior(portfolio.set_dictionary(portfolio.asset_sets(w)), cov, prior, bl.synthetic_views(r, 1, periods=WEEKS))
    z = F.explode(F.arrays_zip("assets", "prior", "posterior", "posterior_variance")).alias("z")
    return post.select("set_id", z).select(
        "set_id", F.col("z.assets").alias("asset"), F.col("z.prior").alias("prior"), F.col("z.posterior").alias("posterior"), F.col("z.posterior_variance").alias("variance"))


@query("posterior_fixed_point", "BL7", "SELECT DISTINCT set_id, asset, 0e0 AS gap FROM (SELECT set_id, unnest(string_split(set_id, '|')) AS asset FROM asset_set)", "gap")
def posterior_fixed_point(spark, sf):
    """With any number of views the posterior is prior + tau S P' (q - P posterior) / omega; the gap is what remains."""
    from riskloom.operators.factors import mirror

    tau = 0.025
    _, cov, w, _, prior, views = bl_inputs(spark, sf)
    post = posterior(spark, sf)[4].select("set_id", F.explode(F.arrays_zip("assets", "prior", "posterior")).alias("z"))
    post = materialise(post.select("set_id", F.col("z.assets").alias("asset"), F.col("z.prior").alias("prior"), F.col("z.posterior").alias("posterior")), "posterior-long")
    legs = applicable_views(views, post.select("set_id", "asset"))
    missed = legs.join(post, ["set_id", "asset"]).groupBy("set_id", "view_id").agg((F.first("q") - F.sum(F.col("p") * F.col("posterior"))).alias("miss"))
    scaled = missed.join(bl.view_uncertainty(views, cov, tau).select("view_id", "omega"), "view_id").select("set_id", "view_id", (F.col("miss") / F.col("omega")).alias("r"))
    push = legs.select("set_id", "view_id", F.col("asset").alias("j"), "p").join(scaled, ["set_id", "view_id"]).groupBy("set_id", "j").agg(F.sum(F.col("p") * F.col("r")).alias("push"))
    moved = push.join(mirror(cov.select("i", "j", "cov")), "j").groupBy("set_id", F.col("i").alias("asset")).agg((tau * F.sum(F.col("cov") * F.col("push"))).alias("move"))
    out = post.join(moved, ["set_id", "asset"], "left")
    return out.select("set_id", "asset", (F.col("posterior") - F.col("prior") - F.coalesce("move", F.lit(0.0))).alias("gap"))


@query("posterior_diagnostics", "BL8")
def posterior_diagnostics(spark, sf):
    _, _, _, market, post = posterior(spark, sf)
    return bl.diagnostics(post, market)


@query("posterior_portfolio_metrics", "BL9 J8")
def posterior_portfolio_metrics(spark, sf):
    """Per-set weights evaluated once per distinct set, results given to every portfolio."""
    r, _, sets, _, post = posterior(spark, sf)
    per_set = portfolio.batch_metrics(bl.posterior_long(post).select(F.col("set_id").alias("portfolio_id"), "asset", "w"), r, periods=WEEKS).withColumnRenamed("portfolio_id", "set_id")
    return portfolio.expand_from_sets(sets, per_set)


@query("posterior_year_slices", "T8")
def posterior_year_slices(spark, sf):
    """Portfolio of the actual posterior against those of the prior and the market, per asset set and year."""
    r, cov, w, market, prior, views = bl_inputs(spark, sf)
    sets = materialise(portfolio.set_dictionary(portfolio.asset_sets(w)), "sets")
    return bl.posterior_slices(sets, r, cov, prior, views, market, "year", WEEKS)


@query("benchmark_year_slices", "T8", """
    SELECT portfolio_id, CAST(year(date) AS VARCHAR) AS slice, avg(p - m) * 52 AS active_return_vs_market, stddev_samp(p - m) * sqrt(52) AS tracking_error_vs_market,
           avg(p - m) * 52 / nullif(stddev_samp(p - m) * sqrt(52), 0) AS information_ratio_vs_market, avg(p - e) * 52 AS active_return_vs_prior,
           stddev_samp(p - e) * sqrt(52) AS tracking_error_vs_prior, avg(p - e) * 52 / nullif(stddev_samp(p - e) * sqrt(52), 0) AS information_ratio_vs_prior FROM (
      SELECT portfolio_id, date, g.r AS p, m.r AS m, e.r AS e FROM (SELECT portfolio_id, date, sum(w * r) AS r FROM weights JOIN simple_returns USING (asset) GROUP BY 1, 2) g
      JOIN (SELECT date, sum(w * r) AS r FROM market JOIN simple_returns USING (asset) GROUP BY date) m USING (date) JOIN (SELECT date, avg(r) AS r FROM simple_returns GROUP BY date) e USING (date))
    GROUP BY 1, 2""", "active_return_vs_market tracking_error_vs_market information_ratio_vs_market active_return_vs_prior tracking_error_vs_prior information_ratio_vs_prior", 6)
def benchmark_year_slices(spark, sf):
    # Every portfolio against the market portfolio and an equal-weight prior.
    r = simple_returns(spark, sf)
    assets = r.select("asset").distinct()
    prior = assets.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy(F.lit(0))))  # one row per asset
    return bl.benchmark_slices(tables.weights(spark, sf), r, tables.market_weights(spark, sf), prior, "year", WEEKS)


@query("investor_views", "IO6 D12", """
    WITH m AS (SELECT asset, mu, row_number() OVER (ORDER BY asset) - 1 AS n FROM mu)
    SELECT 'abs_' || n AS view_id, asset, 1e0 AS p, mu AS q, 75e-2 AS confidence FROM m
    UNION ALL SELECT 'rel_0', asset, CASE WHEN mu = (SELECT max(mu) FROM m) THEN 1e0 ELSE -1e0 END, (SELECT max(mu) - min(mu) FROM m), 5e-1 FROM m
    WHERE mu IN ((SELECT max(mu) FROM m), (SELECT min(mu) FROM m))""", "p q confidence")
def investor_views(spark, sf):
    """Views written as a JSON file from the annualised means, then read by the loader."""
    mu, _ = mu_cov(spark, sf)
    first, last = F.max_by("asset", "mu"), F.min_by("asset", "mu")
    absolute = F.array_sort(F.collect_list(F.struct("asset", F.col("mu").alias("return"), F.lit(0.75).alias("confidence"))))  # one row per asset
    relative = F.array(F.struct(F.array(first, last).alias("assets"), (F.max("mu") - F.min("mu")).alias("return_diff"), F.lit(0.5).alias("confidence"), F.lit("best over worst").alias("comment")))
    path = new_path(spark, "views")
    mu.agg(absolute.alias("absolute_views"), relative.alias("relative_views")).coalesce(1).write.json(path)
    return load_investor_views(spark, path)
