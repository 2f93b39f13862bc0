"""Queries for portfolio structure, evaluation and period slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import portfolio, risk, rolling
from riskloom.plans.base import ACCURACY_DOUBLES, CONFIDENCE, KEYS, WEEKS, accuracy_sql, normal_values, simple_returns
from riskloom.plans.registry import cte, query
from riskloom.session import materialise
from riskloom.sources import portfolios as src
from riskloom.sources import tables

cte("pr", "SELECT portfolio_id, date, sum(w * r) AS r FROM weights JOIN simple_returns USING (asset) GROUP BY portfolio_id, date")


def metrics_sql(source: str, keys: str, periods: int = WEEKS) -> str:
    """SQL of path statistics of (keys, date, r)."""
    return f"""
    SELECT *, sqrt({periods}) * std AS volatility, mean * {periods} AS mean_return, mean * {periods} / nullif(std * sqrt({periods}), 0) AS sharpe_ratio,
           mean * {periods} / nullif(downside_all * sqrt({periods}), 0) AS sortino_ratio, mean * {periods} / nullif(max_drawdown, 0) AS calmar_ratio,
           exp(-n / 12e0 * (skewness * skewness + kurtosis * kurtosis / 4)) AS jarque_bera_p_value
    FROM (
      SELECT {keys}, CAST(count(*) AS INTEGER) AS n, avg(r) AS mean, stddev_samp(r) AS std, avg(pow(r - m, 3)) / nullif(pow(avg(pow(r - m, 2)), 15e-1), 0) AS skewness,
             avg(pow(r - m, 4)) / nullif(pow(avg(pow(r - m, 2)), 2), 0) - 3 AS kurtosis, sqrt(avg(pow(least(r, 0e0), 2))) AS downside_all,
             sqrt(avg(r * r) FILTER (WHERE r < 0)) AS downside_negative, abs(least(min((c - k) / k), 0e0)) AS max_drawdown,
             exp(sum(ln(1 + r))) - 1 AS compounded_return, pow(exp(sum(ln(1 + r))), {periods}e0 / count(*)) AS annual_growth,
             abs(any_value(q)) AS value_at_risk, abs(avg(r) FILTER (WHERE r <= CASE WHEN abs(q) > 0 THEN -abs(q) ELSE q END)) AS conditional_value_at_risk,
             min(r) AS worst, max(r) AS best
      FROM (SELECT *, max(c) OVER (PARTITION BY {keys} ORDER BY date) AS k FROM (
        SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY {keys} ORDER BY date)) AS c, avg(r) OVER (PARTITION BY {keys}) AS m,
               quantile_cont(r, 5e-2) OVER (PARTITION BY {keys}) AS q FROM {source}))
      GROUP BY {keys})"""


cte("pm", metrics_sql("pr", "portfolio_id"))
cte("pm_year", metrics_sql("(SELECT *, CAST(year(date) AS VARCHAR) AS slice FROM pr)", "portfolio_id, slice"))
cte("structure", """
    SELECT portfolio_id, count(*) AS n_assets, sum(w * w) AS hhi, 1 / sum(w * w) AS effective_number, -sum(w * ln(w)) AS entropy,
           max(w) AS top1, sum(w) FILTER (WHERE rk <= 3) AS top3, sum(w) FILTER (WHERE rk <= 5) AS top5
    FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY w DESC) AS rk FROM weights WHERE w > 0) GROUP BY portfolio_id""")

METRIC_COLUMNS = ("portfolio_id, n, mean_return, volatility, sharpe_ratio, sortino_ratio, max_drawdown, calmar_ratio, value_at_risk, "
                  "conditional_value_at_risk, skewness, kurtosis, jarque_bera_p_value")
METRIC_DOUBLES = METRIC_COLUMNS.replace(",", "").replace("portfolio_id n ", "")


def portfolio_metrics(spark, sf):
    return portfolio.batch_metrics(tables.weights(spark, sf), simple_returns(spark, sf), periods=WEEKS)


@query("portfolio_batch_metrics", "E13 E2 E3 E4 E5 R5 J4", f"SELECT {METRIC_COLUMNS} FROM pm", METRIC_DOUBLES, 6)
def portfolio_batch_metrics(spark, sf):
    return portfolio_metrics(spark, sf)


cte("pr_day", "SELECT portfolio_id, date, sum(w * r) AS r FROM weights JOIN simple_returns_day USING (asset) GROUP BY portfolio_id, date")
cte("pm_day", metrics_sql("pr_day", "portfolio_id", 252))


@query("portfolio_batch_metrics_daily", "E13 BL9", f"SELECT {METRIC_COLUMNS} FROM pm_day", METRIC_DOUBLES, 6)
def portfolio_batch_metrics_daily(spark, sf):
    return portfolio.batch_metrics(tables.weights(spark, sf), simple_returns(spark, sf, "day"))


@query("portfolio_ratio_variants", "E2 E3 E4 E5 E7 E8 E12", """
    SELECT portfolio_id, (mean * 52 - 1e-4) / nullif(std * sqrt(52), 0) AS sharpe_annualised, (mean - 1e-4 / 52) / nullif(std, 0) * sqrt(52) AS sharpe_excess_daily,
           (mean * 52 - 1e-4) / nullif(downside_negative * sqrt(52), 0) AS sortino_negative_rows, (mean * 52 - 1e-4) / nullif(downside_all * sqrt(52), 0) AS sortino_all_rows,
           downside_negative * sqrt(52) AS downside_deviation, max_drawdown, -max_drawdown AS max_drawdown_negative, calmar_ratio,
           (mean * 52 - 1e-4) / nullif(conditional_value_at_risk, 0) AS cvar_sharpe,
           (mean * 52 - 1e-4) / nullif(downside_negative * sqrt(52), 0) * value_at_risk / nullif(conditional_value_at_risk, 0) AS cvar_sortino,
           mean * 52 / nullif(conditional_value_at_risk * max_drawdown, 0) AS cvar_calmar, mean * 52 / nullif(conditional_value_at_risk, 0) AS return_over_cvar,
           mean * 52 / nullif(value_at_risk, 0) AS return_over_var, annual_growth - 1 AS realised_return, volatility AS realised_volatility, conditional_value_at_risk AS realised_cvar FROM pm""",
       "sharpe_annualised sharpe_excess_daily sortino_negative_rows sortino_all_rows downside_deviation max_drawdown max_drawdown_negative calmar_ratio cvar_sharpe cvar_sortino "
       "cvar_calmar return_over_cvar return_over_var realised_return realised_volatility realised_cvar", 5)
def portfolio_ratio_variants(spark, sf):
    return portfolio.ratio_variants(portfolio.evaluate(tables.weights(spark, sf), simple_returns(spark, sf), periods=WEEKS), periods=WEEKS)


SLICE_COLS = ("mean_return volatility sharpe_ratio min_return max_return compounded_return annualised_return max_drawdown downside_deviation sortino_ratio calmar_ratio "
              "value_at_risk conditional_value_at_risk")


@query("portfolio_year_slices", "T4 T5 T6 T7 T10", """
    SELECT portfolio_id, slice, n, mean_return, volatility, sharpe_ratio, worst AS min_return, best AS max_return, compounded_return, annual_growth - 1 AS annualised_return,
           max_drawdown, downside_all * sqrt(52) AS downside_deviation, sortino_ratio, calmar_ratio, value_at_risk, conditional_value_at_risk FROM pm_year""", SLICE_COLS, 4)
def portfolio_year_slices(spark, sf):
    return portfolio.slice_performance(tables.weights(spark, sf), simple_returns(spark, sf), "year", WEEKS)


@query("portfolio_temporal_stability", "T9 W10", """
    WITH runs AS (SELECT portfolio_id, neg, island, count(*) AS len FROM (
      SELECT portfolio_id, compounded_return < 0 AS neg, row_number() OVER (PARTITION BY portfolio_id ORDER BY slice)
             - row_number() OVER (PARTITION BY portfolio_id, compounded_return < 0 ORDER BY slice) AS island FROM pm_year) GROUP BY ALL)
    SELECT portfolio_id, stddev_pop(compounded_return) AS return_std, var_pop(sharpe_ratio) AS sharpe_variance, min(compounded_return) AS worst_period,
           max(compounded_return) AS best_period, CAST(coalesce((SELECT max(len) FROM runs WHERE runs.portfolio_id = pm_year.portfolio_id AND neg), 0) AS INTEGER) AS drawdown_persistence
    FROM pm_year GROUP BY portfolio_id""", "return_std sharpe_variance worst_period best_period", 6)
def portfolio_temporal_stability(spark, sf):
    return portfolio.temporal_stability(portfolio.slice_performance(tables.weights(spark, sf), simple_returns(spark, sf), "year", WEEKS))


@query("portfolio_structure", "E9 A19", "SELECT * FROM structure", "hhi effective_number entropy top1 top3 top5")
def portfolio_structure(spark, sf):
    return portfolio.structure(tables.weights(spark, sf))


@query("portfolio_daily_returns", "J3", """
    WITH dr AS (SELECT asset, date, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM raw_prices)
    SELECT portfolio_id, date, sum(w * r) / sum(w) AS r FROM weights JOIN dr USING (asset) WHERE r IS NOT NULL GROUP BY portfolio_id, date""", "r")
def portfolio_daily_returns(spark, sf):
    # Not aligned: weights are scaled to the assets that have a return on the date.
    r = rolling.returns(tables.prices(spark, sf), "simple")
    return portfolio.portfolio_returns(tables.weights(spark, sf), r)


@query("batch_portfolio_returns", "J4 R26", "SELECT date, count(*) AS n, avg(r) AS mean, min(r) AS worst, max(r) AS best, avg(-r) AS mean_loss FROM pr GROUP BY date", "mean worst best mean_loss")
def batch_portfolio_returns(spark, sf):
    r = portfolio.batch_returns(tables.weights(spark, sf), simple_returns(spark, sf))
    return r.groupBy("date").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.min("r").alias("worst"), F.max("r").alias("best"), F.avg(-F.col("r")).alias("mean_loss"))


@query("align_weights_to_universe", "IO5 J5", """
    SELECT p.portfolio_id, a.asset, coalesce(w.w, 0e0) AS w FROM (SELECT DISTINCT portfolio_id FROM weights) p CROSS JOIN (SELECT DISTINCT asset FROM raw_prices) a
    LEFT JOIN weights w ON w.portfolio_id = p.portfolio_id AND w.asset = a.asset""", "w")
def align_weights_to_universe(spark, sf):
    return src.align_to_universe(tables.weights(spark, sf), src.universe_array(tables.prices(spark, sf)))


@query("asset_set_dictionary", "F11 D5 A20 S4", """
    SELECT array_to_string(assets, '|') AS set_id, count(*) AS n_portfolios, CAST(len(assets) AS INTEGER) AS n_assets
    FROM (SELECT portfolio_id, list(asset ORDER BY asset) AS assets FROM weights WHERE w > 1e-10 GROUP BY portfolio_id) GROUP BY assets""")
def asset_set_dictionary(spark, sf):
    return portfolio.set_dictionary(portfolio.asset_sets(tables.weights(spark, sf))).drop("assets")


cte("asset_set", "SELECT portfolio_id, string_agg(asset, '|' ORDER BY asset) AS set_id FROM weights WHERE w > 1e-10 GROUP BY portfolio_id")


@query("per_set_results", "J8", """
    WITH sets AS (SELECT DISTINCT set_id FROM asset_set), members AS (SELECT set_id, unnest(string_split(set_id, '|')) AS asset FROM sets),
    vol AS (SELECT set_id, stddev_samp(r) * sqrt(52) AS equal_weight_volatility FROM (
      SELECT set_id, date, avg(r) AS r FROM members JOIN simple_returns USING (asset) GROUP BY set_id, date) GROUP BY set_id)
    SELECT portfolio_id, set_id, equal_weight_volatility FROM asset_set JOIN vol USING (set_id)""", "equal_weight_volatility")
def per_set_results(spark, sf):
    sets = portfolio.asset_sets(tables.weights(spark, sf))
    distinct = portfolio.set_dictionary(sets).select(F.col("set_id").alias("portfolio_id"), F.explode("assets").alias("asset"), (1.0 / F.col("n_assets")).alias("w"))
    vol = portfolio.batch_metrics(distinct, simple_returns(spark, sf), periods=WEEKS).select(F.col("portfolio_id").alias("set_id"), F.col("volatility").alias("equal_weight_volatility"))
    return portfolio.expand_from_sets(sets, vol)


@query("portfolio_size_distribution", "A13", """
    SELECT n_assets, count(*) AS n_portfolios, count(*) * 100e0 / sum(count(*)) OVER () AS pct FROM structure GROUP BY n_assets""", "pct")
def portfolio_size_distribution(spark, sf):
    from pyspark.sql import Window

    sizes = tables.weights(spark, sf).groupBy("portfolio_id").agg(F.count_if(F.col("w") > 0).alias("n_assets"))
    g = sizes.groupBy("n_assets").agg(F.count("*").alias("n_portfolios"))
    total = F.sum("n_portfolios").over(Window.partitionBy(F.lit(0)))  # one row per size
    return g.withColumn("pct", F.col("n_portfolios") * 100.0 / total)


@query("asset_weight_stats", "A14", """
    SELECT asset, avg(w) FILTER (WHERE w > 0) AS mean_nonzero, stddev_samp(w) FILTER (WHERE w > 0) AS std_nonzero, count(*) FILTER (WHERE w > 0) AS n_nonzero,
           count(*) FILTER (WHERE w > 0) * 100e0 / (SELECT count(DISTINCT portfolio_id) FROM weights) AS pct_nonzero, max(w) AS max_weight FROM weights GROUP BY asset""",
       "mean_nonzero std_nonzero pct_nonzero max_weight")
def asset_weight_stats(spark, sf):
    w = tables.weights(spark, sf)
    n = w.agg(F.count_distinct("portfolio_id").alias("n")).scalar()
    pos = F.when(F.col("w") > 0, F.col("w"))
    return w.groupBy("asset").agg(
        F.avg(pos).alias("mean_nonzero"), F.stddev_samp(pos).alias("std_nonzero"), F.count(pos).alias("n_nonzero"),
        (F.count(pos) * 100.0 / n).alias("pct_nonzero"), F.max("w").alias("max_weight"),
    )


@query("overall_weight_stats", "A15", """
    WITH g AS (SELECT coalesce(w.w, 0e0) AS w FROM (SELECT DISTINCT portfolio_id FROM weights) p CROSS JOIN (SELECT DISTINCT asset FROM raw_prices) a
      LEFT JOIN weights w ON w.portfolio_id = p.portfolio_id AND w.asset = a.asset)
    SELECT count(*) AS n, avg(w) AS mean, stddev_samp(w) AS std, min(w) AS min, max(w) AS max, count(*) FILTER (WHERE w = 0) * 100e0 / count(*) AS zero_pct FROM g""",
       "mean std min max zero_pct")
def overall_weight_stats(spark, sf):
    w = src.align_to_universe(tables.weights(spark, sf), src.universe_array(tables.prices(spark, sf)))
    return w.agg(
        F.count("*").alias("n"), F.avg("w").alias("mean"), F.stddev_samp("w").alias("std"), F.min("w").alias("min"), F.max("w").alias("max"),
        (F.count_if(F.col("w") == 0) * 100.0 / F.count("*")).alias("zero_pct"),
    )


@query("co_occurrence", "A16 J9", """
    SELECT a.asset AS i, b.asset AS j, count(*) AS n, count(*) * 100e0 / (SELECT count(DISTINCT portfolio_id) FROM weights) AS pct
    FROM weights a JOIN weights b ON a.portfolio_id = b.portfolio_id AND a.asset <= b.asset WHERE a.w > 0 AND b.w > 0 GROUP BY 1, 2""", "pct")
def co_occurrence(spark, sf):
    w = tables.weights(spark, sf)
    n = w.agg(F.count_distinct("portfolio_id").alias("n")).scalar()
    # Pairs are made once per distinct asset set, weighted by its portfolios.
    sets = portfolio.set_dictionary(portfolio.asset_sets(w, 0.0))
    pairs = sets.select("assets", "n_portfolios", F.explode("assets").alias("i")).select("i", F.explode("assets").alias("j"), "n_portfolios").filter("i <= j")
    return pairs.groupBy("i", "j").agg(F.sum("n_portfolios").alias("n"), (F.sum("n_portfolios") * 100.0 / n).alias("pct"))


cte("mu", "SELECT asset, avg(r) * 52 AS mu FROM simple_returns GROUP BY asset")
cte("cov", """
    SELECT a.asset AS i, b.asset AS j, covar_samp(a.r, b.r) AS cov, corr(a.r, b.r) AS corr FROM simple_returns a JOIN simple_returns b ON a.date = b.date AND a.asset <= b.asset GROUP BY 1, 2""")
cte("cov_full", "SELECT i, j, cov, corr FROM cov UNION ALL SELECT j, i, cov, corr FROM cov WHERE i <> j")
cte("ex_ante", """
    SELECT portfolio_id, expected_return, variance, sqrt(greatest(variance, 0e0)) AS ex_ante_volatility, expected_return / nullif(sqrt(greatest(variance, 0e0)), 0) AS ex_ante_sharpe FROM (
      SELECT a.portfolio_id, sum(a.w * b.w * cov) AS variance FROM weights a JOIN weights b ON a.portfolio_id = b.portfolio_id JOIN cov_full ON i = a.asset AND j = b.asset GROUP BY 1)
    JOIN (SELECT portfolio_id, sum(w * mu) AS expected_return FROM weights JOIN mu USING (asset) GROUP BY 1) USING (portfolio_id)""")


def mu_cov(spark, sf):
    """Annualised means and sample covariances of the simple returns."""
    from riskloom.operators import factors

    r = simple_returns(spark, sf)
    return factors.expected_returns(r, periods=WEEKS), factors.sample_covariance(r)


@query("ex_ante_metrics", "E1", "SELECT * FROM ex_ante", "expected_return variance ex_ante_volatility ex_ante_sharpe", 6)
def ex_ante_metrics(spark, sf):
    mu, cov = mu_cov(spark, sf)
    return portfolio.ex_ante(tables.weights(spark, sf), mu, cov)


@query("held_correlation", "E10", """
    SELECT s.portfolio_id, m.mean_correlation FROM structure s LEFT JOIN (
      SELECT a.portfolio_id, avg(corr) AS mean_correlation FROM weights a JOIN weights b ON a.portfolio_id = b.portfolio_id AND a.asset < b.asset JOIN cov ON i = a.asset AND j = b.asset GROUP BY 1) m
    ON m.portfolio_id = s.portfolio_id""", "mean_correlation")
def held_correlation(spark, sf):
    _, cov = mu_cov(spark, sf)
    return portfolio.held_correlation(tables.weights(spark, sf), cov)


@query("active_share", "E11", """
    SELECT p.portfolio_id, sum(abs(coalesce(w.w, 0e0) - m.w)) / 2 AS active_share FROM (SELECT DISTINCT portfolio_id FROM weights) p CROSS JOIN market m
    LEFT JOIN weights w ON w.portfolio_id = p.portfolio_id AND w.asset = m.asset GROUP BY 1""", "active_share")
def active_share(spark, sf):
    return portfolio.active_share(tables.weights(spark, sf), tables.market_weights(spark, sf))


@query("benchmark_metrics", "E6", """
    SELECT portfolio_id, avg(a) * 52 AS active_return, stddev_samp(a) * sqrt(52) AS tracking_error, avg(a) * sqrt(52) / nullif(stddev_samp(a), 0) AS information_ratio FROM (
      SELECT portfolio_id, date, pr.r - b.r AS a FROM pr JOIN (SELECT date, sum(w * r) AS r FROM market JOIN simple_returns USING (asset) GROUP BY date) b USING (date)) GROUP BY 1""",
       "active_return tracking_error information_ratio", 6)
def benchmark_metrics(spark, sf):
    return portfolio.benchmark_metrics(tables.weights(spark, sf), simple_returns(spark, sf), tables.market_weights(spark, sf), WEEKS)


cte("equal_pr", "SELECT portfolio_id, date, avg(r) AS r FROM weights JOIN simple_returns USING (asset) WHERE w > 0 GROUP BY portfolio_id, date")


@query("compare_with_equal_weight", "E15", """
    SELECT portfolio_id, v AS volatility, ev AS equal_weight_volatility, (ev - v) / nullif(ev, 0) AS volatility_reduction, m / nullif(v, 0) - em / nullif(ev, 0) AS sharpe_gain FROM
      (SELECT portfolio_id, stddev_samp(r) * sqrt(52) AS v, avg(r) * 52 AS m FROM pr GROUP BY 1) JOIN
      (SELECT portfolio_id, stddev_samp(r) * sqrt(52) AS ev, avg(r) * 52 AS em FROM equal_pr GROUP BY 1) USING (portfolio_id)""",
       "volatility equal_weight_volatility volatility_reduction sharpe_gain", 6)
def compare_with_equal_weight(spark, sf):
    return portfolio.compare_with_equal_weight(tables.weights(spark, sf), simple_returns(spark, sf), WEEKS)


@query("train_test_evaluation", "E14", """
    SELECT portfolio_id, n, mean_return, volatility, max_drawdown FROM (""" + metrics_sql("(SELECT * FROM pr WHERE date > (SELECT max(date) FROM (SELECT DISTINCT date FROM pr ORDER BY date LIMIT 252)))", "portfolio_id") + ")",
       "mean_return volatility max_drawdown", 6)
def train_test_evaluation(spark, sf):
    test = portfolio.train_test(simple_returns(spark, sf), 252).filter("split = 'test'").drop("split")
    return portfolio.batch_metrics(tables.weights(spark, sf), test, periods=WEEKS).select("portfolio_id", "n", "mean_return", "volatility", "max_drawdown")


# Yearly spend of each customer gives a series of rebalanced weights.
cte("yearly_weights", """
    SELECT portfolio_id, rebalance, asset, spend / sum(spend) OVER (PARTITION BY portfolio_id, rebalance) AS w FROM (
      SELECT o_custkey AS portfolio_id, CAST(date_trunc('year', o_orderdate) AS DATE) AS rebalance, 'A' || CAST(l_suppkey % 10 AS VARCHAR) AS asset, sum(l_extendedprice) AS spend
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)""")
cte("turnover", """
    SELECT portfolio_id, rebalance, sum(delta) AS turnover FROM (
      SELECT *, abs(w - lag(w) OVER (PARTITION BY portfolio_id, asset ORDER BY rebalance)) AS delta FROM yearly_weights) WHERE delta IS NOT NULL GROUP BY 1, 2""")


def yearly_spend(spark, sf):
    return (
        tables.read(spark, sf, "lineitem").join(tables.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("portfolio_id"), F.trunc(F.to_date("o_orderdate"), "year").alias("rebalance"), (F.col("l_suppkey") % 10).alias("group"))
        .agg(F.sum("l_extendedprice").alias("spend")).select("portfolio_id", "rebalance", tables.asset_name("group").alias("asset"), "spend")
    )


def yearly_weights(spark, sf):
    from pyspark.sql import Window

    share = F.col("spend") / F.sum("spend").over(Window.partitionBy("portfolio_id", "rebalance"))  # at most one row per asset
    return materialise(yearly_spend(spark, sf).select("portfolio_id", "rebalance", "asset", share.alias("w")), "yearly-weights")  # read twice; the trades are joined once


@query("rebalance_turnover", "W12", "SELECT * FROM turnover", "turnover")
def rebalance_turnover(spark, sf):
    return rolling.turnover(yearly_weights(spark, sf))


_FIRST_DATES = "SELECT date_trunc('year', date)::DATE AS rebalance, min(date) AS date FROM simple_returns GROUP BY 1"
cte("net_returns", f"""
    SELECT portfolio_id, date, r, coalesce(turnover, 0e0) * 10 / 1e4 AS cost, r - coalesce(turnover, 0e0) * 10 / 1e4 AS net FROM (
      SELECT y.portfolio_id, s.date, sum(y.w * s.r) AS r FROM yearly_weights y JOIN simple_returns s ON s.asset = y.asset AND date_trunc('year', s.date)::DATE = y.rebalance GROUP BY 1, 2)
    LEFT JOIN (SELECT portfolio_id, date, turnover FROM turnover JOIN ({_FIRST_DATES}) USING (rebalance)) USING (portfolio_id, date)""")


def net_returns(spark, sf, slices=None):
    """Returns of yearly rebalanced portfolios, less cost on the first date of each year."""
    return portfolio.rebalanced_returns(yearly_spend(spark, sf).withColumnRenamed("spend", "w"), simple_returns(spark, sf), 10.0, slices, scale=True)


@query("cost_adjusted_returns", "E16", "SELECT * FROM net_returns", "r cost net")
def cost_adjusted_returns(spark, sf):
    return net_returns(spark, sf)


@query("slice_performance_with_turnover", "T11", """
    SELECT portfolio_id, CAST(year(date) AS VARCHAR) AS slice, count(*) AS n, exp(sum(ln(1 + net))) - 1 AS net_return, stddev_samp(net) * sqrt(52) AS volatility,
           avg(net) * sqrt(52) / nullif(stddev_samp(net), 0) AS sharpe_ratio, sum(cost) * 1e4 / 10 AS turnover FROM net_returns GROUP BY 1, 2""", "net_return volatility sharpe_ratio turnover", 6)
def slice_performance_with_turnover(spark, sf):
    return net_returns(spark, sf, WEEKS)


cte("pr_flagged", f"""
    SELECT *, -r AS loss, -r > var AS violation FROM (
      SELECT portfolio_id, date, r, 52 AS estimation_window, confidence_level, horizon, CASE WHEN sigma > 0 THEN greatest(0e0, -(mu + z * sigma)) * sqrt(horizon) END AS var FROM (
        SELECT portfolio_id, date, r, avg(r) OVER f AS mu, stddev_samp(r) OVER f AS sigma FROM pr WINDOW f AS (PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)
        QUALIFY count(*) OVER f = 52) CROSS JOIN {normal_values()} WHERE horizon = 1) WHERE var > 0""")
_PORTFOLIO_KEYS = KEYS.replace("asset", "portfolio_id")


@query("portfolio_varcov_backtest", "R2 B1 B3 B8", f"SELECT * EXCLUDE (p, green, yellow) FROM ({accuracy_sql('pr_flagged', _PORTFOLIO_KEYS)})", ACCURACY_DOUBLES)
def portfolio_varcov_backtest(spark, sf):
    """Rolling parametric VaR of every portfolio and how often it was breached."""
    return portfolio.varcov_backtest(tables.weights(spark, sf), simple_returns(spark, sf), [52], CONFIDENCE, [1])


@query("portfolio_volatility_no_correlation", "R13", """
    WITH v AS (SELECT asset, date, stddev_samp(r) OVER f AS sigma FROM simple_returns WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER f = 52)
    SELECT portfolio_id, date, sqrt(sum(w * w * sigma * sigma)) AS volatility FROM weights JOIN v USING (asset) GROUP BY 1, 2
    HAVING count(sigma) = any_value((SELECT count(*) FROM weights g WHERE g.portfolio_id = weights.portfolio_id AND g.w > 0))""", "volatility")
def portfolio_volatility_no_correlation(spark, sf):
    vols = rolling.rolling_moments(simple_returns(spark, sf), [52]).select("asset", "date", "sigma")
    return risk.portfolio_volatility_no_correlation(tables.weights(spark, sf), vols)
