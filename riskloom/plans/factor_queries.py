"""Queries for covariance estimators, factors and risk contributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import factors, portfolio, risk, rolling
from riskloom.plans.base import CONFIDENCE, WEEKS, normal_values, simple_returns
from riskloom.plans.registry import cte, query
from riskloom.session import materialise
from riskloom.sources import tables

cte("last52", "SELECT asset, date, r FROM simple_returns QUALIFY row_number() OVER (PARTITION BY asset ORDER BY date DESC) <= 52")


@query("sample_covariance", "FAC1 J9 D11", """
    SELECT a.asset AS i, b.asset AS j, covar_samp(a.r, b.r) AS cov, corr(a.r, b.r) AS corr FROM last52 a JOIN last52 b ON a.date = b.date AND a.asset <= b.asset GROUP BY 1, 2""", "cov corr")
def sample_covariance(spark, sf):
    return factors.sample_covariance(simple_returns(spark, sf), 52)


@query("expected_returns", "FAC6", "SELECT asset, avg(r) * 52 AS mu FROM last52 GROUP BY asset", "mu")
def expected_returns(spark, sf):
    return factors.expected_returns(simple_returns(spark, sf), 52, WEEKS)


cte("pop_cov", """
    SELECT a.asset AS i, b.asset AS j, avg(a.e * b.e) AS s, avg(a.e * a.e * b.e * b.e) AS q, count(*) AS n FROM
      (SELECT asset, date, r - avg(r) OVER (PARTITION BY asset) AS e FROM last52) a JOIN (SELECT asset, date, r - avg(r) OVER (PARTITION BY asset) AS e FROM last52) b
      ON a.date = b.date AND a.asset <= b.asset GROUP BY 1, 2""")
cte("pop_sums", """
    SELECT count(*) FILTER (WHERE i = j) AS p, max(n) AS n, avg(s) FILTER (WHERE i = j) AS mu, sum(CASE WHEN i = j THEN 1e0 ELSE 2e0 END * s * s) AS s2,
           sum(CASE WHEN i = j THEN 1e0 ELSE 2e0 END * q) AS q FROM pop_cov""")
_SHRUNK = "SELECT i, j, (1 - delta) * s + CASE WHEN i = j THEN delta * mu ELSE 0e0 END AS cov, delta AS shrinkage FROM pop_cov CROSS JOIN ({})"


@query("ledoit_wolf_covariance", "FAC2", _SHRUNK.format(
    "SELECT mu, least((q - s2) / (p * n), (s2 - p * mu * mu) / p) / ((s2 - p * mu * mu) / p) AS delta FROM pop_sums"), "cov shrinkage")
def ledoit_wolf_covariance(spark, sf):
    return factors.shrunk_covariance(simple_returns(spark, sf), "ledoit_wolf", 52)


@query("oas_covariance", "FAC3", _SHRUNK.format(
    "SELECT mu, least(1e0, (s2 / (p * p) + mu * mu) / ((n + 1) * (s2 / (p * p) - mu * mu / p))) AS delta FROM pop_sums"), "cov shrinkage")
def oas_covariance(spark, sf):
    return factors.shrunk_covariance(simple_returns(spark, sf), "oas", 52)


@query("ewma_covariance", "FAC4", """
    WITH k AS (SELECT asset, date, r, pow(94e-2, row_number() OVER (PARTITION BY asset ORDER BY date DESC) - 1) AS k FROM last52),
    n AS (SELECT asset, date, r, k / sum(k) OVER (PARTITION BY asset) AS k FROM k), c AS (SELECT asset, date, k, r - sum(k * r) OVER (PARTITION BY asset) AS e FROM n)
    SELECT a.asset AS i, b.asset AS j, sum(a.k * a.e * b.e) AS cov FROM c a JOIN c b ON a.date = b.date AND a.asset <= b.asset GROUP BY 1, 2""", "cov")
def ewma_covariance(spark, sf):
    return factors.ewma_covariance(simple_returns(spark, sf), 0.94, 52)


@query("trace_normalised_covariance", "FAC7", "SELECT i, j, cov, corr, cov / (SELECT sum(cov) FROM cov WHERE i = j) AS rho FROM cov", "cov corr rho")
def trace_normalised_covariance(spark, sf):
    return factors.trace_normalised(factors.sample_covariance(simple_returns(spark, sf)))


def rolling_cov(spark, sf):
    """Covariance of every pair at every fifth full window end."""
    r = simple_returns(spark, sf)
    ends = r.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("d")).scalar()
    cov = rolling.rolling_pair_stats(r, 52).withColumn("ends", ends)
    return cov.filter((F.array_position("ends", F.col("date")) - 52) % 5 == 0).select("date", "i", "j", "cov")


@query("psd_repair", "FAC5")
def psd_repair(spark, sf):
    return factors.repair_psd(rolling_cov(spark, sf), "date")


cte("rolling_cov", """
    SELECT * FROM (SELECT a.date, a.asset AS i, b.asset AS j, covar_samp(a.r, b.r) OVER (PARTITION BY a.asset, b.asset ORDER BY a.date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS cov
      FROM simple_returns a JOIN simple_returns b ON a.date = b.date AND a.asset <= b.asset)
    WHERE date IN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS rn FROM (SELECT DISTINCT date FROM simple_returns)) WHERE rn >= 52 AND (rn - 52) % 5 = 0)""")


@query("psd_repaired_covariance", "FAC5", "SELECT date, i, j, cov FROM rolling_cov", "cov")
def psd_repaired_covariance(spark, sf):
    # Sample matrices of 52 rows and 10 assets are positive already, so the repair leaves them as they are.
    return factors.repair_psd(rolling_cov(spark, sf), "date").drop("condition_number")


def rolling_factors(spark, sf):
    return factors.eigen_factors(rolling_cov(spark, sf), 3)


@query("eigen_factors", "FAC8 FAC9")
def eigen_factors(spark, sf):
    return rolling_factors(spark, sf)


@query("factor_risk", "FAC10 FAC11")
def factor_risk(spark, sf):
    r = simple_returns(spark, sf)
    total = rolling.rolling_moments(r, [52], population=True).select("date", "asset", (F.col("sigma") ** 2).alias("variance"))
    return factors.factor_risk(factors.exposures(rolling_factors(spark, sf)), total, risk.normal_grid(CONFIDENCE, [1]))


@query("full_rank_explained_variance", "FAC8 FAC9", """
    SELECT a.date, a.i AS asset, a.cov AS explained, t.trace AS eigenvalue_sum FROM rolling_cov a JOIN (SELECT date, sum(cov) AS trace FROM rolling_cov WHERE i = j GROUP BY date) t USING (date) WHERE a.i = a.j""", "explained eigenvalue_sum", 7)
def full_rank_explained_variance(spark, sf):
    """With all factors kept, loadings and eigenvalues give back every variance and their sum the trace."""
    f = materialise(factors.eigen_factors(rolling_cov(spark, sf), 1000), "factors")
    e = factors.exposures(f).groupBy("date", "asset").agg(F.sum(F.col("exposure") ** 2 * F.col("eigenvalue")).alias("explained"))
    return e.join(f.groupBy("date").agg(F.sum("eigenvalue").alias("eigenvalue_sum")), "date")


@query("factor_shock_loss", "FAC12")
def factor_shock_loss(spark, sf):
    return factors.factor_shock_loss(factors.exposures(rolling_factors(spark, sf)), 2.0)


@query("factor_stability", "W13")
def factor_stability(spark, sf):
    return factors.factor_stability(rolling_factors(spark, sf))


def slices_of(f):
    from riskloom.functions.periods import with_periods

    f = f.filter("factor_id = 3").withColumn("estimation_window", F.lit(52)).withColumn("top_k", F.lit(3))
    return with_periods(f).groupBy("slice_type", "slice", "estimation_window", "top_k").agg(
        F.avg("cumulative_explained_variance").alias("mean_cumulative_explained_variance"), F.count("*").alias("n_windows"))


@query("factor_slices", "T12")
def factor_slices(spark, sf):
    return slices_of(rolling_factors(spark, sf))


@query("compare_factor_sets", "FAC13")
def compare_factor_sets(spark, sf):
    # Sample covariance against its shrunk version, both over all dates.
    r = simple_returns(spark, sf)
    a = factors.sample_covariance(r).select(F.lit(0).alias("date"), "i", "j", "cov")
    b = factors.shrunk_covariance(r).select(F.lit(0).alias("date"), "i", "j", "cov")
    return factors.compare_factor_sets(factors.eigen_factors(a, 3), factors.eigen_factors(b, 3))


# --- cases with a closed form ------------------------------------------------------------
# Uncorrelated assets are their own factors, in the order of their variances, so SQL can say what the factor jobs return.

cte("variance_rank", "SELECT date, i AS asset, cov, CAST(row_number() OVER (PARTITION BY date ORDER BY cov DESC, i) AS INTEGER) AS rk FROM rolling_cov WHERE i = j")
cte("population_variance", """
    SELECT date, asset, var_pop(r) OVER f AS v FROM simple_returns WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER f = 52""")


def uncorrelated(spark, sf):
    return materialise(rolling_cov(spark, sf).withColumn("cov", F.when(F.col("i") == F.col("j"), F.col("cov")).otherwise(0.0)), "uncorrelated")


@query("factor_variance_split", "FAC10 FAC11", f"""
    SELECT date, asset, confidence_level, v AS total_variance, -z * sqrt(v) AS var_factor, es * sqrt(v) AS cvar_factor
    FROM population_variance CROSS JOIN {normal_values()} WHERE horizon = 1 AND date IN (SELECT date FROM rolling_cov)""", "confidence_level total_variance var_factor cvar_factor")
def factor_variance_split(spark, sf):
    """Explained and idiosyncratic variance of three factors add up to the whole, and so do the measures made from them."""
    total = rolling.rolling_moments(simple_returns(spark, sf), [52], population=True).select("date", "asset", (F.col("sigma") ** 2).alias("variance"))
    e = factors.exposures(materialise(rolling_factors(spark, sf), "factors"))
    explained = e.groupBy("date", "asset").agg(F.sum(F.col("exposure") ** 2 * F.col("eigenvalue")).alias("explained"))
    out = factors.factor_risk(e, total, risk.normal_grid(CONFIDENCE, [1])).join(explained, ["date", "asset"])
    return out.select("date", "asset", "confidence_level", (F.col("explained") + F.col("idiosyncratic_variance")).alias("total_variance"), "var_factor", "cvar_factor")


@query("uncorrelated_shock_loss", "FAC12", "SELECT date, i AS asset, -2 * sqrt(cov) AS shock_loss FROM rolling_cov WHERE i = j", "shock_loss")
def uncorrelated_shock_loss(spark, sf):
    return factors.factor_shock_loss(factors.exposures(factors.eigen_factors(uncorrelated(spark, sf), 1000)), 2.0)


@query("uncorrelated_factor_stability", "W13", """
    SELECT date, avg(CASE WHEN asset = prev THEN 1e0 ELSE 0e0 END) AS factor_stability FROM (
      SELECT *, lag(asset) OVER (PARTITION BY rk ORDER BY date) AS prev FROM variance_rank WHERE rk <= 3) WHERE prev IS NOT NULL GROUP BY date""", "factor_stability")
def uncorrelated_factor_stability(spark, sf):
    return factors.factor_stability(factors.eigen_factors(uncorrelated(spark, sf), 3))


@query("uncorrelated_factor_slices", "T12", """
    WITH c AS (SELECT date, sum(cov) FILTER (WHERE rk <= 3) / sum(cov) AS share FROM variance_rank GROUP BY date),
    s AS (SELECT 'year' AS slice_type, CAST(year(date) AS VARCHAR) AS slice, share FROM c UNION ALL SELECT 'quarter', year(date) || 'Q' || quarter(date), share FROM c UNION ALL SELECT 'month', strftime(date, '%Y-%m'), share FROM c)
    SELECT slice_type, slice, 52 AS estimation_window, 3 AS top_k, avg(share) AS mean_cumulative_explained_variance, count(*) AS n_windows FROM s GROUP BY 1, 2""", "mean_cumulative_explained_variance")
def uncorrelated_factor_slices(spark, sf):
    return slices_of(factors.eigen_factors(uncorrelated(spark, sf), 3))


@query("compare_scaled_factor_sets", "FAC13", """
    SELECT date, 0e0 AS principal_angle, 0e0 AS explained_variance_gap, 1e0 AS exposure_correlation, sqrt(sum(cov * cov)) AS frobenius_distance FROM variance_rank WHERE rk <= 3 GROUP BY date""",
       "principal_angle explained_variance_gap exposure_correlation frobenius_distance", 6)
def compare_scaled_factor_sets(spark, sf):
    """Twice the covariance has the same factors; only the matrices built from them are apart."""
    c = uncorrelated(spark, sf)
    return factors.compare_factor_sets(factors.eigen_factors(c, 3), factors.eigen_factors(c.withColumn("cov", 2 * F.col("cov")), 3))


cte("rc", """
    SELECT portfolio_id, asset, w, sw / v AS marginal, w * sw / v AS contribution, v AS portfolio_volatility FROM (
      SELECT *, sqrt(sum(w * sw) OVER (PARTITION BY portfolio_id)) AS v FROM (
        SELECT a.portfolio_id, a.asset, any_value(a.w) AS w, sum(cov * b.w) AS sw FROM weights a JOIN weights b ON a.portfolio_id = b.portfolio_id
        JOIN cov_full ON i = a.asset AND j = b.asset GROUP BY 1, 2))""")


@query("risk_contributions", "FAC14", "SELECT * FROM rc", "w marginal contribution portfolio_volatility")
def risk_contributions(spark, sf):
    return factors.risk_contributions(tables.weights(spark, sf), factors.sample_covariance(simple_returns(spark, sf)))


cte("rp_scores", """
    SELECT *, CASE WHEN mean_contribution > 0 THEN std / mean_contribution END AS coefficient_of_variation FROM (
    SELECT portfolio_id, avg(contribution) AS mean_contribution, var_pop(contribution) AS variance, stddev_pop(contribution) AS std, max(contribution) AS max_risk_contribution,
           min(contribution) AS min_risk_contribution, avg(abs(contribution - t)) AS equal_risk_gap, sqrt(avg(pow(contribution - t, 2))) / any_value(t) AS deviation_score, avg(marginal) AS mean_marginal
    FROM (SELECT *, portfolio_volatility / count(*) OVER (PARTITION BY portfolio_id) AS t FROM rc) GROUP BY portfolio_id)""")


@query("risk_parity_scores", "FAC15", "SELECT * FROM rp_scores",
       "mean_contribution variance std max_risk_contribution min_risk_contribution equal_risk_gap deviation_score mean_marginal coefficient_of_variation", 7)
def risk_parity_scores(spark, sf):
    return factors.risk_parity_scores(factors.risk_contributions(tables.weights(spark, sf), factors.sample_covariance(simple_returns(spark, sf))))


cte("twin_weights", "SELECT portfolio_id, asset, 1e0 / count(*) OVER (PARTITION BY portfolio_id) AS w FROM weights WHERE w > 0")
cte("twin_rc", """
    SELECT portfolio_id, asset, w * sw / v AS contribution, v AS portfolio_volatility FROM (
      SELECT *, sqrt(sum(w * sw) OVER (PARTITION BY portfolio_id)) AS v FROM (
        SELECT a.portfolio_id, a.asset, any_value(a.w) AS w, sum(cov * b.w) AS sw FROM twin_weights a JOIN twin_weights b ON a.portfolio_id = b.portfolio_id
        JOIN cov_full ON i = a.asset AND j = b.asset GROUP BY 1, 2))""")


@query("risk_contribution_gap", "E15 FAC15", """
    SELECT portfolio_id, r.equal_risk_gap, t.gap AS equal_weight_gap, t.gap - r.equal_risk_gap AS gap_reduction, t.deviation - r.deviation_score AS deviation_reduction FROM rp_scores r JOIN (
      SELECT portfolio_id, avg(abs(contribution - t)) AS gap, sqrt(avg(pow(contribution - t, 2))) / any_value(t) AS deviation
      FROM (SELECT *, portfolio_volatility / count(*) OVER (PARTITION BY portfolio_id) AS t FROM twin_rc) GROUP BY portfolio_id) t USING (portfolio_id)""",
       "equal_risk_gap equal_weight_gap gap_reduction deviation_reduction", 7)
def risk_contribution_gap(spark, sf):
    """How much closer to equal risk each portfolio is than its equal-weight twin."""
    w = tables.weights(spark, sf)
    cov = materialise(factors.sample_covariance(simple_returns(spark, sf)), "covariance")
    return factors.compare_risk_gaps(factors.risk_contributions(w, cov), factors.risk_contributions(portfolio.equal_weights(w), cov))
