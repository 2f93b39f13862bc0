"""Queries of the comparison layer: models, tools, rankings, checks and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import backtest, compare, portfolio, rolling, sampling
from riskloom.operators.ordering import percent_rank
from riskloom.plans import base
from riskloom.plans.base import accuracy_sql, d, log_returns, simple_returns
from riskloom.plans.portfolio_queries import METRIC_COLUMNS, metrics_sql
from riskloom.plans.registry import cte, query, round_doubles
from riskloom.plans.risk_queries import ewma_series, historical_series
from riskloom.plans.tail_queries import evt_series
from riskloom.session import materialise
from riskloom.sources import tables

SERIES = "model, asset, date, r, confidence_level, horizon, estimation_window, threshold_quantile, var, cvar"
MODEL_KEYS = ["model", "asset", "confidence_level", "horizon", "estimation_window", "threshold_quantile"]
KEYS_SQL = ", ".join(MODEL_KEYS)

cte("model_series", f"""
    SELECT 'varcov' AS model, asset, date, r, confidence_level, horizon, estimation_window, 0e0 AS threshold_quantile, var, NULL::DOUBLE AS cvar FROM varcov
    UNION ALL SELECT 'historical', asset, date, r, confidence_level, horizon, estimation_window, 0e0, var, cvar FROM hist_series
    UNION ALL SELECT 'ewma', asset, date, r, confidence_level, horizon, estimation_window, 0e0, var, cvar FROM ewma_series
    UNION ALL SELECT 'evt', asset, date, r, confidence_level, horizon, estimation_window, threshold_quantile, var, cvar FROM evt_series""")
cte("model_flagged", "SELECT *, -r AS loss, -r > var AS violation FROM model_series WHERE var > 0")
cte("model_accuracy", f"SELECT * EXCLUDE (p, green, yellow) FROM ({accuracy_sql('model_flagged', KEYS_SQL)})")
cte("model_metrics", f"""
    SELECT a.*, t.mean_exceedance, t.rmse_violations, t.quantile_loss_score FROM model_accuracy a JOIN (
      SELECT {KEYS_SQL}, avg(loss - var) FILTER (WHERE violation) AS mean_exceedance, sqrt(avg(pow(loss - var, 2)) FILTER (WHERE violation)) AS rmse_violations,
             avg(greatest(confidence_level * (loss - var), (confidence_level - 1) * (loss - var))) AS quantile_loss_score FROM model_flagged GROUP BY {KEYS_SQL}) t
    USING ({KEYS_SQL})""")


def model_series(spark, sf):
    rets = materialise(base.log_returns(spark, sf), "returns")  # one scan of the trades for all models
    series = compare.union_models({
        "varcov": base.varcov_series(spark, sf, rets), "historical": historical_series(spark, sf, rets), "ewma": ewma_series(spark, sf, rets), "evt": evt_series(spark, sf, rets)})
    series = series.withColumn("threshold_quantile", F.coalesce("threshold_quantile", F.lit(0.0)))
    return series.select(*[c.strip() for c in SERIES.split(",")])


def model_metrics(spark, sf):
    flagged = materialise(backtest.with_violations(model_series(spark, sf)), "series")
    tail = backtest.tail_metrics(flagged, MODEL_KEYS).select(*MODEL_KEYS, "mean_exceedance", "rmse_violations", "quantile_loss_score")
    return materialise(backtest.accuracy(flagged, MODEL_KEYS).join(tail, MODEL_KEYS), "metrics")


@query("model_series_union", "S1 IO11 D6", f"SELECT {SERIES} FROM model_series", "r confidence_level threshold_quantile var cvar", 6)
def model_series_union(spark, sf):
    return model_series(spark, sf)


@query("common_assets", "J11 S2", """
    SELECT DISTINCT asset, model FROM (SELECT asset, model FROM model_series WHERE NOT (model = 'evt' AND asset = 'A3')) WHERE asset IN (
      SELECT asset FROM (SELECT DISTINCT asset, model FROM model_series WHERE NOT (model = 'evt' AND asset = 'A3')) GROUP BY asset HAVING count(*) = 4)""")
def common_assets(spark, sf):
    s = model_series(spark, sf).filter(~((F.col("model") == "evt") & (F.col("asset") == "A3"))).select("asset", "model").distinct()
    return compare.common_assets(materialise(s, "pairs"))


@query("plausible_risk", "P12", """
    SELECT model, count(*) AS n FROM model_series WHERE var > 0 AND cvar >= var AND isfinite(var) AND isfinite(cvar) GROUP BY model""")
def plausible_risk(spark, sf):
    return compare.plausible_risk(model_series(spark, sf)).groupBy("model").agg(F.count("*").alias("n"))


@query("coverage_accuracy", "A5", """
    SELECT model, confidence_level, avg(hit_rate) AS mean_hit_rate, median(hit_rate) AS median_hit_rate, quantile_cont(hit_rate, 95e-2) AS p95_hit_rate, avg(1 - confidence_level) AS expected_hit_rate,
           avg(abs(hit_rate - (1 - confidence_level))) AS mean_abs_deviation, avg(violation_ratio) AS mean_violation_ratio FROM model_metrics GROUP BY 1, 2""",
       "confidence_level mean_hit_rate median_hit_rate p95_hit_rate expected_hit_rate mean_abs_deviation mean_violation_ratio", 7)
def coverage_accuracy(spark, sf):
    return compare.coverage_accuracy(model_metrics(spark, sf))


@query("rejection_rates", "A6", """
    SELECT model, test, avg(CASE WHEN reject THEN 1e2 ELSE 0e0 END) AS rejection_pct, avg(p_value) AS mean_p_value, count(*) AS n FROM (
      SELECT model, 'kupiec' AS test, kupiec_reject AS reject, kupiec_p_value AS p_value FROM model_metrics
      UNION ALL SELECT model, 'independence', independence_reject, independence_p_value FROM model_metrics
      UNION ALL SELECT model, 'conditional_coverage', conditional_coverage_reject, conditional_coverage_p_value FROM model_metrics) GROUP BY 1, 2""", "rejection_pct mean_p_value", 6)
def rejection_rates(spark, sf):
    return compare.rejection_rates(model_metrics(spark, sf))


@query("zone_counts", "A7", """
    SELECT model, zone, count(*) FILTER (WHERE traffic_light_zone = zone) AS n_zone, count(*) FILTER (WHERE traffic_light_zone = zone) * 100e0 / count(*) AS pct
    FROM model_metrics CROSS JOIN (VALUES ('green'), ('yellow'), ('red')) AS z(zone) GROUP BY 1, 2""", "pct")
def zone_counts(spark, sf):
    return compare.zone_counts(model_metrics(spark, sf))


@query("tail_risk_comparison", "A8 A1", """
    SELECT model, confidence_level, metric, count(*) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, median(value) AS median, quantile_cont(value, 95e-2) AS p95 FROM (
      SELECT model, confidence_level, 'var' AS metric, var AS value FROM model_series WHERE horizon = 1 UNION ALL SELECT model, confidence_level, 'cvar', cvar FROM model_series WHERE horizon = 1)
    WHERE value IS NOT NULL GROUP BY 1, 2, 3""", "confidence_level mean std min max median p95", 6)
def tail_risk_comparison(spark, sf):
    long = compare.to_long(model_series(spark, sf).filter("horizon = 1"), ["model", "confidence_level"], ["var", "cvar"])
    return compare.summary(materialise(long, "long"), ["model", "confidence_level", "metric"], {"median": 0.5, "p95": 0.95})


@query("distribution_diagnostics", "A9", """
    SELECT model, avg(mean_exceedance) AS mean, median(mean_exceedance) AS median, stddev_samp(mean_exceedance) AS std, avg(quantile_loss_score) AS mean_pinball FROM model_metrics GROUP BY model""",
       "mean median std mean_pinball", 7)
def distribution_diagnostics(spark, sf):
    return model_metrics(spark, sf).groupBy("model").agg(
        F.avg("mean_exceedance").alias("mean"), F.percentile("mean_exceedance", F.lit(0.5)).alias("median"), F.stddev_samp("mean_exceedance").alias("std"), F.avg("quantile_loss_score").alias("mean_pinball"))


DIMS = ["estimation_window", "horizon", "confidence_level", "threshold_quantile"]


@query("sensitivity", "A10", " UNION ALL ".join(
    f"SELECT model, '{x}' AS dimension, {f'CAST({x} AS VARCHAR)' if x in ('estimation_window', 'horizon') else f'CAST({x} AS VARCHAR)'} AS level, avg(hit_rate) AS mean_hit_rate, avg(violation_ratio) AS mean_violation_ratio, count(*) AS n FROM model_metrics GROUP BY model, {x}"
    for x in DIMS), "mean_hit_rate mean_violation_ratio", 7)
def sensitivity(spark, sf):
    return compare.sensitivity(model_metrics(spark, sf), DIMS, ["hit_rate", "violation_ratio"])


@query("parameter_diagnostics", "A11", """
    SELECT estimation_window, avg(mu) AS mu_mean, stddev_samp(mu) AS mu_std, stddev_samp(mu) / abs(avg(mu)) AS mu_cv, avg(sigma) AS sigma_mean, stddev_samp(sigma) AS sigma_std, stddev_samp(sigma) / abs(avg(sigma)) AS sigma_cv
    FROM moments GROUP BY 1""", "mu_mean mu_std mu_cv sigma_mean sigma_std sigma_cv", 6)
def parameter_diagnostics(spark, sf):
    return compare.parameter_diagnostics(rolling.rolling_moments(log_returns(spark, sf), base.WINDOWS), ["estimation_window"], ["mu", "sigma"])


@query("within_tolerance", "A18", "SELECT model, " + ", ".join(
    f"avg(CASE WHEN abs(hit_rate - (1 - confidence_level)) <= {k} * 1e-2 + 1e-12 THEN 1e2 ELSE 0e0 END) AS within_{k}pct" for k in (1, 2, 3)) + " FROM model_metrics GROUP BY model",
       "within_1pct within_2pct within_3pct", 6)
def within_tolerance(spark, sf):
    return compare.within_tolerance(model_metrics(spark, sf))


_SCORED = """
    SELECT *, 5e-1 * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + 3e-1 * (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) + 2e-1 * (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS score
    FROM (SELECT *, abs(hit_rate - (1 - confidence_level)) AS a, abs(violation_ratio - 1) AS b, coalesce(rmse_violations, max(rmse_violations) OVER (), 0e0) AS c FROM model_metrics)"""


@query("best_configurations", "K3", f"""
    SELECT {KEYS_SQL}, score FROM (SELECT {KEYS_SQL}, round(score, 9) AS score FROM ({_SCORED})) ORDER BY score, {KEYS_SQL} LIMIT 10""", "confidence_level threshold_quantile score", 7)
def best_configurations(spark, sf):
    s = compare.configuration_scores(model_metrics(spark, sf)).withColumn("score", F.round("score", 9))
    return s.select(*MODEL_KEYS, "score").orderBy("score", *MODEL_KEYS).limit(10)


_COMP = ["hit_rate_gap", "violation_ratio_gap", "rmse", "kupiec_rejection"]


@query("model_ranking", "K5", f"""
    WITH g AS (SELECT model, confidence_level, horizon, avg(abs(hit_rate - (1 - confidence_level))) AS component_hit_rate_gap, avg(abs(violation_ratio - 1)) AS component_violation_ratio_gap,
        avg(rmse_violations) AS component_rmse, avg(CASE WHEN kupiec_reject THEN 1e0 ELSE 0e0 END) AS component_kupiec_rejection FROM model_metrics GROUP BY 1, 2, 3),
    s AS (SELECT *, {' + '.join(f"{w} * coalesce(component_{c}, max(component_{c}) OVER (), 0)" for c, w in zip(('hit_rate_gap', 'violation_ratio_gap', 'rmse', 'kupiec_rejection'), ('4e-1', '25e-2', '25e-2', '1e-1')))} AS composite_score FROM g),
    n AS (SELECT model, confidence_level, horizon, {', '.join(f'(component_{c} - min(component_{c}) OVER ()) / (max(component_{c}) OVER () - min(component_{c}) OVER ()) AS component_{c}' for c in _COMP)},
        (composite_score - min(composite_score) OVER ()) / (max(composite_score) OVER () - min(composite_score) OVER ()) AS composite_score FROM s)
    SELECT *, CAST(row_number() OVER (ORDER BY composite_score, model, confidence_level, horizon) AS INTEGER) AS rank FROM n""",
       "confidence_level composite_score " + " ".join(f"component_{c}" for c in _COMP), 7)
def model_ranking(spark, sf):
    return compare.model_ranking(model_metrics(spark, sf))


RULES = {"positive_violation_ratio": lambda: F.col("violation_ratio") > 0, "hit_rate_in_range": lambda: (F.col("hit_rate") >= 0) & (F.col("hit_rate") <= 1), "finite_rmse": lambda: F.col("rmse_violations") < float("inf")}


@query("validated_metrics", "P11", f"SELECT {KEYS_SQL}, hit_rate, violation_ratio FROM model_metrics WHERE rmse_violations IS NOT NULL AND violation_ratio > 0 AND hit_rate BETWEEN 0 AND 1",
       "confidence_level threshold_quantile hit_rate violation_ratio", 7)
def validated_metrics(spark, sf):
    rules = {k: v() for k, v in RULES.items()}
    return compare.validate_metrics(model_metrics(spark, sf), ["hit_rate", "rmse_violations"], rules).select(*MODEL_KEYS, "hit_rate", "violation_ratio")


@query("rejected_metric_counts", "P11", """
    SELECT unnest(['missing_hit_rate', 'missing_rmse_violations', 'positive_violation_ratio', 'hit_rate_in_range', 'finite_rmse']) AS "check",
           unnest([count(*) FILTER (WHERE hit_rate IS NULL), count(*) FILTER (WHERE rmse_violations IS NULL), count(*) FILTER (WHERE NOT coalesce(violation_ratio > 0, false)),
                   count(*) FILTER (WHERE NOT coalesce(hit_rate BETWEEN 0 AND 1, false)), count(*) FILTER (WHERE rmse_violations IS NULL)]) AS rejected FROM model_metrics""")
def rejected_metric_counts(spark, sf):
    return compare.rejected_counts(model_metrics(spark, sf), ["hit_rate", "rmse_violations"], {k: v() for k, v in RULES.items()})


@query("cvar_table_checks", "P15", """
    WITH b AS (SELECT confidence_level, avg(cvar) AS m, bool_and(cvar >= var) AS ok, min(cvar - var) AS e FROM hist_series WHERE horizon = 1 GROUP BY 1)
    SELECT bool_and(up) AS cvar_monotone, bool_and(ok) AS cvar_at_least_var, min(e) >= 0 AS excess_non_negative FROM (SELECT *, coalesce(m >= lag(m) OVER (ORDER BY confidence_level), true) AS up FROM b)""")
def cvar_table_checks(spark, sf):
    return compare.cvar_table_checks(historical_series(spark, sf).filter("horizon = 1"))


@query("cross_model_slices", "T13", """
    SELECT slice_type, slice, model, avg(hit_rate) AS mean_hit_rate, avg(violation_ratio) AS mean_violation_ratio, count(*) AS n FROM (
      SELECT slice_type, slice, KEYS, count(*) FILTER (WHERE violation) / count(*) AS hit_rate, count(*) FILTER (WHERE violation) / count(*) / (1 - confidence_level) AS violation_ratio FROM (
        SELECT *, 'year' AS slice_type, CAST(year(date) AS VARCHAR) AS slice FROM model_flagged UNION ALL SELECT *, 'quarter', year(date) || 'Q' || quarter(date) FROM model_flagged)
      GROUP BY slice_type, slice, KEYS) GROUP BY 1, 2, 3 HAVING count(*) >= 5""".replace("KEYS", KEYS_SQL), "mean_hit_rate mean_violation_ratio", 7)
def cross_model_slices(spark, sf):
    flagged = backtest.with_violations(model_series(spark, sf).drop("cvar"))
    return compare.slice_means(backtest.time_slices(flagged, MODEL_KEYS, ("year", "quarter")), ["hit_rate", "violation_ratio"], 5)


# --- portfolios and tools ----------------------------------------------------------------

cte("metric_table", "SELECT pm.*, hhi, effective_number, n_assets FROM pm JOIN structure USING (portfolio_id)")
METRICS = ["mean_return", "volatility", "sharpe_ratio", "max_drawdown", "conditional_value_at_risk"]


def metric_table(spark, sf):
    w = tables.weights(spark, sf)
    return materialise(portfolio.batch_metrics(w, simple_returns(spark, sf), periods=base.WEEKS).join(portfolio.structure(w), "portfolio_id"), "metrics")


@query("descriptive_statistics", "A2 A1", " UNION ALL ".join(f"""
    SELECT '{m}' AS metric, count({m}) AS count, avg({m}) AS mean, stddev_samp({m}) AS std, min({m}) AS min, max({m}) AS max, quantile_cont({m}, 5e-2) AS p05, quantile_cont({m}, 25e-2) AS p25,
           quantile_cont({m}, 5e-1) AS p50, quantile_cont({m}, 75e-2) AS p75, quantile_cont({m}, 95e-2) AS p95 FROM metric_table""" for m in METRICS), "mean std min max p05 p25 p50 p75 p95", 6)
def descriptive_statistics(spark, sf):
    long = materialise(compare.to_long(metric_table(spark, sf), ["portfolio_id"], METRICS), "long")
    return compare.summary(long, ["metric"], {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})


@query("configurable_summary", "A3", """
    SELECT n_assets, round(avg(sharpe_ratio), 6) AS sharpe_ratio_mean, round(stddev_samp(sharpe_ratio), 6) AS sharpe_ratio_std, round(avg(volatility), 6) AS volatility_mean, round(stddev_samp(volatility), 6) AS volatility_std
    FROM metric_table GROUP BY n_assets""", "sharpe_ratio_mean sharpe_ratio_std volatility_mean volatility_std", 5)
def configurable_summary(spark, sf):
    return compare.configurable_summary(metric_table(spark, sf), ["n_assets"], ["sharpe_ratio", "volatility"], ["mean", "std"], 6)


@query("run_summary", "A17", """
    SELECT count(*) AS n, avg(mean_return) AS avg_return, max(mean_return) AS max_return, avg(volatility) AS avg_volatility, min(volatility) AS min_volatility, avg(sharpe_ratio) AS avg_sharpe,
           max(sharpe_ratio) AS max_sharpe, avg(CASE WHEN jarque_bera_p_value < 5e-2 THEN 1e2 ELSE 0e0 END) AS normality_rejection_pct, corr(hhi, sharpe_ratio) AS corr_hhi_sharpe, corr(effective_number, volatility) AS corr_enc_volatility FROM metric_table""",
       "avg_return max_return avg_volatility min_volatility avg_sharpe max_sharpe normality_rejection_pct corr_hhi_sharpe corr_enc_volatility", 6)
def run_summary(spark, sf):
    return compare.run_summary(metric_table(spark, sf))


@query("structure_risk_relation", "A22", """
    SELECT CAST(greatest(0, least(9, floor((hhi - 1e-1) / (9e-1 / 10)))) AS INTEGER) AS bin, count(*) AS n, avg(hhi) AS mean_x, avg(conditional_value_at_risk) AS mean_y,
           (SELECT corr(hhi, conditional_value_at_risk) FROM metric_table) AS overall_corr FROM metric_table GROUP BY 1""", "mean_x mean_y overall_corr", 6)
def structure_risk_relation(spark, sf):
    return compare.binned_relation(metric_table(spark, sf), "hhi", "conditional_value_at_risk", 10, 0.1, 1.0)


@query("metric_correlations", "A23", " UNION ALL ".join(
    f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, corr({a}, {b}) AS corr FROM metric_table" for k, a in enumerate(METRICS) for b in METRICS[k:]), "corr", 6)
def metric_correlations(spark, sf):
    return compare.correlation_matrix(metric_table(spark, sf), METRICS)


@query("top_and_tail", "K1", """
    (SELECT portfolio_id, sharpe_ratio, 'top' AS side, CAST(row_number() OVER (ORDER BY sharpe_ratio DESC, portfolio_id) AS INTEGER) AS rank FROM metric_table ORDER BY sharpe_ratio DESC, portfolio_id LIMIT 10)
    UNION ALL (SELECT portfolio_id, sharpe_ratio, 'tail', CAST(row_number() OVER (ORDER BY sharpe_ratio, portfolio_id) AS INTEGER) FROM metric_table ORDER BY sharpe_ratio, portfolio_id LIMIT 10)""", "sharpe_ratio", 6)
def top_and_tail(spark, sf):
    return compare.top_and_tail(metric_table(spark, sf), "sharpe_ratio", 10)


RANKING = {"sharpe_ratio": (0.4, True), "volatility": (0.3, False), "max_drawdown": (0.3, False)}
cte("portfolio_rank", """
    SELECT portfolio_id, score, row_number() OVER (ORDER BY score DESC, portfolio_id) AS rank FROM (
      SELECT portfolio_id, round(4e-1 * (sharpe_ratio - min(sharpe_ratio) OVER ()) / (max(sharpe_ratio) OVER () - min(sharpe_ratio) OVER ()) + 3e-1 * (1 - (volatility - min(volatility) OVER ()) / (max(volatility) OVER () - min(volatility) OVER ()))
             + 3e-1 * (1 - (max_drawdown - min(max_drawdown) OVER ()) / (max(max_drawdown) OVER () - min(max_drawdown) OVER ())), 12) AS score FROM metric_table)""")


@query("composite_portfolio_ranking", "K4", "SELECT portfolio_id, score, rank FROM portfolio_rank WHERE rank <= 25", "score", 7)
def composite_portfolio_ranking(spark, sf):
    ranked, _ = compare.rank_portfolios(metric_table(spark, sf), RANKING)
    return ranked.filter("rank <= 25").select("portfolio_id", "score", "rank")


@query("score_at_percentiles", "K4", """
    SELECT CAST(p AS INTEGER) AS percentile, rank, score FROM portfolio_rank JOIN (VALUES (1), (5), (10)) AS t(p) ON rank = greatest(1, (SELECT count(*) FROM portfolio_rank) * p // 100)""", "score", 7)
def score_at_percentiles(spark, sf):
    return compare.rank_portfolios(metric_table(spark, sf), RANKING)[1]


@query("percentile_ranks", "K9", "SELECT c_custkey, percent_rank() OVER (ORDER BY c_acctbal) AS percent_rank FROM customer", "percent_rank")
def percentile_ranks(spark, sf):
    return percent_rank(tables.read(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "percent_rank")


@query("pareto_front", "K8", """
    SELECT portfolio_id, mean_return, volatility FROM metric_table a WHERE NOT EXISTS (
      SELECT 1 FROM metric_table b WHERE b.mean_return >= a.mean_return AND b.volatility <= a.volatility AND (b.mean_return > a.mean_return OR b.volatility < a.volatility))""", "mean_return volatility", 6)
def pareto_front(spark, sf):
    return compare.pareto_front_2d(metric_table(spark, sf), "mean_return", "volatility")


@query("pareto_front_three", "K8", """
    SELECT portfolio_id, mean_return, volatility, conditional_value_at_risk FROM metric_table a WHERE NOT EXISTS (
      SELECT 1 FROM metric_table b WHERE b.mean_return >= a.mean_return AND b.volatility <= a.volatility AND b.conditional_value_at_risk <= a.conditional_value_at_risk
        AND (b.mean_return > a.mean_return OR b.volatility < a.volatility OR b.conditional_value_at_risk < a.conditional_value_at_risk))""", "mean_return volatility conditional_value_at_risk", 6)
def pareto_front_three(spark, sf):
    return compare.pareto_front(metric_table(spark, sf), {"mean_return": True, "volatility": False, "conditional_value_at_risk": False})


_ROUNDED = ", ".join(["portfolio_id", "n"] + [f"round({c} + 1e-12, 9) AS {c}" for c in METRIC_COLUMNS.split(", ")[2:]])
cte("tools", f"SELECT 'baseline' AS tool_name, {_ROUNDED} FROM pm UNION ALL SELECT 'equal_weight', {_ROUNDED} FROM (" + metrics_sql("equal_pr", "portfolio_id") + ")")


def tool_table(spark, sf):
    """Metrics of every customer portfolio as held and with equal weights.

    Equal-weight twins of one asset set tie exactly; rounding keeps them tied.
    """
    w, r = tables.weights(spark, sf), simple_returns(spark, sf)
    both = compare.union_models({"baseline": portfolio.batch_metrics(w, r, periods=base.WEEKS), "equal_weight": portfolio.batch_metrics(portfolio.equal_weights(w), r, periods=base.WEEKS)})
    return materialise(round_doubles(both.withColumnRenamed("model", "tool_name"), 9), "tools")


@query("tool_summary", "A4", """
    SELECT tool_name, metric, count(*) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 5e-1) AS p50, quantile_cont(value, 75e-2) AS p75, quantile_cont(value, 95e-2) AS p95
    FROM (SELECT tool_name, 'sharpe_ratio' AS metric, sharpe_ratio AS value FROM tools UNION ALL SELECT tool_name, 'volatility', volatility FROM tools) WHERE value IS NOT NULL GROUP BY 1, 2""", "mean std min max p50 p75 p95", 6)
def tool_summary(spark, sf):
    long = materialise(compare.to_long(tool_table(spark, sf), ["tool_name"], ["sharpe_ratio", "volatility"]), "long")
    return compare.summary(long, ["tool_name", "metric"], {"p50": 0.5, "p75": 0.75, "p95": 0.95})


@query("top_k_per_tool", "K2", """
    SELECT * FROM (SELECT tool_name, portfolio_id, metric, value, CAST(row_number() OVER (PARTITION BY tool_name, metric ORDER BY o, portfolio_id) AS INTEGER) AS rank FROM (
      SELECT tool_name, portfolio_id, 'sharpe_ratio' AS metric, sharpe_ratio AS value, -sharpe_ratio AS o FROM tools UNION ALL SELECT tool_name, portfolio_id, 'volatility', volatility, volatility FROM tools) WHERE value IS NOT NULL) WHERE rank <= 5""", "value", 6)
def top_k_per_tool(spark, sf):
    return compare.top_k_per_tool(tool_table(spark, sf), {"sharpe_ratio": True, "volatility": False}, 5)


@query("quartile_dominance", "K8", """
    WITH q AS (SELECT tool_name, quantile_cont(mean_return, 75e-2) AS a, quantile_cont(volatility, 25e-2) AS b FROM tools GROUP BY 1)
    SELECT tool_name, count(*) AS n, count(*) FILTER (WHERE mean_return >= a AND volatility <= b) AS n_dominant, avg(CASE WHEN mean_return >= a AND volatility <= b THEN 1e2 ELSE 0e0 END) AS dominant_pct
    FROM tools JOIN q USING (tool_name) GROUP BY tool_name""", "dominant_pct")
def quartile_dominance(spark, sf):
    return compare.quartile_dominance(tool_table(spark, sf), {"mean_return": True, "volatility": False})


ALIASES = {"mean_return": ["expected_return", "mean_return"], "cvar": ["cvar", "conditional_value_at_risk"], "var": ["value_at_risk"], "max_drawdown": ["max_drawdown"]}
_HARMONISED = "SELECT tool_name, portfolio_id, mean_return, abs(conditional_value_at_risk) AS cvar, abs(value_at_risk) AS var, abs(max_drawdown) AS max_drawdown, mean_return / nullif(abs(conditional_value_at_risk), 0) AS return_over_cvar FROM tools"


def harmonised(spark, sf):
    return compare.harmonise(tool_table(spark, sf), ALIASES, ["cvar", "var", "max_drawdown"])


@query("harmonised_metrics", "P18", _HARMONISED, "mean_return cvar var max_drawdown return_over_cvar", 6)
def harmonised_metrics(spark, sf):
    return harmonised(spark, sf)


@query("tool_checks", "P20", f"""
    SELECT 'posterior' AS missing_tools, false AS coverage_complete, bool_and(coalesce(cvar >= 0, true) AND coalesce(max_drawdown >= 0, true)) AS signs_normalised FROM ({_HARMONISED})""")
def tool_checks(spark, sf):
    return compare.tool_checks(harmonised(spark, sf), ["baseline", "equal_weight", "posterior"])


@query("portfolio_table_checks", "P13", """
    SELECT count(*) AS portfolios, count(*) FILTER (WHERE abs(s - 1) > 1e-4) AS bad_weight_sums, count(*) FILTER (WHERE low < 0) AS negative_weights,
           (SELECT count(*) FROM pm WHERE volatility < 0) AS negative_volatility, (SELECT count(*) FROM pm WHERE max_drawdown < 0) AS negative_drawdown
    FROM (SELECT portfolio_id, sum(w) AS s, min(w) AS low FROM weights GROUP BY 1)""")
def portfolio_table_checks(spark, sf):
    w = tables.weights(spark, sf)
    return compare.portfolio_table_checks(w, portfolio.batch_metrics(w, simple_returns(spark, sf), periods=base.WEEKS))


@query("validity_gate", "P16", """
    SELECT user_id, count(value) AS n, CASE WHEN count(value) = 0 THEN 'empty' WHEN count(value) < 30 THEN 'fewer than 30 observations' ELSE 'ok' END AS reason, count(value) >= 30 AS valid FROM events GROUP BY user_id""")
def validity_gate(spark, sf):
    return compare.validity_gate(tables.read(spark, sf, "events").select("user_id", F.col("value").alias("r")), "user_id", 30)


@query("metric_completeness", "P17", f"""
    SELECT portfolio_id, CAST(3 - n_missing AS INTEGER) AS present, CAST(n_missing AS INTEGER) AS n_missing, missing_names FROM (
      SELECT portfolio_id, (n_positive IS NULL)::INT + (sortino_ratio IS NULL)::INT + (calmar_ratio IS NULL)::INT AS n_missing,
             concat_ws(',', CASE WHEN n_positive IS NULL THEN 'n_positive' END, CASE WHEN sortino_ratio IS NULL THEN 'sortino_ratio' END, CASE WHEN calmar_ratio IS NULL THEN 'calmar_ratio' END) AS missing_names
      FROM (SELECT *, CASE WHEN mean_return > 0 THEN mean_return END AS n_positive FROM pm))""")
def metric_completeness(spark, sf):
    m = portfolio.batch_metrics(tables.weights(spark, sf), simple_returns(spark, sf), periods=base.WEEKS).withColumn("n_positive", F.when(F.col("mean_return") > 0, F.col("mean_return")))
    return compare.completeness_audit(m, "portfolio_id", ["n_positive", "sortino_ratio", "calmar_ratio"])


# --- sampling ----------------------------------------------------------------------------

cte("strata_base", """
    SELECT portfolio_id, s.n_assets, e.v AS equal_weight_volatility, 1e0 / s.n_assets AS equal_weight_hhi FROM structure s JOIN (
      SELECT portfolio_id, stddev_samp(r) * sqrt(52) AS v FROM equal_pr GROUP BY portfolio_id) e USING (portfolio_id)""")
cte("strata", """
    SELECT portfolio_id, n_assets, count_bin, vol_bin, hhi_bin, concat_ws('_', count_bin, vol_bin, hhi_bin) AS stratum FROM (
      SELECT *, CASE WHEN n_assets <= 3 THEN 'assets_3' WHEN n_assets <= 5 THEN 'assets_5' WHEN n_assets <= 7 THEN 'assets_7' WHEN n_assets <= 10 THEN 'assets_10' ELSE 'assets_10_plus' END AS count_bin,
             CASE WHEN v <= v1 THEN 'low' WHEN v <= v2 THEN 'medium' ELSE 'high' END AS vol_bin, CASE WHEN h <= h1 THEN 'diversified' WHEN h <= h2 THEN 'moderate' ELSE 'concentrated' END AS hhi_bin
      FROM (SELECT *, round(equal_weight_volatility, 9) AS v, round(equal_weight_hhi, 9) AS h FROM strata_base) CROSS JOIN (
        SELECT quantile_cont(round(equal_weight_volatility, 9), 33e-2) AS v1, quantile_cont(round(equal_weight_volatility, 9), 66e-2) AS v2,
               quantile_cont(round(equal_weight_hhi, 9), 33e-2) AS h1, quantile_cont(round(equal_weight_hhi, 9), 66e-2) AS h2 FROM strata_base))""")


def strata(spark, sf):
    """Portfolios with the volatility and concentration of their equal-weight twin, worked out once per asset set."""
    sets = portfolio.asset_sets(tables.weights(spark, sf), 0.0)
    d_ = portfolio.set_dictionary(sets)
    eq = d_.select(F.col("set_id").alias("portfolio_id"), F.explode("assets").alias("asset"), (1.0 / F.col("n_assets")).alias("w"))
    vol = portfolio.batch_metrics(eq, simple_returns(spark, sf), periods=base.WEEKS).select(F.col("portfolio_id").alias("set_id"), F.round("volatility", 9).alias("equal_weight_volatility"))
    per_set = d_.select("set_id", "n_assets", F.round(1.0 / F.col("n_assets"), 9).alias("equal_weight_hhi")).join(vol, "set_id")
    p = sets.select("portfolio_id", "set_id").join(materialise(per_set, "sets"), "set_id").drop("set_id")
    return materialise(sampling.stratify(materialise(p, "portfolios")), "strata")


@query("stratified_portfolios", "SM1", "SELECT portfolio_id, n_assets, count_bin, vol_bin AS equal_weight_volatility_bin, hhi_bin AS equal_weight_hhi_bin, stratum FROM strata")
def stratified_portfolios(spark, sf):
    return strata(spark, sf).select("portfolio_id", F.col("n_assets").cast("long").alias("n_assets"), "count_bin", "equal_weight_volatility_bin", "equal_weight_hhi_bin", "stratum")


@query("stratified_sample", "SM2 J12 S3", """
    WITH u AS (SELECT *, (CAST('0x' || substr(md5(concat_ws('|', '42', CAST(portfolio_id AS VARCHAR))), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0 AS u FROM strata),
    m AS (SELECT portfolio_id, stratum, 'stratum' AS how FROM u QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY u, portfolio_id) <= floor(count(*) OVER (PARTITION BY stratum) * 200 / (SELECT count(*) FROM u))),
    t AS (SELECT portfolio_id, stratum, 'top_up' AS how FROM u WHERE portfolio_id NOT IN (SELECT portfolio_id FROM m) ORDER BY u, portfolio_id LIMIT (200 - (SELECT count(*) FROM m)))
    SELECT * FROM m UNION ALL SELECT * FROM t""")
def stratified_sample(spark, sf):
    return sampling.stratified_sample(strata(spark, sf), 200).select("portfolio_id", "stratum", "how")


def _sample_sql(name: str, source: str, n: int, seed: int) -> None:
    """Declare ``name``: a proportional draw of ``n`` rows of ``source`` by stratum, topped up to ``n``."""
    cte(f"{name}_u", f"SELECT *, (CAST('0x' || substr(md5(concat_ws('|', '{seed}', CAST(portfolio_id AS VARCHAR))), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0 AS u FROM {source}")
    cte(f"{name}_m", f"SELECT * FROM {name}_u QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY u, portfolio_id) <= floor(count(*) OVER (PARTITION BY stratum) * {n} / (SELECT count(*) FROM {name}_u))")
    cte(f"{name}_t", f"SELECT * FROM {name}_u WHERE portfolio_id NOT IN (SELECT portfolio_id FROM {name}_m) ORDER BY u, portfolio_id LIMIT ({n} - (SELECT count(*) FROM {name}_m))")
    cte(name, f"SELECT portfolio_id, stratum FROM {name}_m UNION ALL SELECT portfolio_id, stratum FROM {name}_t")


_sample_sql("study_main", "strata", 100, 42)
cte("study_rest", "SELECT * FROM strata WHERE portfolio_id NOT IN (SELECT portfolio_id FROM study_main)")
_sample_sql("study_robust", "study_rest", 50, 43)
cte("study_left", "SELECT * FROM study_rest WHERE portfolio_id NOT IN (SELECT portfolio_id FROM study_robust)")
_sample_sql("study_convergence", "study_left", 50, 44)


@query("study_samples", "SM3 J12", """
    WITH v AS (SELECT portfolio_id, stratum, round(b.equal_weight_volatility, 9) AS vol FROM strata JOIN strata_base b USING (portfolio_id)),
    edge AS (SELECT * FROM (SELECT portfolio_id, stratum FROM v ORDER BY vol DESC, portfolio_id LIMIT 10) UNION SELECT * FROM (SELECT portfolio_id, stratum FROM v ORDER BY vol, portfolio_id LIMIT 10))
    SELECT *, 'main' AS role FROM study_main UNION ALL SELECT *, 'robustness' FROM study_robust UNION ALL SELECT *, 'convergence' FROM study_convergence UNION ALL SELECT *, 'extreme' FROM edge""")
def study_samples(spark, sf):
    return sampling.study_samples(strata(spark, sf), 100, 50, 50, 10)


_POISSON = []
_p, _acc = 2.718281828459045 ** -1, 0.0
for _k in range(7):
    _acc += _p
    _POISSON.append(_acc)
    _p /= _k + 1
_COUNT = " + ".join(f"CASE WHEN u > {d(c)} THEN 1 ELSE 0 END" for c in _POISSON)
cte("block_pairs", """
    SELECT pos, max(v) FILTER (WHERE blk = 0) AS v0, max(v) FILTER (WHERE blk = 1) AS v1, max(k) FILTER (WHERE blk = 0) AS k0, max(k) FILTER (WHERE blk = 1) AS k1 FROM (
      SELECT *, rank() OVER (PARTITION BY blk ORDER BY v) + (count(*) OVER (PARTITION BY blk, v) - 1) / 2e0 AS k FROM (
        SELECT *, CASE WHEN back <= 500 THEN 1 ELSE 0 END AS blk, (back - 1) % 500 AS pos FROM (
          SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_orderkey DESC) AS back FROM orders) WHERE back <= 1000)) GROUP BY pos""")


@query("convergence", "SM4 W15", f"""
    SELECT relative_change, width_fraction, rank_stability, relative_change <= 2e-2 AS mean_stable, width_fraction <= 1e-1 AS interval_narrow, rank_stability >= 95e-2 AS ranks_stable FROM (
      SELECT abs(avg(v1) - avg(v0)) / abs(avg(v0)) AS relative_change, corr(k0, k1) AS rank_stability FROM block_pairs) CROSS JOIN (
      SELECT (quantile_cont(m, 975e-3) - quantile_cont(m, 25e-3)) / abs(avg(m)) AS width_fraction FROM (
        SELECT b, sum(({_COUNT}) * o_totalprice) / sum({_COUNT}) AS m FROM (
          SELECT o_totalprice, b, (CAST('0x' || substr(md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR), CAST(b AS VARCHAR))), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0 AS u
          FROM orders CROSS JOIN (SELECT unnest(range(1, 201)) AS b)) GROUP BY b))""", "relative_change width_fraction rank_stability", 6)
def convergence(spark, sf):
    return sampling.convergence(materialise(tables.read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "orders"), "o_orderkey", "o_totalprice", 500)


@query("remaining_portfolios", "J12 S3", "SELECT portfolio_id FROM structure WHERE portfolio_id NOT IN (SELECT portfolio_id FROM structure WHERE n_assets <= 8)")
def remaining_portfolios(spark, sf):
    s = portfolio.structure(tables.weights(spark, sf)).select("portfolio_id", "n_assets")
    return s.join(s.filter("n_assets <= 8"), "portfolio_id", "left_anti").select("portfolio_id")
