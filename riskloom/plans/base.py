"""Shared inputs of the registered queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.functions import constants as K
from riskloom.operators import backtest, panel, risk, rolling
from riskloom.plans.registry import cte
from riskloom.sources import tables

WINDOWS = [26, 52]
CONFIDENCE = [0.95, 0.99]
HORIZONS = [1, 10]
WEEKS = 52  # periods per year of weekly returns


def d(x: float) -> str:
    """A SQL literal of type DOUBLE."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def normal_values() -> str:
    rows = [f"({d(c)}, {h}, {d(K.normal_quantile(1 - c))}, {d(K.es_factor_normal(c))})" for c in CONFIDENCE for h in HORIZONS]
    return f"(VALUES {', '.join(rows)}) AS cfg(confidence_level, horizon, z, es)"


def prices(spark: SparkSession, sf: str, grain: str = "week") -> DataFrame:
    return panel.complete_dates(tables.prices(spark, sf, grain), "price")


def log_returns(spark: SparkSession, sf: str, grain: str = "week") -> DataFrame:
    return rolling.returns(prices(spark, sf, grain), "log")


def simple_returns(spark: SparkSession, sf: str, grain: str = "week") -> DataFrame:
    return rolling.returns(prices(spark, sf, grain), "simple")


def varcov_series(spark: SparkSession, sf: str, rets: DataFrame | None = None) -> DataFrame:
    return risk.parametric_var_series(log_returns(spark, sf) if rets is None else rets, WINDOWS, CONFIDENCE, HORIZONS)


def varcov_flagged(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.with_violations(varcov_series(spark, sf))


for grain in ("week", "day"):
    suffix = "" if grain == "week" else "_day"
    cte(f"raw_prices{suffix}", f"""
        SELECT 'A' || CAST(l_suppkey % 10 AS VARCHAR) AS asset, CAST(date_trunc('{grain}', l_shipdate) AS DATE) AS date,
               sum(l_extendedprice) / sum(l_quantity) AS price
        FROM lineitem GROUP BY 1, 2""")
    cte(f"prices{suffix}", f"""
        SELECT * FROM raw_prices{suffix} WHERE date IN (
          SELECT date FROM raw_prices{suffix} GROUP BY date
          HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM raw_prices{suffix}))""")
    cte(f"log_returns{suffix}", f"""
        SELECT asset, date, r FROM (
          SELECT asset, date, ln(price / lag(price) OVER (PARTITION BY asset ORDER BY date)) AS r FROM prices{suffix}) WHERE r IS NOT NULL""")
    cte(f"simple_returns{suffix}", f"""
        SELECT asset, date, r FROM (
          SELECT asset, date, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM prices{suffix}) WHERE r IS NOT NULL""")

cte("ohlcv", """
    SELECT 'A' || CAST(l_suppkey % 10 AS VARCHAR) AS asset, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
           arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
           max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
           arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close, sum(l_quantity) AS volume
    FROM lineitem GROUP BY 1, 2""")
cte("spend", """
    SELECT o_custkey AS portfolio_id, 'A' || CAST(l_suppkey % 10 AS VARCHAR) AS asset, sum(l_extendedprice) AS spend
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
cte("weights", "SELECT portfolio_id, asset, spend / sum(spend) OVER (PARTITION BY portfolio_id) AS w FROM spend")
cte("market", """
    SELECT asset, spend / sum(spend) OVER () AS w FROM (
      SELECT 'A' || CAST(l_suppkey % 10 AS VARCHAR) AS asset, sum(l_extendedprice) AS spend FROM lineitem GROUP BY 1)""")

_moments = " UNION ALL ".join(
    f"SELECT asset, date, r, {w} AS estimation_window, count(r) OVER f AS n, avg(r) OVER f AS mu, stddev_samp(r) OVER f AS sigma "
    f"FROM log_returns WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in WINDOWS)
cte("moments", f"SELECT * FROM ({_moments}) WHERE n >= estimation_window")
cte("varcov", f"""
    SELECT asset, date, r, estimation_window, confidence_level, horizon,
           CASE WHEN sigma > 0 THEN greatest(0e0, -(mu + z * sigma)) * sqrt(horizon) END AS var
    FROM moments CROSS JOIN {normal_values()}""")
cte("flagged", "SELECT *, -r AS loss, -r > var AS violation FROM varcov WHERE var > 0")


# The same series on daily prices with yearly and two-yearly windows.
DAILY_WINDOWS = [252, 500]
_moments_day = " UNION ALL ".join(
    f"SELECT asset, date, r, {w} AS estimation_window, count(r) OVER f AS n, avg(r) OVER f AS mu, stddev_samp(r) OVER f AS sigma "
    f"FROM log_returns_day WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in DAILY_WINDOWS)
cte("moments_day", f"SELECT * FROM ({_moments_day}) WHERE n >= estimation_window")
cte("varcov_day", f"""
    SELECT asset, date, r, estimation_window, confidence_level, horizon,
           CASE WHEN sigma > 0 THEN greatest(0e0, -(mu + z * sigma)) * sqrt(horizon) END AS var
    FROM moments_day CROSS JOIN {normal_values()}""")
cte("flagged_day", "SELECT *, -r AS loss, -r > var AS violation FROM varcov_day WHERE var > 0")


def daily_flagged(spark: SparkSession, sf: str) -> DataFrame:
    series = risk.parametric_var_series(log_returns(spark, sf, "day"), DAILY_WINDOWS, CONFIDENCE, HORIZONS)
    return backtest.with_violations(series)


def accuracy_sql(source: str, keys: str) -> str:
    """SQL of the accuracy bundle over ``source`` grouped by ``keys``."""
    xlogy = lambda x, y: f"CASE WHEN {x} = 0 THEN 0e0 ELSE {x} * ln({y}) END"
    from riskloom.functions.columns import ERFC_COEFFICIENTS

    def erfc(x: str) -> str:
        t = f"(1e0 / (1e0 + 5e-1 * {x}))"
        poly = d(ERFC_COEFFICIENTS[-1])
        for c in reversed(ERFC_COEFFICIENTS[:-1]):
            poly = f"({d(c)} + {t} * {poly})"
        return f"({t} * exp(-{x} * {x} + {poly}))"

    def p1(stat: str) -> str:
        return f"CASE WHEN {stat} IS NOT NULL THEN least(1e0, {erfc(f'sqrt(greatest({stat}, 0e0) / 2e0)')}) END"

    return f"""
    SELECT *, {p1('kupiec_statistic')} AS kupiec_p_value, kupiec_statistic > {d(K.CHI2_CRITICAL_1)} AS kupiec_reject,
           {p1('independence_statistic')} AS independence_p_value,
           coalesce(independence_statistic > {d(K.CHI2_CRITICAL_1)}, false) AS independence_reject,
           CASE WHEN conditional_coverage_statistic IS NOT NULL THEN exp(-greatest(conditional_coverage_statistic, 0e0) / 2e0) END AS conditional_coverage_p_value,
           coalesce(conditional_coverage_statistic > {d(K.CHI2_CRITICAL_2)}, false) AS conditional_coverage_reject,
           CASE WHEN num_violations <= green * total_observations / 250e0 THEN 'green'
                WHEN num_violations <= yellow * total_observations / 250e0 THEN 'yellow' ELSE 'red' END AS traffic_light_zone
    FROM (SELECT *, kupiec_statistic + independence_statistic AS conditional_coverage_statistic FROM (
    SELECT *, total_observations * p AS expected_violations, num_violations / total_observations AS hit_rate,
           num_violations / total_observations / p AS violation_ratio,
           CASE WHEN 250 * p < 5 THEN 4 ELSE floor(250 * p * 16e-1 + 1e-9) END AS green,
           CASE WHEN 250 * p < 5 THEN 9 ELSE floor(250 * p * 24e-1 + 1e-9) END AS yellow,
           -2e0 * ({xlogy('num_violations', 'p')} + {xlogy('(total_observations - num_violations)', '(1 - p)')}
             - {xlogy('num_violations', '(num_violations / total_observations)')}
             - {xlogy('(total_observations - num_violations)', '((total_observations - num_violations) / total_observations)')}) AS kupiec_statistic,
           CASE WHEN n00 + n01 > 0 AND n10 + n11 > 0 THEN -2e0 * (
             {xlogy('(n01 + n11)', '((n01 + n11) / (n00 + n01 + n10 + n11))')} + {xlogy('(n00 + n10)', '(1 - (n01 + n11) / (n00 + n01 + n10 + n11))')}
             - {xlogy('n01', '(n01 / (n00 + n01))')} - {xlogy('n00', '(n00 / (n00 + n01))')}
             - {xlogy('n11', '(n11 / (n10 + n11))')} - {xlogy('n10', '(n10 / (n10 + n11))')}) END AS independence_statistic
    FROM (
      SELECT {keys}, 1 - confidence_level AS p, count(*) AS total_observations, count(*) FILTER (WHERE violation) AS num_violations,
             count(*) FILTER (WHERE NOT prev AND NOT violation) AS n00, count(*) FILTER (WHERE NOT prev AND violation) AS n01,
             count(*) FILTER (WHERE prev AND NOT violation) AS n10, count(*) FILTER (WHERE prev AND violation) AS n11
      FROM (SELECT *, lag(violation) OVER (PARTITION BY {keys} ORDER BY date) AS prev FROM {source})
      GROUP BY {keys})))"""


KEYS = "asset, confidence_level, horizon, estimation_window"
cte("accuracy", f"SELECT * EXCLUDE (p, green, yellow) FROM ({accuracy_sql('flagged', KEYS)})")
cte("accuracy_day", f"SELECT * EXCLUDE (p, green, yellow) FROM ({accuracy_sql('flagged_day', KEYS)})")
ACCURACY_DOUBLES = (
    "confidence_level expected_violations hit_rate violation_ratio kupiec_statistic independence_statistic "
    "conditional_coverage_statistic kupiec_p_value independence_p_value conditional_coverage_p_value"
)
