"""Queries for panel preparation, returns and rolling estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import panel, rolling
from riskloom.plans import base
from riskloom.plans.base import WEEKS, log_returns, prices, simple_returns
from riskloom.plans.registry import cte, query
from riskloom.sources import tables
from riskloom.sources.portfolios import universe_array

EXCLUDED = ["A3", "A7"]


@query("asset_universe", "P1", "SELECT asset, count(*) AS n, avg(r) AS mean FROM log_returns WHERE asset NOT IN ('A3', 'A7') GROUP BY asset", "mean")
def asset_universe(spark, sf):
    return panel.asset_universe(log_returns(spark, sf), exclude=EXCLUDED).groupBy("asset").agg(F.count("*").alias("n"), F.avg("r").alias("mean"))


@query("min_observations", "P2 P10", """
    WITH p AS (SELECT asset, date, ln(price / lag(price) OVER (PARTITION BY asset ORDER BY date)) AS r FROM raw_prices_day)
    SELECT asset, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM p
    WHERE r IS NOT NULL AND asset IN (SELECT asset FROM p GROUP BY asset HAVING count(r) >= 800) GROUP BY asset""")
def min_observations(spark, sf):
    r = rolling.returns(tables.prices(spark, sf, "day"))
    return panel.min_observations(r, 800).groupBy("asset").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("top_variance_assets", "P3", """
    SELECT asset, date, r FROM log_returns WHERE asset IN (SELECT asset FROM log_returns GROUP BY asset ORDER BY var_samp(r) DESC, asset LIMIT 4)""", "r")
def top_variance_assets(spark, sf):
    return panel.top_variance_assets(log_returns(spark, sf), 4)


@query("parse_dates", "P4", """
    SELECT event_id, CAST(ts AS DATE) AS date, value FROM events WHERE CAST(ts AS DATE) IS NOT NULL AND event_id % 10 <> 3""", "value", 4)
def parse_dates(spark, sf):
    # Every tenth date is spelled in a way that does not parse, as in a dirty file.
    e = tables.read(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 10 == 3, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"), "value"
    )
    return panel.parse_dates(e)


cte("grid", """
    SELECT a.asset, c.date, p.price FROM (SELECT DISTINCT date FROM raw_prices_day) c CROSS JOIN (SELECT DISTINCT asset FROM raw_prices_day) a
    LEFT JOIN raw_prices_day p ON p.asset = a.asset AND p.date = c.date""")


def daily_grid(spark, sf):
    p = tables.prices(spark, sf, "day")
    return panel.calendar_grid(p, universe_array(p))


def _fill_sql(position: str) -> str:
    return f"""
    WITH g AS (SELECT *, {position} AS x FROM grid),
    s AS (SELECT *, last_value(CASE WHEN price IS NOT NULL THEN x END IGNORE NULLS) OVER b AS x0, last_value(price IGNORE NULLS) OVER b AS v0,
                 first_value(CASE WHEN price IS NOT NULL THEN x END IGNORE NULLS) OVER a AS x1, first_value(price IGNORE NULLS) OVER a AS v1
          FROM g WINDOW b AS (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                        a AS (PARTITION BY asset ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT asset, date, CASE WHEN price IS NOT NULL THEN price WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL THEN v0
                             ELSE v0 + (v1 - v0) * (x - x0) / (x1 - x0) END AS price FROM s"""


@query("fill_time", "P5", _fill_sql("date_diff('day', DATE '1970-01-01', date)::DOUBLE"), "price")
def fill_time(spark, sf):
    return panel.fill_time(daily_grid(spark, sf)).select("asset", "date", "price")


@query("fill_linear", "P6", _fill_sql("(row_number() OVER (PARTITION BY asset ORDER BY date))::DOUBLE"), "price")
def fill_linear(spark, sf):
    return panel.fill_linear(daily_grid(spark, sf)).select("asset", "date", "price")


@query("fill_forward_backward", "P7", """
    SELECT asset, date, last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forward,
           first_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM grid""", "forward backward")
def fill_forward_backward(spark, sf):
    g = daily_grid(spark, sf).withColumn("forward", F.col("price")).withColumnRenamed("price", "backward")
    return panel.fill_backward(panel.fill_forward(g, "forward"), "backward").select("asset", "date", "forward", "backward")


@query("trading_day_alignment", "P8 J1 S2", "SELECT asset, date, price FROM prices_day", "price")
def trading_day_alignment(spark, sf):
    return panel.complete_dates(tables.prices(spark, sf, "day"), "price")


@query("validate_panel", "P9", """
    SELECT asset, (SELECT count(DISTINCT date) FROM ohlcv) - count(DISTINCT date) AS missing_dates,
           count(*) FILTER (WHERE open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS null_rows,
           count(*) FILTER (WHERE open < 0 OR high < 0 OR low < 0 OR close < 0) AS negative_prices, count(*) FILTER (WHERE volume < 0) AS negative_volumes,
           count(*) FILTER (WHERE high < low) AS high_below_low,
           count(*) FILTER (WHERE close > high OR close < low OR open > high OR open < low) AS outside_range FROM ohlcv GROUP BY asset""")
def validate_panel(spark, sf):
    o = tables.ohlcv(spark, sf)
    return panel.validate_panel(o, universe_array(o))


@query("drop_missing", "P10", """
    WITH p AS (SELECT asset, date, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM grid)
    SELECT 'any' AS how, asset, date, r FROM p WHERE date IN (SELECT date FROM p GROUP BY date HAVING count(r) = (SELECT count(DISTINCT asset) FROM p WHERE r IS NOT NULL))
    UNION ALL SELECT 'all', asset, date, r FROM p WHERE date IN (SELECT date FROM p WHERE r IS NOT NULL)
    UNION ALL SELECT 'asset', asset, date, r FROM p WHERE r IS NOT NULL""", "r")
def drop_missing(spark, sf):
    g = daily_grid(spark, sf)
    r = g.withColumn("r", F.col("price") / F.lag("price").over(panel.by_asset()) - 1).select("asset", "date", "r")
    out = None
    for how in ("any", "all", "asset"):
        part = panel.drop_missing(r, "r", how).select(F.lit(how).alias("how"), "asset", "date", "r")
        out = part if out is None else out.unionByName(part)
    return out


@query("log_and_simple_returns", "W1", """
    SELECT asset, date, log_returns.r AS log_return, simple_returns.r AS simple_return FROM log_returns JOIN simple_returns USING (asset, date)""", "log_return simple_return")
def log_and_simple_returns(spark, sf):
    # Both kinds come from one pass over the same window.
    both = prices(spark, sf).withColumn("prev", F.lag("price").over(rolling.by_asset())).filter("prev IS NOT NULL")
    return both.select("asset", "date", F.log(F.col("price") / F.col("prev")).alias("log_return"), (F.col("price") / F.col("prev") - 1).alias("simple_return"))


@query("rolling_moments", "W2", """
    SELECT asset, date, 26 AS estimation_window, avg(r) OVER f AS mu, stddev_pop(r) OVER f AS sigma FROM
      (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn FROM log_returns)
    WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) QUALIFY rn >= 26 AND (rn - 26) % 5 = 0""", "mu sigma")
def rolling_moments(spark, sf):
    m = rolling.rolling_moments(log_returns(spark, sf), [26], population=True, step=5)
    return m.select("asset", "date", "estimation_window", "mu", "sigma")


@query("annualised_mean_last_window", "W3 F12 FAC6", """
    SELECT asset, avg(r) * 52 AS mu, max(date) AS date FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS back FROM simple_returns)
    WHERE back <= 52 GROUP BY asset""", "mu")
def annualised_mean_last_window(spark, sf):
    return rolling.annualised_mean_last(simple_returns(spark, sf), 52, WEEKS)


@query("rolling_loss_quantile", "W4", """
    SELECT asset, date, -r AS loss, quantile_cont(-r, 95e-2) OVER f AS threshold FROM log_returns
    WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER f = 52""", "loss threshold")
def rolling_loss_quantile(spark, sf):
    losses = log_returns(spark, sf).select("asset", "date", (-F.col("r")).alias("loss"))
    return rolling.rolling_quantile(losses, 52, 0.95)


@query("rolling_covariance_correlation", "W5 J9", """
    SELECT a.date, a.asset AS i, b.asset AS j, covar_samp(a.r, b.r) OVER f AS cov, corr(a.r, b.r) OVER f AS corr
    FROM simple_returns a JOIN simple_returns b ON a.date = b.date AND a.asset <= b.asset
    WINDOW f AS (PARTITION BY a.asset, b.asset ORDER BY a.date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER f = 52""", "cov corr")
def rolling_covariance_correlation(spark, sf):
    return rolling.rolling_pair_stats(simple_returns(spark, sf), 52)


cte("ranked_returns", "SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn FROM log_returns")
cte("ewma_members", """
    SELECT e.asset, e.date, e.rn, e.r AS current, m.r, m.rn - (e.rn - 52) AS k FROM ranked_returns e
    JOIN ranked_returns m ON m.asset = e.asset AND m.rn > e.rn - 52 AND m.rn <= e.rn WHERE e.rn >= 52""")
cte("ewma_forecast", """
    SELECT asset, date, rn, any_value(current) AS r, sum(CASE WHEN k = 1 THEN pow(94e-2, 52) ELSE 0e0 END * r * r + 6e-2 * pow(94e-2, 52 - k) * r * r) AS v
    FROM ewma_members GROUP BY asset, date, rn""")


@query("ewma_variance", "W6", "SELECT asset, date, v * 1e4 AS next_variance_bp, sqrt(greatest(v, 1e-12)) AS next_sigma FROM ewma_forecast", "next_variance_bp next_sigma")
def ewma_variance(spark, sf):
    w = rolling.window_arrays(log_returns(spark, sf), 52)
    v = rolling.ewma_next_variance(F.col("w"), 0.94)
    return w.select("asset", "date", v.alias("v")).select("asset", "date", (F.col("v") * 1e4).alias("next_variance_bp"), F.sqrt(F.greatest("v", F.lit(1e-12))).alias("next_sigma"))


@query("standardised_residuals", "W7", """
    WITH RECURSIVE tail AS (SELECT asset, r, row_number() OVER (PARTITION BY asset ORDER BY date) AS k FROM
        (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS back FROM log_returns) WHERE back <= 52),
    scan(asset, k, s, r) AS (SELECT asset, k, r * r, r FROM tail WHERE k = 1
        UNION ALL SELECT t.asset, t.k, 94e-2 * scan.s + 6e-2 * scan.r * scan.r, t.r FROM scan JOIN tail t ON t.asset = scan.asset AND t.k = scan.k + 1)
    SELECT asset, CAST(k - 1 AS INTEGER) AS pos, (r - m) / (sqrt(greatest(s, 1e-12)) + 1e-10) AS z FROM scan JOIN (SELECT asset, avg(r) AS m FROM tail GROUP BY asset) USING (asset)""", "z", 6)
def standardised_residuals(spark, sf):
    from riskloom.functions.columns import array_mean

    w = rolling.latest_per_key(rolling.window_arrays(log_returns(spark, sf), 52), ["asset"])
    w = w.withColumn("v", rolling.ewma_variances(F.col("w"), 0.94)).withColumn("m", array_mean(F.col("w")))
    return w.select("asset", F.posexplode(rolling.standardised_residuals(F.col("w"), F.col("v"), F.col("m"))).alias("pos", "z"))


@query("drawdown_series", "W8", """
    WITH g AS (SELECT asset, date, r, exp(sum(ln(1 + r)) OVER (PARTITION BY asset ORDER BY date)) AS growth FROM simple_returns),
    p AS (SELECT *, max(growth) OVER (PARTITION BY asset ORDER BY date) AS peak FROM g)
    SELECT asset, date, r, growth, peak, growth / peak - 1 AS drawdown FROM p""", "r growth peak drawdown")
def drawdown_series(spark, sf):
    return rolling.drawdown_series(simple_returns(spark, sf))


@query("longest_negative_run", "W10", """
    WITH s AS (SELECT asset, date, r < 0 AS neg, row_number() OVER (PARTITION BY asset ORDER BY date) - row_number() OVER (PARTITION BY asset, r < 0 ORDER BY date) AS island FROM simple_returns),
    runs AS (SELECT asset, neg, island, count(*) AS len FROM s GROUP BY ALL)
    SELECT asset, coalesce(max(len) FILTER (WHERE neg), 0) AS longest_negative_run FROM runs GROUP BY asset""")
def longest_negative_run(spark, sf):
    return rolling.longest_negative_run(simple_returns(spark, sf), ["asset"], "date", "r")


@query("squared_return_autocorrelation", "W11", " UNION ALL ".join(
    f"SELECT asset, {k} AS lag, corr(sq, l) AS acf FROM (SELECT asset, r * r AS sq, lag(r * r, {k}) OVER (PARTITION BY asset ORDER BY date) AS l FROM simple_returns) GROUP BY asset"
    for k in range(1, 6)), "acf", 6)
def squared_return_autocorrelation(spark, sf):
    return rolling.squared_autocorrelation(simple_returns(spark, sf))


@query("latest_row_per_key", "W14 S6", """
    SELECT asset, estimation_window, date, mu, sigma FROM moments QUALIFY row_number() OVER (PARTITION BY asset, estimation_window ORDER BY date DESC) = 1""", "mu sigma")
def latest_row_per_key(spark, sf):
    m = rolling.rolling_moments(log_returns(spark, sf), base.WINDOWS).select("asset", "estimation_window", "date", "mu", "sigma")
    return rolling.latest_per_key(m, ["asset", "estimation_window"])


@query("block_stability", "W15", """
    WITH t AS (SELECT o_orderkey, o_totalprice AS v, row_number() OVER (ORDER BY o_orderkey DESC) AS back FROM orders),
    b AS (SELECT *, CASE WHEN back <= 500 THEN 1 ELSE 0 END AS blk, (back - 1) % 500 AS pos FROM t WHERE back <= 1000),
    r AS (SELECT *, rank() OVER (PARTITION BY blk ORDER BY v) + (count(*) OVER (PARTITION BY blk, v) - 1) / 2e0 AS k FROM b),
    p AS (SELECT pos, max(v) FILTER (WHERE blk = 0) AS v0, max(v) FILTER (WHERE blk = 1) AS v1, max(k) FILTER (WHERE blk = 0) AS k0, max(k) FILTER (WHERE blk = 1) AS k1 FROM r GROUP BY pos)
    SELECT avg(v0) AS mean_previous, avg(v1) AS mean_last, abs(avg(v1) - avg(v0)) / abs(avg(v0)) AS relative_change, corr(k0, k1) AS rank_stability FROM p""",
    "mean_previous mean_last relative_change rank_stability", 6)
def block_stability(spark, sf):
    return rolling.block_stability(tables.read(spark, sf, "orders"), "o_orderkey", "o_totalprice", 500)
