"""Queries that write derived tables to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import panel
from riskloom.plans import base
from riskloom.plans.registry import query
from riskloom.session import new_path
from riskloom.sources import portfolios as src
from riskloom.sources import prices, sinks, tables

BY_FOLDER = r"asset=([^/]+)/"
OHLCV = "open high low close volume"


def ohlcv_files(spark, sf) -> str:
    """Per-symbol csv files in the column order of the raw source, each under header rows of text."""
    path = new_path(spark, "csv")
    o = tables.ohlcv(spark, sf).select("asset", F.date_format("date", "yyyy-MM-dd").alias("date"), "close", "high", "low", "open", "volume")
    text = o.select("asset", "date", *[F.col(c).cast("string").alias(c) for c in ("close", "high", "low", "open", "volume")])
    header = o.select("asset").distinct().select(
        "asset", F.explode(F.array(F.lit("Price"), F.lit("Ticker"), F.lit("Date"))).alias("date"),
        *[F.lit(c).alias(c) for c in ("Close", "High", "Low", "Open", "Volume")])
    sinks.write_per_symbol(header.toDF(*text.columns).unionByName(text), path)
    return path


@query("price_files", "IO1 IO2 IO3 IO7 D1", "SELECT asset, date, open, high, low, close, volume FROM ohlcv", OHLCV, 6)
def price_files(spark, sf):
    return prices.load_prices_csv(spark, ohlcv_files(spark, sf), BY_FOLDER)


@query("selected_price_files", "IO2", "SELECT asset, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM ohlcv WHERE asset IN ('A1', 'A4') GROUP BY asset")
def selected_price_files(spark, sf):
    p = prices.load_symbols(spark, ohlcv_files(spark, sf), ["A1", "A4"], symbol_pattern=BY_FOLDER)
    return p.groupBy("asset").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("available_symbols", "IO2", "SELECT DISTINCT asset FROM ohlcv")
def available_symbols(spark, sf):
    return prices.available_symbols(spark, ohlcv_files(spark, sf), BY_FOLDER)


@query("filled_price_fields", "IO3", """
    SELECT asset, date, coalesce(CASE WHEN day(date) % 2 = 0 THEN open END, (high + low) / 2) AS open, high, low, close, coalesce(CASE WHEN day(date) % 3 <> 0 THEN volume END, 0e0) AS volume FROM ohlcv""", OHLCV, 6)
def filled_price_fields(spark, sf):
    o = tables.ohlcv(spark, sf)
    holes = o.withColumn("open", F.when(F.dayofmonth("date") % 2 == 0, F.col("open"))).withColumn("volume", F.when(F.dayofmonth("date") % 3 != 0, F.col("volume")))
    return prices.fill_missing_fields(holes)


@query("wide_panel_round_trip", "IO4 IO7 S5 D2", "SELECT asset, date, price FROM prices", "price", 6)
def wide_panel_round_trip(spark, sf):
    path = new_path(spark, "panel")
    sinks.write_panel(base.prices(spark, sf), path)
    return prices.load_panel_prices(spark, path)


@query("wide_portfolios_round_trip", "IO5 S5 D4", """
    SELECT p.portfolio_id, a.asset, coalesce(w.w, 0e0) AS w FROM (SELECT DISTINCT portfolio_id FROM weights) p CROSS JOIN (SELECT DISTINCT asset FROM weights) a
    LEFT JOIN weights w ON w.portfolio_id = p.portfolio_id AND w.asset = a.asset""", "w")
def wide_portfolios_round_trip(spark, sf):
    path = new_path(spark, "wide")
    w = tables.weights(spark, sf)
    w.groupBy("portfolio_id").pivot("asset").agg(F.first("w")).write.parquet(path)
    return src.load_portfolios(spark, path)


@query("stored_risk_series", "IO8", "SELECT asset, date, confidence_level, horizon, estimation_window, var FROM varcov", "confidence_level var")
def stored_risk_series(spark, sf):
    path = new_path(spark, "store")
    cols = ["asset", "date", "confidence_level", "horizon", "estimation_window", "var"]
    sinks.write_store(base.varcov_series(spark, sf), path, cols, ["estimation_window"])
    return spark.read.parquet(path).select(*cols)


@query("field_summary", "IO9", " UNION ALL ".join(f"""
    SELECT asset, '{f}' AS field, count({f}) AS n_rows, min(date) AS start_date, max(date) AS end_date, avg({f}) AS mean, stddev_samp({f}) AS std, min({f}) AS min, max({f}) AS max, median({f}) AS median FROM ohlcv GROUP BY asset"""
    for f in OHLCV.split()), "mean std min max median", 5)
def field_summary(spark, sf):
    return sinks.field_summary(tables.ohlcv(spark, sf), OHLCV.split())


@query("schema_profile", "IO10", """
    SELECT 'portfolio_id' AS "column", 'bigint' AS dtype, count(portfolio_id) AS filled, min(portfolio_id)::DOUBLE AS min_value, max(portfolio_id)::DOUBLE AS max_value FROM weights
    UNION ALL SELECT 'asset', 'string', count(asset), NULL, NULL FROM weights UNION ALL SELECT 'w', 'double', count(w), min(w), max(w) FROM weights""", "min_value max_value")
def schema_profile(spark, sf):
    return sinks.schema_profile(tables.weights(spark, sf))


@query("calendar_intersection", "S2", """
    SELECT date FROM raw_prices_day GROUP BY date HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM raw_prices_day)""")
def calendar_intersection(spark, sf):
    p = tables.prices(spark, sf, "day")
    return panel.complete_dates(p, "price").select("date").distinct()


@query("missing_assets", "S3", """
    SELECT asset, date FROM (SELECT a.asset, c.date FROM (SELECT DISTINCT asset FROM raw_prices_day) a CROSS JOIN (SELECT DISTINCT date FROM raw_prices_day) c) EXCEPT SELECT asset, date FROM raw_prices_day""")
def missing_assets(spark, sf):
    p = tables.prices(spark, sf, "day")
    return panel.calendar_grid(p, src.universe_array(p)).select("asset", "date").exceptAll(p.select("asset", "date"))
