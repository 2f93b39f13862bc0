"""Maps trading tables (lineitem, orders, events) onto prices, weights and samples.

* asset        supplier group ``A0``..``A9``
* price        value-weighted unit price of the period
* portfolio    customer, weighted by spend per asset
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.session import materialise


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def asset_name(suppkey: str = "l_suppkey") -> Column:
    return F.concat(F.lit("A"), (F.col(suppkey) % 10).cast("string"))


def price_date(grain: str) -> Column:
    if grain == "day":
        return F.to_date("l_shipdate")
    return F.trunc(F.to_date("l_shipdate"), grain)


def prices(spark: SparkSession, sf: str, grain: str = "week") -> DataFrame:
    """(asset, date, price); rows per asset are bounded by the calendar, whatever the input size.

    The sums combine on the map side, so a hot supplier costs no more than any other.
    The panel is written once: alignment and returns read it several times and
    must not scan the trades again.
    """
    li = read(spark, sf, "lineitem")
    # Grouped on the number; the name is made once per result row, not once per trade.
    panel = li.groupBy((F.col("l_suppkey") % 10).alias("group"), price_date(grain).alias("date")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price")
    )
    return materialise(panel.select(asset_name("group").alias("asset"), "date", "price"), "prices")


def ohlcv(spark: SparkSession, sf: str, grain: str = "week") -> DataFrame:
    """(asset, date, open, high, low, close, volume) from unit prices within the period."""
    li = read(spark, sf, "lineitem").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    panel = li.groupBy(asset_name().alias("asset"), price_date(grain).alias("date")).agg(
        F.min_by("unit", order).alias("open"), F.max("unit").alias("high"), F.min("unit").alias("low"),
        F.max_by("unit", order).alias("close"), F.sum("l_quantity").alias("volume"),
    )
    return materialise(panel, "ohlcv")


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """(portfolio_id, asset, w): spend share of each customer by asset.

    The order join shuffles on the order key, where adaptive execution splits a
    skewed partition; spend is then summed on the map side before it is
    exchanged by customer.  The table is written once, since portfolio jobs
    read it several times and must not repeat the join of the trades.
    """
    spend = (
        read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 10).alias("group"), "l_extendedprice")
        .join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("portfolio_id"), "group")
        .agg(F.sum("l_extendedprice").alias("spend"))
    )
    total = F.sum("spend").over(Window.partitionBy("portfolio_id"))  # at most one row per asset
    return materialise(spend.select("portfolio_id", asset_name("group").alias("asset"), (F.col("spend") / total).alias("w")), "weights")


def market_weights(spark: SparkSession, sf: str) -> DataFrame:
    """(asset, w): share of all spend, the benchmark portfolio."""
    by_asset = read(spark, sf, "lineitem").groupBy(asset_name().alias("asset")).agg(F.sum("l_extendedprice").alias("spend"))
    total = by_asset.agg(F.sum("spend").alias("total")).scalar()
    return by_asset.select("asset", (F.col("spend") / total).alias("w"))
