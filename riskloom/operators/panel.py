"""Panel preparation: filters, gap filling, calendar alignment and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# After aggregation to (asset, date) a partition holds one row per date, so
# ordered windows by asset stay small however large the source is.
def by_asset():
    return Window.partitionBy("asset").orderBy("date")


def before():
    return by_asset().rowsBetween(Window.unboundedPreceding, 0)


def after():
    return by_asset().rowsBetween(0, Window.unboundedFollowing)


def asset_universe(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    if include is not None:
        df = df.filter(F.col("asset").isin(list(include)))
    return df.filter(~F.col("asset").isin(list(exclude))) if exclude else df


def min_observations(returns: DataFrame, n: int, value: str = "r") -> DataFrame:
    """Keep assets with at least ``n`` filled rows."""
    enough = returns.groupBy("asset").agg(F.count(value).alias("n")).filter(F.col("n") >= n)
    return returns.join(enough, "asset", "left_semi")


def top_variance_assets(returns: DataFrame, k: int) -> DataFrame:
    keep = returns.groupBy("asset").agg(F.var_samp("r").alias("v")).orderBy(F.desc("v"), "asset").limit(k)
    return returns.join(keep, "asset", "left_semi")


def parse_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """Cast to DATE and drop rows whose date does not parse."""
    return df.withColumn(column, F.expr(f"try_cast({column} AS DATE)")).filter(F.col(column).isNotNull())


def calendar_grid(prices: DataFrame, universe: Column, value: str = "price") -> DataFrame:
    """Every (date, asset) of the calendar; absent prices become NULL."""
    grid = prices.select("date").distinct().select("date", F.explode(universe).alias("asset"))
    return grid.join(prices.select("asset", "date", value), ["asset", "date"], "left")


def fill_forward(df: DataFrame, value: str = "price") -> DataFrame:
    return df.withColumn(value, F.last(value, ignorenulls=True).over(before()))


def fill_backward(df: DataFrame, value: str = "price") -> DataFrame:
    return df.withColumn(value, F.first(value, ignorenulls=True).over(after()))


def _interpolate(df: DataFrame, position: Column, value: str) -> DataFrame:
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("__x").alias("x"), F.col(value).alias("v")))
    df = df.withColumn("__x", position)
    df = df.withColumn("__a", F.last(known, ignorenulls=True).over(before()))
    df = df.withColumn("__b", F.first(known, ignorenulls=True).over(after()))
    inside = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col("__x") - F.col("__a.x")) / (F.col("__b.x") - F.col("__a.x"))
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(F.col("__a").isNull(), F.col("__b.v"))
        .when(F.col("__b").isNull(), F.col("__a.v"))
        .otherwise(inside)
    )
    return df.withColumn(value, filled).drop("__x", "__a", "__b")


def fill_time(df: DataFrame, value: str = "price") -> DataFrame:
    """Linear in elapsed days; both edges take the nearest value."""
    return _interpolate(df, F.unix_date("date").cast("double"), value)


def fill_linear(df: DataFrame, value: str = "price") -> DataFrame:
    """Linear in row position; both edges take the nearest value."""
    return _interpolate(df, F.row_number().over(by_asset()).cast("double"), value)


def complete_dates(df: DataFrame, value: str) -> DataFrame:
    """Trading-day alignment: keep dates on which every asset has a value.

    One count per date instead of one join per asset.
    """
    filled = df.filter(F.col(value).isNotNull())
    n_assets = filled.agg(F.count_distinct("asset").alias("n")).scalar()
    keep = filled.groupBy("date").agg(F.count_distinct("asset").alias("n")).filter(F.col("n") == n_assets)
    return df.join(keep, "date", "left_semi")


def drop_missing(df: DataFrame, value: str = "r", how: str = "any") -> DataFrame:
    """``any``: drop dates with a missing asset; ``all``: drop dates with none filled; ``asset``: drop rows."""
    if how == "asset":
        return df.filter(F.col(value).isNotNull())
    if how == "any":
        return complete_dates(df, value)
    keep = df.filter(F.col(value).isNotNull()).select("date").distinct()
    return df.join(keep, "date", "left_semi")


def validate_panel(ohlcv: DataFrame, universe: Column) -> DataFrame:
    """Violations per asset: calendar gaps, nulls, negative values, broken ranges."""
    n_dates = ohlcv.agg(F.count_distinct("date").alias("n")).scalar()
    low, high = F.col("low"), F.col("high")
    return ohlcv.groupBy("asset").agg(
        (n_dates - F.count_distinct("date")).alias("missing_dates"),
        F.count_if(F.isnull("open") | F.isnull("high") | F.isnull("low") | F.isnull("close") | F.isnull("volume")).alias("null_rows"),
        F.count_if((F.col("open") < 0) | (high < 0) | (low < 0) | (F.col("close") < 0)).alias("negative_prices"),
        F.count_if(F.col("volume") < 0).alias("negative_volumes"),
        F.count_if(high < low).alias("high_below_low"),
        F.count_if((F.col("close") > high) | (F.col("close") < low) | (F.col("open") > high) | (F.col("open") < low)).alias("outside_range"),
    )
