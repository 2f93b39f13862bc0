"""Price sources: per-symbol OHLCV files and wide panels, always returned long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The files carry Date, Close, High, Low, Open, Volume below three header rows.
# Everything is read as text so that header rows and junk turn into NULL dates.
OHLCV_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in ("date", "close", "high", "low", "open", "volume")])
SYMBOL_PATTERN = r"([^/]+)_10yr_daily"
FIELDS = ("open", "high", "low", "close", "volume")


def load_prices_csv(spark: SparkSession, path: str, symbol_pattern: str = SYMBOL_PATTERN) -> DataFrame:
    """Read per-symbol OHLCV files: coerce numbers, drop rows without a date,
    keep the first row of a repeated date."""
    raw = spark.read.schema(OHLCV_TEXT).csv(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), symbol_pattern, 1).alias("asset"),
        F.expr("try_cast(date AS DATE)").alias("date"),
        *[F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in FIELDS],
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__pos"),
    ).filter(F.col("date").isNotNull())
    first = F.row_number().over(Window.partitionBy("asset", "date").orderBy("__block", "__pos"))
    return fill_missing_fields(raw.withColumn("__rn", first).filter("__rn = 1")).select("asset", "date", *FIELDS)


def fill_missing_fields(ohlcv: DataFrame) -> DataFrame:
    """Open falls back to the middle of the day's range, volume to zero."""
    return ohlcv.withColumn("open", F.coalesce("open", (F.col("high") + F.col("low")) / 2)).withColumn(
        "volume", F.coalesce("volume", F.lit(0.0))
    )


def load_symbols(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, **kw) -> DataFrame:
    """Several symbols (or all of them) from one glob read."""
    prices = load_prices_csv(spark, path, **kw)
    return prices if symbols is None else prices.filter(F.col("asset").isin(list(symbols)))


def available_symbols(spark: SparkSession, path: str, symbol_pattern: str = SYMBOL_PATTERN) -> DataFrame:
    """Symbols present under a path, read from file names only."""
    files = spark.read.schema(OHLCV_TEXT).csv(path)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), symbol_pattern, 1).alias("asset")).distinct()


def wide_to_long(wide: DataFrame, date_col: str = "Date", value: str = "price", order: Sequence[str] = ()) -> DataFrame:
    """Wide panel (one column per asset) to (asset, date, value), the first of repeated dates.

    First means least in the columns ``order``, then in the order of rows.
    """
    assets = [c for c in wide.columns if c != date_col and c not in order]
    numbered = wide.withColumn("__pos", F.monotonically_increasing_id())
    first = F.row_number().over(Window.partitionBy(date_col).orderBy(*order, "__pos"))
    unique = numbered.withColumn("__rn", first).filter("__rn = 1").select(
        F.col(date_col).cast("date").alias("date"), *[F.col(f"`{a}`").cast("double").alias(a) for a in assets]
    )
    return unique.filter(F.col("date").isNotNull()).unpivot(["date"], assets, "asset", value).select("asset", "date", value)


def load_panel_prices(spark: SparkSession, path: str, fmt: str = "parquet", date_col: str = "Date") -> DataFrame:
    """Read a wide price panel from parquet or csv."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    # By file and block, since how files are packed into tasks says nothing about the order of rows.
    placed = reader.format(fmt).load(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    return wide_to_long(placed, date_col, order=("__file", "__block"))
