"""Portfolio weights, wide or long, aligned to an asset universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_portfolios(spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "portfolio_id") -> DataFrame:
    """Read weights; a table with ``asset`` and ``weight`` columns is long, any other is wide."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    raw = reader.format(fmt).load(path)
    if {"asset", "weight"} <= set(raw.columns):
        return raw.select(F.col(id_col).alias("portfolio_id"), "asset", F.col("weight").cast("double").alias("w"))
    assets = [c for c in raw.columns if c != id_col]
    cast = raw.select(F.col(id_col).alias("portfolio_id"), *[F.col(f"`{a}`").cast("double").alias(a) for a in assets])
    return cast.unpivot(["portfolio_id"], assets, "asset", "w").fillna(0.0, ["w"])


def universe_array(assets: DataFrame) -> Column:
    """Sorted distinct asset names of a table as one scalar array."""
    return assets.agg(F.array_sort(F.collect_set("asset")).alias("u")).scalar()


def weight_arrays(weights: DataFrame, universe: Column) -> DataFrame:
    """One row per portfolio with weights in universe order.

    Missing assets get 0 and assets outside the universe are dropped, without
    building the portfolio x asset grid as rows.
    """
    packed = weights.groupBy("portfolio_id").agg(F.map_from_entries(F.collect_list(F.struct("asset", "w"))).alias("m"))
    filled = F.transform("assets", lambda a: F.coalesce(F.try_element_at(F.col("m"), a), F.lit(0.0)))
    return packed.withColumn("assets", universe).select("portfolio_id", "assets", filled.alias("w"))


def align_to_universe(weights: DataFrame, universe: Column, tolerance: float = 1e-9) -> DataFrame:
    """Fill missing assets with 0 and renormalise where the weights do not sum to 1."""
    arrays = weight_arrays(weights, universe)
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    fixed = F.when((F.abs(total - 1) > tolerance) & (total > 0), F.transform("w", lambda x: x / total)).otherwise(F.col("w"))
    return (
        arrays.withColumn("w", fixed)
        .select("portfolio_id", F.explode(F.arrays_zip("assets", "w")).alias("e"))
        .select("portfolio_id", F.col("e.assets").alias("asset"), F.col("e.w").alias("w"))
    )
