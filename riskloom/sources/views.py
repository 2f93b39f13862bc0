"""Investor views as rows of (view, asset, pick, target, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS_SCHEMA = (
    "absolute_views ARRAY<STRUCT<asset: STRING, `return`: DOUBLE, confidence: DOUBLE>>, "
    "relative_views ARRAY<STRUCT<assets: ARRAY<STRING>, return_diff: DOUBLE, confidence: DOUBLE, comment: STRING>>"
)


def load_investor_views(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(VIEWS_SCHEMA).option("multiLine", True).json(path)
    return explode_views(raw)


def explode_views(raw: DataFrame) -> DataFrame:
    """Absolute views pick one asset with +1; relative views pick +1 and -1."""
    absolute = raw.select(F.posexplode("absolute_views").alias("n", "v")).select(
        F.concat(F.lit("abs_"), F.col("n").cast("string")).alias("view_id"),
        F.col("v.asset").alias("asset"), F.lit(1.0).alias("p"),
        F.col("v.return").alias("q"), F.col("v.confidence").alias("confidence"),
    )
    relative = raw.select(F.posexplode("relative_views").alias("n", "v")).select("n", "v", F.posexplode("v.assets").alias("leg", "asset"))
    relative = relative.filter("leg < 2").select(
        F.concat(F.lit("rel_"), F.col("n").cast("string")).alias("view_id"), "asset",
        F.when(F.col("leg") == 0, 1.0).otherwise(-1.0).alias("p"),
        F.col("v.return_diff").alias("q"), F.col("v.confidence").alias("confidence"),
    )
    return absolute.unionByName(relative)


def applicable_views(views: DataFrame, assets: DataFrame) -> DataFrame:
    """Keep views whose assets are all members of each asset set.

    ``assets`` is (set_id, asset).  Membership is counted through an equi-join
    on asset, so no view is compared with sets that share nothing with it.
    """
    legs = views.withColumn("n_legs", F.count("*").over(_by_view()))
    hits = legs.join(assets, "asset")
    full = hits.groupBy("set_id", "view_id").agg(F.count("*").alias("found"), F.max("n_legs").alias("n_legs"))
    full = full.filter("found = n_legs").select("set_id", "view_id")
    return hits.join(full, ["set_id", "view_id"], "left_semi").drop("n_legs")


def _by_view():
    from pyspark.sql import Window

    return Window.partitionBy("view_id")
