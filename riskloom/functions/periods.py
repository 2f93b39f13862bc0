"""Calendar period keys (year, quarter, month)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_TYPES = ("year", "quarter", "month")


def period_key(date: Column, slice_type: str) -> Column:
    if slice_type == "year":
        return F.year(date).cast("string")
    if slice_type == "quarter":
        return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))
    if slice_type == "month":
        return F.date_format(date, "yyyy-MM")
    raise ValueError(f"unknown slice type {slice_type!r}")


def with_periods(df: DataFrame, date: str = "date", slice_types=SLICE_TYPES) -> DataFrame:
    """Fan each row out to one row per slice type with its period key."""
    rows = F.array(*[F.struct(F.lit(s).alias("slice_type"), period_key(F.col(date), s).alias("slice")) for s in slice_types])
    return df.withColumn("__p", F.explode(rows)).select(*df.columns, "__p.slice_type", "__p.slice")
