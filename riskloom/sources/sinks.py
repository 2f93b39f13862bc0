"""Writers and table profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_per_symbol(prices: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder per asset."""
    prices.repartition("asset").write.mode("overwrite").partitionBy("asset").format(fmt).save(path)


def wide_panel(prices: DataFrame, value: str = "price", assets: Sequence[str] | None = None) -> DataFrame:
    """Long prices to one column per asset."""
    return prices.groupBy("date").pivot("asset", list(assets) if assets else None).agg(F.first(value))


def write_panel(prices: DataFrame, path: str, value: str = "price", fmt: str = "parquet") -> None:
    wide_panel(prices, value).withColumnRenamed("date", "Date").write.mode("overwrite").option("header", True).format(fmt).save(path)


def write_store(df: DataFrame, path: str, columns: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Project to the required columns (missing ones fail) and write parquet."""
    df.select(*columns).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def field_summary(ohlcv: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows, date range and distribution of every field per asset."""
    long = ohlcv.unpivot(["asset", "date"], list(fields), "field", "value")
    return long.groupBy("asset", "field").agg(
        F.count("value").alias("n_rows"), F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.percentile("value", F.lit(0.5)).alias("median"),
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """Column, type, filled rows and range of each column, from one aggregate pass."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        number = isinstance(f.dataType, T.NumericType)
        lo = F.min(c).cast("double") if number else F.lit(None).cast("double")
        hi = F.max(c).cast("double") if number else F.lit(None).cast("double")
        parts.append(
            F.struct(
                F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                F.count(c).alias("filled"), lo.alias("min_value"), hi.alias("max_value"),
            )
        )
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
