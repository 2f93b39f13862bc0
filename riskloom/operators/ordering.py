"""Order statistics of whole tables without a single-task window.

Rows are range-partitioned on the ordering columns, the partition number is
written down with them, each partition is ranked on its own and shifted by the
totals of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialise

# Groups up to this many rows in total may use the exact percentile aggregate,
# whose buffer holds the distinct values of a group.
MAX_BUFFERED_ROWS = 5_000_000


def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partitioned copy with its partition number, written so both uses see the same cut."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranged")


def running_totals(df: DataFrame, order: Sequence[Column], values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``cum_<value>`` (inclusive, in ``order``) for each value, per key.

    ``order`` must make rows distinct within a key, so that no range is larger
    than another; pre-aggregate equal values first.
    """
    keys = list(keys)
    r = _ranged(df, [*[F.col(k) for k in keys], *order])
    per = r.groupBy(*keys, "__part").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    # One row per key and partition: a table bounded by the partition count per key.
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*keys, "__part", *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__o_{v}") for v in values])
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = r
    for v in values:
        out = out.withColumn(f"__c_{v}", F.sum(v).over(inside))
    right = offsets.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__p"), *[f"__o_{v}" for v in values])
    same = F.col("__part") == F.col("__p")
    for k in keys:  # a NULL key is a key
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = out.join(right, same)
    return out.select(*df.columns, *[(F.col(f"__c_{v}") + F.col(f"__o_{v}")).alias(f"cum_{v}") for v in values])


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in the given total order."""
    out = running_totals(df.withColumn("__one", F.lit(1).cast("long")), order, ["__one"])
    return out.withColumnRenamed("cum___one", name).drop("__one")


def percent_rank(df: DataFrame, column: str, name: str = "percent_rank") -> DataFrame:
    """(rank - 1) / (n - 1) with ties sharing the lowest rank, among the rows that have a value; NULL elsewhere.

    Ranks are worked out on distinct values, so a value held by many rows is
    one row until it is joined back.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    cum = running_totals(counts, [F.col(column)], ["__n"])
    total = counts.agg(F.sum("__n").alias("t")).scalar()
    ranks = cum.select(column, F.when(total > 1, (F.col("cum___n") - F.col("__n")) / (total - 1)).otherwise(0.0).alias(name))
    return df.join(ranks, column, "left")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], max_buffered: int = MAX_BUFFERED_ROWS) -> DataFrame:
    """(keys, q, quantile): linear-interpolated quantiles of every key.

    Small inputs (counted) use the percentile aggregate.  Beyond that, values are
    counted, ordered across tasks and the two rows around each position picked.
    NULL is a key like any other; a key without a value has NULL quantiles.
    """
    keys = list(keys)
    levels = F.array(*[F.lit(float(q)) for q in qs])
    if df.count() <= max_buffered:
        p = df.groupBy(*keys).agg(F.percentile(value, levels).alias("__p"))
        e = p.select(*keys, F.posexplode(levels).alias("__at", "q"), "__p")
        return e.select(*keys, "q", F.get("__p", F.col("__at")).alias("quantile"))
    counts = materialise(df.groupBy(*keys, value).agg(F.count("*").alias("__n")), "counts")
    totals = counts.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col("__n"))), F.lit(0)).alias("__t"))
    totals = materialise(totals, "totals")  # one row per key, size known before the join
    right = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__t")
    cum = running_totals(counts.where(F.col(value).isNotNull()), [F.col(value)], ["__n"], keys)

    def same(prefix: str) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
        return out

    joined = cum.join(right, same("__k_")).withColumn("q", F.explode(levels)).withColumn("__pos", F.col("q") * (F.col("__t") - 1))
    lo, hi = F.floor("__pos"), F.ceil("__pos")
    first, last = F.col("cum___n") - F.col("__n"), F.col("cum___n") - 1
    near = joined.filter((first <= hi) & (last >= lo))
    picked = near.groupBy(*keys, "q").agg(
        F.max(F.when((first <= lo) & (last >= lo), F.col(value))).alias("a"), F.max(F.when((first <= hi) & (last >= hi), F.col(value))).alias("b"), F.first("__pos").alias("p")
    )
    found = picked.select(*[F.col(k).alias(f"__f_{k}") for k in keys], F.col("q").alias("__q"), (F.col("a") + (F.col("b") - F.col("a")) * (F.col("p") - F.floor("p"))).alias("quantile"))
    every = totals.select(*keys, F.explode(levels).alias("q"))
    return every.join(found, same("__f_") & (F.col("q") == F.col("__q")), "left").select(*keys, "q", "quantile")


def quantile_columns(df: DataFrame, keys: Sequence[str], value: str, names: dict[str, float]) -> DataFrame:
    """``exact_quantiles`` with one column per named level."""
    q = exact_quantiles(df, keys, value, list(names.values()))
    aggs = [F.max(F.when(F.col("q") == F.lit(float(v)), F.col("quantile"))).alias(n) for n, v in names.items()]
    return q.groupBy(*keys).agg(*aggs)
