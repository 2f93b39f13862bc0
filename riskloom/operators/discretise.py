"""Winsorising, scaling and discretising of loss laws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import normal_cdf, ratio


def winsorise(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float) -> DataFrame:
    """Clip to the key's quantiles."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(lo), F.lit(hi))).alias("__q"))
    return df.join(q, list(keys)).withColumn(value, F.greatest(F.col("__q")[0], F.least(F.col("__q")[1], F.col(value)))).drop("__q")


def robust_scores(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """z-score and robust z-score (median and 1.4826 MAD, standard deviation where MAD is 0)."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.percentile(value, F.lit(0.5)).alias("median"))
    j = df.join(s, list(keys))
    mad = j.groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)).alias("mad"))
    j = j.join(mad, list(keys))
    scale = F.when(F.col("mad") > 0, F.col("mad") * 1.4826).otherwise(F.col("std"))
    return j.withColumn("robust_scale", scale).withColumn("z", ratio(F.col(value) - F.col("mean"), F.col("std"))).withColumn(
        "robust_z", ratio(F.col(value) - F.col("median"), F.col("robust_scale")))


def inverse_robust(z: Column, median: Column, scale: Column) -> Column:
    return z * scale + median


def uniform_grid(df: DataFrame, keys: Sequence[str], value: str, bins: int, lo_q: float = 0.005, hi_q: float = 0.995) -> DataFrame:
    """Bin index and centre on an even grid between two quantiles; values outside are clamped."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(lo_q), F.lit(hi_q))).alias("__q"))
    j = df.join(q, list(keys)).withColumn("lo", F.col("__q")[0]).withColumn("step", (F.col("__q")[1] - F.col("__q")[0]) / bins).drop("__q")
    raw = F.coalesce(F.floor(ratio(F.col(value) - F.col("lo"), F.col("step"))), F.lit(0))
    j = j.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw)).cast("int"))
    return j.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * F.col("step"))


def quantile_grid(df: DataFrame, keys: Sequence[str], value: str, levels: int, lo_q: float = 0.01, hi_q: float = 0.99) -> DataFrame:
    """Quantile levels of the value per key, rescaled to [0, 1]."""
    qs = [lo_q + (hi_q - lo_q) * k / (levels - 1) for k in range(levels)]
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(x) for x in qs])).alias("__q"))
    out = q.select(*keys, F.posexplode("__q").alias("level", "loss"), F.col("__q")[0].alias("lo"), F.col("__q")[levels - 1].alias("hi"))
    return out.withColumn("scaled", ratio(F.col("loss") - F.col("lo"), F.col("hi") - F.col("lo"))).drop("lo", "hi")


def normal_law(df: DataFrame, keys: Sequence[str], bits: int, width: float = 4.0) -> DataFrame:
    """Normal loss laws (columns mu, sigma) on 2^bits cells: centre and probability of each cell.

    The grid spans ``width`` standard deviations each side; probabilities are
    CDF differences scaled to 1.
    """
    n = 2 ** bits
    step = 2 * width / n
    cells = F.sequence(F.lit(0), F.lit(n - 1))
    out = df.select(*keys, "mu", "sigma", F.explode(cells).alias("cell"))
    z0 = F.lit(-width) + F.col("cell") * step
    total = 1 - 2 * normal_cdf(F.lit(-width))
    p = (normal_cdf(z0 + step) - normal_cdf(z0)) / total
    return out.select(*keys, "cell", (F.col("mu") + F.col("sigma") * (z0 + step / 2)).alias("x"), p.alias("p"))


def discrete_var_cvar(law: DataFrame, keys: Sequence[str], confidence: Sequence[float]) -> DataFrame:
    """VaR (first cell reaching the level) and CVaR = VaR + E[(x - VaR)+]/(1-c) on a discretised law.

    Each law is packed into one array of its cells (2^bits of them).
    """
    from riskloom.functions.columns import fan_out, literal_rows

    packed = law.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell", "x", "p"))).alias("cells"))
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("v"))
    out = fan_out(packed, literal_rows([{"confidence_level": float(c)} for c in confidence]))

    def find(s: Column, k: Column) -> Column:
        c = s["c"] + k["p"]
        return F.struct(c.alias("c"), F.coalesce(s["v"], F.when(c >= F.col("confidence_level") - 1e-12, k["x"])).alias("v"))

    out = out.withColumn("var", F.aggregate("cells", zero, find, lambda s: s["v"]))
    tail = F.aggregate("cells", F.lit(0.0), lambda s, k: s + k["p"] * F.greatest(F.lit(0.0), k["x"] - F.col("var")))
    return out.withColumn("cvar", F.col("var") + tail / (1 - F.col("confidence_level"))).drop("cells")


def scaled_var_cvar(df: DataFrame, keys: Sequence[str], bits: int, confidence: Sequence[float]) -> DataFrame:
    """VaR and CVaR of the laws of ``normal_law`` (columns mu, sigma) without building them.

    All laws share one grid in standard units, so both measures are mu + sigma * k
    with two constants per level, read off the law of mu 0 and sigma 1.
    """
    from riskloom.functions.columns import literal_rows

    spark = df.sparkSession
    unit = normal_law(spark.range(1).select("id", F.lit(0.0).alias("mu"), F.lit(1.0).alias("sigma")), ["id"], bits)
    levels = [r.asDict() for r in discrete_var_cvar(unit, ["id"], confidence).select("confidence_level", "var", "cvar").collect()]
    at = df.select(*keys, "mu", "sigma", F.explode(literal_rows(levels)).alias("k"))
    scaled = lambda c: F.col("mu") + F.col("sigma") * F.col(f"k.{c}")
    return at.select(*keys, F.col("k.confidence_level").alias("confidence_level"), scaled("var").alias("var"), scaled("cvar").alias("cvar"))


def cdf_and_tail(law: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cumulative probability and tail expectation at every cell of a discretised law."""
    w = Window.partitionBy(*keys).orderBy("cell")
    after = w.rowsBetween(1, Window.unboundedFollowing)
    out = law.withColumn("cdf", F.sum("p").over(w))
    mass, first = F.coalesce(F.sum("p").over(after), F.lit(0.0)), F.coalesce(F.sum(F.col("p") * F.col("x")).over(after), F.lit(0.0))
    return out.withColumn("tail_expectation", first - F.col("x") * mass)
