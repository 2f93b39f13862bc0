"""How close a generated sample is to a real one: (sample, value) rows with samples 'real' and 'generated'."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import fan_out, literal_rows, ratio
from riskloom.operators.ordering import exact_quantiles, running_totals

REAL, GENERATED = "real", "generated"


def _is(name: str) -> Column:
    return F.col("sample") == name


def distances(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Wasserstein-1 and Kolmogorov-Smirnov distance per key.

    With |F - G| constant between neighbouring values, the integral telescopes:
    each step contributes value * (gap before it - gap at it), so no row needs
    its neighbour from another partition.
    """
    keys = list(keys)
    steps = cdf_steps(samples, keys)
    gap, prev = F.abs(F.col("fa") - F.col("fb")), F.abs(F.col("pa") - F.col("pb"))
    return steps.groupBy(*keys).agg(F.sum(F.col("value") * (prev - gap)).alias("wasserstein"), F.max(gap).alias("ks_statistic"))


def cdf_steps(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both empirical CDFs at every distinct value and just before it, ordered across tasks.

    Values are counted per sample first, so repeated values cost one row.
    """
    keys = list(keys)
    counts = samples.groupBy(*keys, "value").agg(F.count_if(_is(REAL)).alias("a"), F.count_if(_is(GENERATED)).alias("b"))
    cum = running_totals(counts, [F.col("value")], ["a", "b"], keys)
    total = counts.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    if keys:
        joined = cum.join(total, keys)
    else:
        joined = cum.withColumn("__t", total.select(F.struct("na", "nb")).scalar()).withColumns({"na": F.col("__t.na"), "nb": F.col("__t.nb")})
    return joined.select(
        *keys, "value", ratio(F.col("cum_a"), F.col("na")).alias("fa"), ratio(F.col("cum_b"), F.col("nb")).alias("fb"),
        ratio(F.col("cum_a") - F.col("a"), F.col("na")).alias("pa"), ratio(F.col("cum_b") - F.col("b"), F.col("nb")).alias("pb"),
    )


def histogram(samples: DataFrame, bins: int) -> DataFrame:
    """(bin, a, b): counts of both samples on an even grid over their joint range."""
    span = samples.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("s")).scalar()
    s = samples.withColumn("__s", span)
    width = (F.col("__s.hi") - F.col("__s.lo")) / bins
    b = F.least(F.lit(bins - 1), F.coalesce(F.floor(ratio(F.col("value") - F.col("__s.lo"), width)), F.lit(0))).cast("int")
    return s.groupBy(b.alias("bin")).agg(F.count_if(_is(REAL)).alias("a"), F.count_if(_is(GENERATED)).alias("b"))


def jensen_shannon(samples: DataFrame, bins: int = 50, eps: float = 1e-12) -> DataFrame:
    """Jensen-Shannon distance of the two histograms (natural logarithm, square root)."""
    h = histogram(samples, bins)
    t = h.agg(F.struct(F.sum("a").alias("na"), F.sum("b").alias("nb")).alias("t")).scalar()
    p = h.withColumn("__t", t).withColumn("p", F.col("a") / F.col("__t.na")).withColumn("q", F.col("b") / F.col("__t.nb"))
    m = (F.col("p") + F.col("q")) / 2

    def term(x: str) -> Column:
        return F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / m)).otherwise(0.0)

    return p.agg(F.sqrt(F.greatest(F.sum(term("p") + term("q")) / 2, F.lit(0.0))).alias("js_distance"))


def coverage(samples: DataFrame, bins: int = 50) -> DataFrame:
    """Share of the bins held by the real sample that the generated one also holds, and of all bins."""
    h = histogram(samples, bins)
    return h.agg(
        (F.count_if(F.col("b") > 0) / F.lit(float(bins))).alias("bin_coverage"),
        ratio(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).cast("double"), F.count_if(F.col("a") > 0).cast("double")).alias("real_bin_coverage"),
    )


def moment_errors(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Absolute gaps of mean, variance, skewness and kurtosis."""

    def both(f, name):
        v = F.col("value")
        return F.abs(f(F.when(_is(REAL), v)) - f(F.when(_is(GENERATED), v))).alias(name)

    return samples.groupBy(*keys).agg(
        both(F.avg, "mean_error"), both(F.var_pop, "variance_error"), both(F.skewness, "skewness_error"), both(F.kurtosis, "kurtosis_error")
    )


def tail_errors(samples: DataFrame, confidence: Sequence[float], extreme: float = 0.999) -> DataFrame:
    """Gaps in VaR, CVaR, tail mass beyond the real VaR and an extreme quantile, losses being -value."""
    losses = samples.select("sample", (-F.col("value")).alias("loss"))
    q = exact_quantiles(losses, ["sample"], "loss", [*confidence, extreme]).groupBy().agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "sample", F.col("q").cast("string")), "quantile"))).alias("m")  # samples x levels
    ).scalar()
    rows = fan_out(losses, literal_rows([{"confidence_level": float(c)} for c in confidence])).withColumn("m", q)

    def level(name: str, lv) -> Column:
        return F.element_at("m", F.concat_ws("|", F.lit(name), lv.cast("string")))

    c = F.col("confidence_level")
    va, vb = level(REAL, c), level(GENERATED, c)
    loss = F.col("loss")
    g = rows.withColumns({"va": va, "vb": vb, "ea": level(REAL, F.lit(extreme)), "eb": level(GENERATED, F.lit(extreme))}).groupBy("confidence_level").agg(
        F.abs(F.first("va") - F.first("vb")).alias("var_error"),
        F.abs(F.avg(F.when(_is(REAL) & (loss >= F.col("va")), loss)) - F.avg(F.when(_is(GENERATED) & (loss >= F.col("vb")), loss))).alias("cvar_error"),
        F.abs(F.avg(F.when(_is(REAL), (loss >= F.col("va")).cast("double"))) - F.avg(F.when(_is(GENERATED), (loss >= F.col("va")).cast("double")))).alias("tail_mass_error"),
        F.abs(F.first("ea") - F.first("eb")).alias("extreme_quantile_error"),
    )
    return g


def stylised_fact_gaps(real: DataFrame, generated: DataFrame, lags: range = range(1, 6)) -> DataFrame:
    """Gaps in autocorrelation of squares, skewness and kurtosis of two (series, date, r) tables, per series."""
    from riskloom.operators.rolling import squared_autocorrelation

    a = squared_autocorrelation(real, lags, "series").withColumnRenamed("acf", "a")
    b = squared_autocorrelation(generated, lags, "series").withColumnRenamed("acf", "b")
    acf = a.join(b, ["series", "lag"]).groupBy("series").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("acf_gap"))
    ma = real.groupBy("series").agg(F.skewness("r").alias("sa"), F.kurtosis("r").alias("ka"))
    mb = generated.groupBy("series").agg(F.skewness("r").alias("sb"), F.kurtosis("r").alias("kb"))
    m = ma.join(mb, "series").select("series", F.abs(F.col("sa") - F.col("sb")).alias("skewness_gap"), F.abs(F.col("ka") - F.col("kb")).alias("kurtosis_gap"))
    return acf.join(m, "series")


def sliced(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distances and moment gaps per period."""
    return distances(samples, keys).join(moment_errors(samples, keys), list(keys))
