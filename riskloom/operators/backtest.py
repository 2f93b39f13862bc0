"""Coverage backtests of risk series: violations, likelihood-ratio tests, zones, tails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import chi2_sf, ratio
from riskloom.functions.constants import CHI2_CRITICAL_1, CHI2_CRITICAL_2
from riskloom.functions.periods import SLICE_TYPES, with_periods

KEY = ("asset", "confidence_level", "horizon", "estimation_window")


def with_violations(series: DataFrame) -> DataFrame:
    """Loss and violation flags; rows without a positive VaR are not tested."""
    out = series.filter(F.col("var") > 0).withColumn("loss", -F.col("r")).withColumn("violation", -F.col("r") > F.col("var"))
    if "cvar" in series.columns:
        out = out.withColumn("cvar_violation", -F.col("r") > F.col("cvar"))
    return out


def _xlogy(x: Column, y: Column) -> Column:
    """x ln y with the limit 0 at x = 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(y))


def kupiec_lr(n: Column, x: Column, p: Column) -> Column:
    """Unconditional-coverage likelihood ratio; finite at x = 0 and x = n."""
    null = _xlogy(x, p) + _xlogy(n - x, 1 - p)
    alt = _xlogy(x, ratio(x, n)) + _xlogy(n - x, ratio(n - x, n))
    return -2.0 * (null - alt)


def christoffersen_lr(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    """Independence likelihood ratio (pooled against state-dependent rates)."""
    n0, n1 = n00 + n01, n10 + n11
    pooled = ratio(n01 + n11, n0 + n1)
    null = _xlogy(n01 + n11, pooled) + _xlogy(n00 + n10, 1 - pooled)
    alt = _xlogy(n01, ratio(n01, n0)) + _xlogy(n00, ratio(n00, n0)) + _xlogy(n11, ratio(n11, n1)) + _xlogy(n10, ratio(n10, n1))
    return F.when((n0 > 0) & (n1 > 0), -2.0 * (null - alt))


def traffic_light(x: Column, n: Column, p: Column) -> Column:
    """Green/yellow/red zone with the 250-row limits scaled to the sample size."""
    expected = 250 * p
    green = F.when(expected < 5, F.lit(4)).otherwise(F.floor(expected * 1.6 + 1e-9))
    yellow = F.when(expected < 5, F.lit(9)).otherwise(F.floor(expected * 2.4 + 1e-9))
    return F.when(x <= green * n / 250.0, "green").when(x <= yellow * n / 250.0, "yellow").otherwise("red")


def violation_ratio(rate: Column, p: Column) -> Column:
    return F.when(p == 0, F.when(rate > 0, F.lit(float("inf"))).otherwise(1.0)).otherwise(ratio(rate, p))


def transitions(flagged: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Counts of violation transitions between consecutive rows."""
    prev = F.lag("violation").over(Window.partitionBy(*keys).orderBy("date"))
    t = flagged.withColumn("prev", prev)
    return t.groupBy(*keys).agg(*_transition_counts())


def _transition_counts() -> list[Column]:
    v, prev = F.col("violation"), F.col("prev")
    return [
        F.count_if(~prev & ~v).alias("n00"), F.count_if(~prev & v).alias("n01"),
        F.count_if(prev & ~v).alias("n10"), F.count_if(prev & v).alias("n11"),
    ]


def accuracy(flagged: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Hit rate, violation ratio, coverage and independence tests and zone, one row per key."""
    prev = F.lag("violation").over(Window.partitionBy(*keys).orderBy("date"))
    return coverage_tests(flagged.withColumn("prev", prev).groupBy(*keys).agg(
        F.count("*").alias("total_observations"), F.count_if("violation").alias("num_violations"), *_transition_counts()
    ))


def coverage_tests(g: DataFrame) -> DataFrame:
    """The tests of ``accuracy`` from counts of observations, violations and transitions."""
    n, x = F.col("total_observations"), F.col("num_violations")
    p = 1 - F.col("confidence_level")
    out = (
        g.withColumn("expected_violations", n * p)
        .withColumn("hit_rate", x / n)
        .withColumn("violation_ratio", violation_ratio(x / n, p))
        .withColumn("kupiec_statistic", kupiec_lr(n, x, p))
        .withColumn("independence_statistic", christoffersen_lr(*[F.col(c) for c in ("n00", "n01", "n10", "n11")]))
    )
    out = out.withColumn("conditional_coverage_statistic", F.col("kupiec_statistic") + F.col("independence_statistic"))
    return (
        out.withColumn("kupiec_p_value", chi2_sf(F.col("kupiec_statistic"), 1))
        .withColumn("kupiec_reject", F.col("kupiec_statistic") > CHI2_CRITICAL_1)
        .withColumn("independence_p_value", chi2_sf(F.col("independence_statistic"), 1))
        .withColumn("independence_reject", F.coalesce(F.col("independence_statistic") > CHI2_CRITICAL_1, F.lit(False)))
        .withColumn("conditional_coverage_p_value", chi2_sf(F.col("conditional_coverage_statistic"), 2))
        .withColumn("conditional_coverage_reject", F.coalesce(F.col("conditional_coverage_statistic") > CHI2_CRITICAL_2, F.lit(False)))
        .withColumn("traffic_light_zone", traffic_light(x, n, p))
    )


def tail_metrics(flagged: DataFrame, keys: Sequence[str] = KEY, on: str = "var") -> DataFrame:
    """Exceedances over VaR (or CVaR), pinball loss and RMSE per key."""
    hit = F.col("violation") if on == "var" else F.col("cvar_violation")
    gap = F.col("loss") - F.col(on)
    c = F.col("confidence_level")
    return flagged.groupBy(*keys).agg(
        F.avg(F.when(hit, gap)).alias("mean_exceedance"), F.max(F.when(hit, gap)).alias("max_exceedance"),
        F.stddev_samp(F.when(hit, gap)).alias("std_exceedance"),
        F.avg(F.greatest(c * gap, (c - 1) * gap)).alias("quantile_loss_score"),
        F.sqrt(F.avg(F.when(hit, gap * gap))).alias("rmse_violations"), F.sqrt(F.avg(gap * gap)).alias("rmse_all"),
    )


def cvar_exceedance(flagged: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Count, rate, size, ratio to expectation and zone of CVaR exceedances."""
    hit, gap = F.col("cvar_violation"), F.col("loss") - F.col("cvar")
    p = 1 - F.col("confidence_level")
    g = flagged.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("num_exceedances"),
        F.avg(F.when(hit, gap)).alias("mean_exceedance"), F.max(F.when(hit, gap)).alias("max_exceedance"),
    )
    return g.withColumn("exceedance_rate", F.col("num_exceedances") / F.col("n")).withColumn(
        "exceedance_ratio", violation_ratio(F.col("num_exceedances") / F.col("n"), p)
    ).withColumn("traffic_light_zone", traffic_light(F.col("num_exceedances"), F.col("n"), p))


def distribution_metrics(rets: DataFrame, keys: Sequence[str], value: str = "r") -> DataFrame:
    """Population skewness, excess kurtosis and the Jarque-Bera test."""
    g = rets.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4.0)
    return g.withColumn("jarque_bera_statistic", jb).withColumn("jarque_bera_p_value", chi2_sf(F.col("jarque_bera_statistic"), 2))


def time_slices(flagged: DataFrame, keys: Sequence[str] = KEY, slice_types: Sequence[str] = SLICE_TYPES, min_obs: int = 1) -> DataFrame:
    """Backtest counts per year, quarter and month."""
    aggs = [
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("total_observations"),
        F.count_if("violation").alias("num_violations"),
    ]
    if "cvar_violation" in flagged.columns:
        aggs += [
            F.avg(F.col("cvar_violation").cast("double")).alias("cvar_hit_rate"),
            F.avg(F.when(F.col("cvar_violation"), F.col("loss") - F.col("cvar"))).alias("mean_cvar_exceedance"),
            F.max(F.when(F.col("cvar_violation"), F.col("loss") - F.col("cvar"))).alias("max_cvar_exceedance"),
        ]
    g = with_periods(flagged, "date", slice_types).groupBy(*keys, "slice_type", "slice").agg(*aggs).filter(F.col("total_observations") >= min_obs)
    p = 1 - F.col("confidence_level")
    rate = F.col("num_violations") / F.col("total_observations")
    return g.withColumn("hit_rate", rate).withColumn("expected_violations", F.col("total_observations") * p).withColumn("violation_ratio", violation_ratio(rate, p))


def slice_with_returns(risk_slices: DataFrame, return_slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a slice returns table to a slice risk table on keys and period."""
    return return_slices.join(risk_slices, [*keys, "slice_type", "slice"])


def tail_shape(rets: DataFrame, keys: Sequence[str], value: str = "r") -> DataFrame:
    """Hill index of the worst decile (at least 10 rows), deep quantile and coherence checks."""
    w = Window.partitionBy(*keys).orderBy(value)
    r = rets.withColumn("rk", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    k = F.greatest(F.lit(10), F.floor(F.col("n") / 10))
    tail = r.filter((F.col("rk") <= k) & (F.col(value) < 0))
    smallest = F.min(F.abs(F.col(value))).over(Window.partitionBy(*keys))
    hill = tail.withColumn("u", smallest).groupBy(*keys).agg(
        ratio(F.lit(1.0), F.avg(F.log(F.abs(F.col(value)) / F.col("u")))).alias("hill_tail_index"), F.count("*").alias("tail_rows")
    )
    q = rets.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(a) for a in (0.01, 0.05, 0.1)])).alias("q"))
    c = rets.join(q, list(keys)).groupBy(*keys).agg(
        F.first("q").alias("q"), *[F.avg(F.when(F.col(value) <= F.col("q")[i], -F.col(value))).alias(f"cvar_{n}") for i, n in ((0, 99), (1, 95), (2, 90))]
    )
    c = c.withColumn("extreme_var_99", -F.col("q")[0]).withColumn(
        "cvar_at_least_var", (F.col("cvar_99") >= -F.col("q")[0]) & (F.col("cvar_95") >= -F.col("q")[1]) & (F.col("cvar_90") >= -F.col("q")[2])
    ).withColumn("cvar_monotone", (F.col("cvar_99") >= F.col("cvar_95")) & (F.col("cvar_95") >= F.col("cvar_90")))
    return c.drop("q").join(hill, list(keys), "left")


def tail_ratios(rets: DataFrame, keys: Sequence[str], value: str = "r") -> DataFrame:
    """|p95/p5|, CVaR/VaR, worst loss, mean loss beyond CVaR and semivariance."""
    q = rets.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    c = rets.join(q, list(keys))
    es = F.avg(F.when(F.col(value) <= F.col("q")[0], F.col(value))).over(Window.partitionBy(*keys))
    g = c.withColumn("es", es).groupBy(*keys).agg(
        F.first("q").alias("q"), (-F.first("es")).alias("cvar"), (-F.min(value)).alias("worst_loss"),
        (-F.avg(F.when(F.col(value) <= F.col("es"), F.col(value)))).alias("expected_loss_beyond_cvar"),
        F.var_pop(F.when(F.col(value) < 0, F.col(value))).alias("semivariance"),
    )
    return g.select(
        *keys, F.abs(ratio(F.col("q")[1], F.col("q")[0])).alias("tail_ratio"), (-F.col("q")[0]).alias("var"), "cvar",
        ratio(F.col("cvar"), -F.col("q")[0]).alias("cvar_over_var"), "worst_loss", "expected_loss_beyond_cvar", "semivariance",
    )
