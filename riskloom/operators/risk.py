"""Value-at-Risk and expected-shortfall series and estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import constants as K
from riskloom.functions.columns import fan_out, horizon_scale, literal_rows
from riskloom.operators import paths
from riskloom.operators.rolling import ewma_next_variance, rolling_moments, window_arrays
from riskloom.session import MAX_INLINE_CELLS


def normal_grid(confidence: Sequence[float], horizons: Sequence[int]) -> Column:
    """Literal rows of confidence, horizon and the normal constants of each level."""
    return literal_rows([
        {"confidence_level": c, "horizon": h, "z": K.normal_quantile(1 - c), "es": K.es_factor_normal(c)}
        for c in confidence for h in horizons
    ])


def student_grid(confidence: Sequence[float], horizons: Sequence[int], df: float) -> Column:
    """As ``normal_grid`` for a Student-t loss with ``df`` degrees of freedom."""
    return literal_rows([
        {"confidence_level": c, "horizon": h, "z": K.t_quantile(1 - c, df), "es": K.es_factor_t(c, df)}
        for c in confidence for h in horizons
    ])


def parametric_var_series(
    rets: DataFrame, windows: Sequence[int], confidence: Sequence[float], horizons: Sequence[int],
    scaling: str = "sqrt_time", step: int = 1, lag: int = 0,
) -> DataFrame:
    """Variance-covariance VaR: max(0, -mu + z sigma) scaled to the horizon.

    ``lag=0`` includes the day itself in its window, ``lag=1`` leaves it out.
    """
    m = rolling_moments(rets, list(windows), step=step, lag=lag)
    out = fan_out(m, normal_grid(confidence, horizons))
    var = F.when(F.col("sigma") > 0, F.greatest(F.lit(0.0), -(F.col("mu") + F.col("z") * F.col("sigma"))) * horizon_scale(F.col("horizon"), scaling))
    return out.select("asset", "date", "r", "estimation_window", "confidence_level", "horizon", var.alias("var"))


def historical_var_cvar(rets: DataFrame, keys: Sequence[str], confidence: Sequence[float], value: str = "r") -> DataFrame:
    """-(1-c) percentile of returns and the mean loss at or beyond it, per key."""
    alphas = [1 - c for c in confidence]
    q = rets.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(a) for a in alphas])).alias("q"))
    q = q.select(*keys, F.posexplode("q").alias("pos", "q")).withColumn("confidence_level", F.element_at(F.array(*[F.lit(c) for c in confidence]), F.col("pos") + 1))
    joined = rets.join(q, list(keys))
    return joined.groupBy(*keys, "confidence_level").agg(
        (-F.first("q")).alias("var"), (-F.avg(F.when(F.col(value) <= F.col("q"), F.col(value)))).alias("cvar")
    )


def parametric_var_cvar(rets: DataFrame, keys: Sequence[str], confidence: Sequence[float], value: str = "r") -> DataFrame:
    """Closed-form normal VaR and expected shortfall per key."""
    m = rets.groupBy(*keys).agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sigma"))
    out = fan_out(m, normal_grid(confidence, [1])).drop("horizon")
    return out.select(
        *keys, "confidence_level", (-(F.col("mu") + F.col("z") * F.col("sigma"))).alias("var"),
        (-F.col("mu") + F.col("es") * F.col("sigma")).alias("cvar"),
    )


def order_statistic_var_cvar(losses: Column, confidence: Column) -> Column:
    """VaR at rank floor(c n) of an array of losses, CVaR as the tail mean, both floored.

    A negative order statistic means the tail holds gains only: VaR is 0 there.
    """
    n = F.size(losses)
    idx = F.greatest(F.lit(0), F.least(F.floor(confidence * n).cast("int"), n - 1))
    var = F.greatest(F.lit(0.0), F.get(F.sort_array(losses), idx))
    packed = F.struct(var.alias("v"), losses.alias("l"))

    def finish(p: Column) -> Column:
        tail = F.filter(p["l"], lambda x: x >= p["v"])
        mean = F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(tail), F.lit(1))
        return F.struct(p["v"].alias("var"), F.when(F.size(tail) > 0, F.greatest(p["v"], mean)).otherwise(p["v"]).alias("cvar"))

    return F.element_at(F.transform(F.array(packed), finish), 1)


def order_statistic_by_group(df: DataFrame, keys: Sequence[str], confidence: Sequence[float], loss: str = "loss") -> DataFrame:
    """``order_statistic_var_cvar`` for long tables: ranks within the key, then a conditional mean."""
    ranked = df.withColumn("rk", F.row_number().over(Window.partitionBy(*keys).orderBy(loss)) - 1)
    ranked = ranked.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    out = fan_out(ranked, literal_rows([{"confidence_level": c} for c in confidence]))
    idx = F.least(F.floor(F.col("confidence_level") * F.col("n")), F.col("n") - 1)
    v = F.greatest(F.lit(0.0), F.max(F.when(F.col("rk") == idx, F.col(loss))).over(Window.partitionBy(*keys, "confidence_level")))
    out = out.withColumn("var", v)
    agg = out.groupBy(*keys, "confidence_level").agg(
        F.first("var").alias("var"), F.avg(F.when(F.col(loss) >= F.col("var"), F.col(loss))).alias("tail")
    )
    return agg.select(*keys, "confidence_level", "var", F.greatest("var", F.coalesce("tail", "var")).alias("cvar"))


def quantile_var_cvar(losses: DataFrame, keys: Sequence[str], confidence: Sequence[float], loss: str = "loss") -> DataFrame:
    """Interpolated loss quantile and the mean loss at or beyond it."""
    q = losses.groupBy(*keys).agg(F.percentile(loss, F.array(*[F.lit(c) for c in confidence])).alias("q"))
    q = q.select(*keys, F.posexplode("q").alias("pos", "var")).withColumn("confidence_level", F.element_at(F.array(*[F.lit(c) for c in confidence]), F.col("pos") + 1))
    return losses.join(q, list(keys)).groupBy(*keys, "confidence_level").agg(
        F.first("var").alias("var"), F.avg(F.when(F.col(loss) >= F.col("var"), F.col(loss))).alias("cvar")
    )


def volatility_to_risk(vols: DataFrame, grid: Column, sigma: str = "sigma") -> DataFrame:
    """Volatility forecasts to VaR and expected shortfall through literal constants."""
    out = fan_out(vols, grid)
    s = F.col(sigma) * horizon_scale(F.col("horizon"))
    return out.withColumn("var", -F.col("z") * s).withColumn("cvar", F.col("es") * s).drop("z", "es")


def ewma_var_cvar(rets: DataFrame, window: int, confidence: Sequence[float], horizons: Sequence[int], lam: float = 0.94, step: int = 1, floor: float = 1e-12) -> DataFrame:
    """EWMA next-step volatility of each window end turned into VaR and CVaR."""
    w = window_arrays(rets, window, step)
    vols = w.select("asset", "date", F.col("current").alias("r"), F.sqrt(F.greatest(ewma_next_variance(F.col("w"), lam), F.lit(floor))).alias("sigma"))
    out = volatility_to_risk(vols, normal_grid(confidence, horizons))
    return out.withColumn("estimation_window", F.lit(window))


def historical_var_series(rets: DataFrame, window: int, confidence: Sequence[float], horizons: Sequence[int], step: int = 1) -> DataFrame:
    """Rolling historical VaR/CVaR per window end, square-root-of-time scaled."""
    from riskloom.functions.columns import array_quantile

    w = window_arrays(rets, window, step).withColumn("s", F.sort_array(F.transform("w", lambda x: -x)))
    out = fan_out(w, literal_rows([{"confidence_level": c, "horizon": h} for c in confidence for h in horizons]))
    out = out.withColumn("v", array_quantile(F.col("s"), F.col("confidence_level")))
    tail = F.filter("s", lambda x: x >= F.col("v"))
    mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)
    scale = horizon_scale(F.col("horizon"))
    return out.select(
        "asset", "date", F.col("current").alias("r"), F.lit(window).alias("estimation_window"), "confidence_level", "horizon",
        (F.greatest("v", F.lit(0.0)) * scale).alias("var"), (F.greatest(mean, F.lit(0.0)) * scale).alias("cvar"),
    )


def confidence_sensitivity(rets: DataFrame, keys: Sequence[str], confidence: Sequence[float] = (0.9, 0.95, 0.99), value: str = "r") -> DataFrame:
    """VaR/CVaR at several levels with the change against the first level."""
    base = historical_var_cvar(rets, keys, confidence, value)
    order = Window.partitionBy(*keys).orderBy("confidence_level")
    return base.withColumn("var_step", F.col("var") - F.lag("var").over(order)).withColumn("cvar_step", F.col("cvar") - F.lag("cvar").over(order))


def tail_mean_of_scores(scores: DataFrame, keys: Sequence[str], alpha: float, score: str = "energy") -> DataFrame:
    """Mean of the largest max(1, int((1-alpha) n)) scores per key."""
    n = F.count("*").over(Window.partitionBy(*keys))
    rk = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score)))
    keep = scores.withColumn("n", n).withColumn("rk", rk).filter(F.col("rk") <= F.greatest(F.lit(1), F.floor((1 - alpha) * F.col("n"))))
    return keep.groupBy(*keys).agg(F.avg(score).alias("tail_mean"), F.count("*").alias("n_tail"))


def portfolio_volatility_no_correlation(weights: DataFrame, vols: DataFrame, max_cells: int = MAX_INLINE_CELLS) -> DataFrame:
    """sqrt(sum w^2 sigma^2) per portfolio and date, on dates complete for its assets; a large panel is joined instead."""
    squares = paths.inline_panel(vols.select("asset", "date", (F.col("sigma") * F.col("sigma")).alias("s2")), "s2", max_cells)
    if squares is not None:
        return paths.root_of_squares(weights.filter("w > 0"), squares)
    held = weights.filter("w > 0").withColumn("held", F.count("*").over(Window.partitionBy("portfolio_id")))
    j = held.join(vols, "asset")
    return j.groupBy("portfolio_id", "date").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w") * F.col("sigma") * F.col("sigma"))).alias("volatility"),
        F.count("sigma").alias("found"), F.first("held").alias("held"),
    ).filter("found = held").drop("found", "held")
