"""Grid-fitted volatility models: GARCH(1,1) and Student-t degrees of freedom."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import constants as K
from riskloom.functions.columns import array_mean, fan_out, literal_rows, ratio
from riskloom.operators.rolling import window_arrays


def garch_grid(alphas: Sequence[float] = (0.02, 0.05, 0.08, 0.12, 0.18), betas: Sequence[float] = (0.7, 0.78, 0.84, 0.88, 0.92, 0.95)) -> list[dict]:
    """Stationary (alpha, beta) pairs."""
    return [{"alpha": a, "beta": b} for a in alphas for b in betas if a + b < 0.999]


def garch_forecasts(rets: DataFrame, window: int, step: int, grid: Sequence[dict] | None = None, lag: int = 1) -> DataFrame:
    """Best GARCH(1,1) of every window end by Gaussian likelihood over the grid.

    omega is targeted to the sample variance.  Each (window, grid point) is one
    row and one fold; the winner is kept by a map-side ``max_by``.  Windows leave
    the current row out (``lag=1``), so the forecast is for the row's own date.
    """
    w = window_arrays(rets, window, step, lag)
    # The array binds the mean, which would be worked out again for every value otherwise.
    w = w.withColumn("e2", F.transform(F.array(array_mean(F.col("w"))), lambda mu: F.transform("w", lambda r: (r - mu) * (r - mu)))[0]).drop("w")
    w = w.withColumn("target", array_mean(F.col("e2")))
    g = fan_out(w, literal_rows(list(grid or garch_grid())))
    g = g.withColumn("omega", F.col("target") * (1 - F.col("alpha") - F.col("beta")))
    start = F.struct(F.col("target").alias("v"), F.lit(0.0).alias("ll"))

    def step_fn(s: Column, e2: Column) -> Column:
        ll = s["ll"] - 0.5 * (F.log(s["v"]) + e2 / s["v"])
        return F.struct((F.col("omega") + F.col("alpha") * e2 + F.col("beta") * s["v"]).alias("v"), ll.alias("ll"))

    g = g.withColumn("fit", F.when(F.col("target") > 0, F.aggregate("e2", start, step_fn)))
    # The variance that applied to the window's last value, recovered from the forecast.
    last_v = (F.col("fit.v") - F.col("omega") - F.col("alpha") * F.element_at("e2", -1)) / F.col("beta")
    choice = F.struct("alpha", "beta", "omega", F.sqrt(last_v).alias("sigma_last"), F.sqrt("fit.v").alias("forecast"), F.col("fit.ll").alias("log_likelihood"))
    best = g.groupBy("asset", "date").agg(F.first("current").alias("r"), F.first("target").alias("target"), F.max_by(choice, F.struct("fit.ll", -F.col("alpha"), -F.col("beta"))).alias("b"))
    return best.select(
        "asset", "date", "r", "b.omega", "b.alpha", "b.beta", (F.col("b.alpha") + F.col("b.beta")).alias("persistence"),
        F.col("target").alias("unconditional_variance"), "b.sigma_last", F.coalesce("b.forecast", F.sqrt("target")).alias("sigma"), "b.log_likelihood",
    )


def garch_diagnostics(params: DataFrame) -> DataFrame:
    """Half-life of shocks, long-run volatility and stationarity flag."""
    p = F.col("persistence")
    return params.withColumn("half_life", F.when((p > 0) & (p < 1), math.log(0.5) / F.log(p))).withColumn(
        "long_run_volatility", F.sqrt(ratio(F.col("omega"), 1 - p))
    ).withColumn("stationary", p < 1)


def student_dof(rets: DataFrame, window: int, step: int, dofs: Sequence[float] = (2.1, 3, 4, 5, 6, 8, 10, 15, 20, 30, 50)) -> DataFrame:
    """Degrees of freedom by likelihood over a bounded grid, with matched location and scale."""
    w = window_arrays(rets, window, step).withColumn("mu", array_mean(F.col("w")))
    squares = F.transform(F.array(array_mean(F.col("w"))), lambda mu: F.aggregate("w", F.lit(0.0), lambda s, r: s + (r - mu) * (r - mu)))[0]
    var = squares / (F.size("w") - 1)
    w = w.withColumn("sigma", F.sqrt(var)).filter("sigma > 0")
    rows = [
        {"dof": float(v), "shrink": math.sqrt((v - 2) / v), "norm": math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi)} for v in dofs
    ]
    g = fan_out(w, literal_rows(rows)).withColumn("scale", F.col("sigma") * F.col("shrink"))

    def term(s: Column, r: Column) -> Column:
        z = (r - F.col("mu")) / F.col("scale")
        return s - (F.col("dof") + 1) / 2 * F.log1p(z * z / F.col("dof"))

    g = g.withColumn("ll", F.aggregate("w", F.lit(0.0), term) + F.size("w") * (F.col("norm") - F.log("scale")))
    best = g.groupBy("asset", "date").agg(F.first("current").alias("r"), F.max_by(F.struct("dof", "mu", "scale", "ll"), F.struct("ll", -F.col("dof"))).alias("b"))
    return best.select("asset", "date", "r", "b.dof", "b.mu", "b.scale", F.col("b.ll").alias("log_likelihood"))


def student_var_cvar(fits: DataFrame, confidence: Sequence[float], dofs: Sequence[float] = (2.1, 3, 4, 5, 6, 8, 10, 15, 20, 30, 50), band: float = 0.05) -> DataFrame:
    """VaR, CVaR and a +-``band`` interval of the fitted Student-t loss.

    Constants of each (confidence, dof) pair ride along as a literal array.
    """
    rows = [{"cdof": float(v), "confidence_level": c, "q": K.t_quantile(c, v), "es": K.es_factor_t(c, v)} for v in dofs for c in confidence]
    out = fan_out(fits, literal_rows(rows)).filter("cdof = dof")
    out = out.withColumn("var", -F.col("mu") + F.col("q") * F.col("scale")).withColumn("cvar", -F.col("mu") + F.col("es") * F.col("scale"))
    return out.withColumn("var_low", F.col("var") * (1 - band)).withColumn("var_high", F.col("var") * (1 + band)).drop("cdof", "q", "es")


def forecast_bias(fits: DataFrame, forecast: str = "sigma", actual: str = "sigma_last") -> DataFrame:
    """Mean error and RMSE of forecast volatility against the conditional volatility, both columns of the fit."""
    d = F.col(forecast) - F.col(actual)
    return fits.where(d.isNotNull()).groupBy("asset").agg(F.avg(d).alias("mean_error"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count("*").alias("n"))
