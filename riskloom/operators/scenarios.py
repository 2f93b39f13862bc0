"""Scenario tables: historical, bootstrap, parametric and filtered paths.

Draws are digests of (seed, asset, date, simulation, step), so a retried or
re-partitioned task reproduces its paths.  A simulation is one row carrying its
window; paths are built on the row and nothing is joined.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import array_mean, array_sum, ratio, uniform_draw
from riskloom.operators.rolling import ewma_next_variance, ewma_variances, standardised_residuals
from riskloom.session import spread

BLOCKS = 64


def historical_scenarios(rets: DataFrame, window: int, sample: int | None = None, seed: int = 7) -> DataFrame:
    """(scenario_id, date, asset, r): the last ``window`` dates, optionally ``sample`` of them without replacement."""
    dates = rets.select("date").distinct().orderBy(F.desc("date")).limit(window)
    if sample is not None:
        dates = dates.orderBy(uniform_draw(seed, F.col("date")), "date").limit(sample)
    ids = dates.withColumn("scenario_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))  # at most ``window`` rows
    return rets.join(ids, "date").select("scenario_id", "date", "asset", "r")


def simulations(windows: DataFrame, n_sims: int) -> DataFrame:
    """One row per (asset, date, sim), spread over the cluster before it fans out."""
    blocks = windows.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(min(BLOCKS, n_sims) - 1))))
    blocks = spread(blocks, "asset", "date", "__b")
    sims = F.sequence(F.col("__b") + 1, F.lit(n_sims), F.lit(min(BLOCKS, n_sims)))
    return blocks.withColumn("sim", F.explode(sims)).drop("__b")


def _steps(horizon: int) -> Column:
    return F.sequence(F.lit(1), F.lit(horizon))


def _u(seed: int, tag: str, step: Column) -> Column:
    return uniform_draw(seed, F.lit(tag), F.col("asset"), F.col("date"), F.col("sim"), step)


def _index(u: Column, n: Column) -> Column:
    return F.floor(u * n).cast("int")


def iid_paths(sims: DataFrame, horizon: int, seed: int = 7, source: str = "w") -> DataFrame:
    path = F.transform(_steps(horizon), lambda k: F.get(source, _index(_u(seed, "iid", k), F.size(source))))
    return sims.withColumn("path", path)


def block_paths(sims: DataFrame, horizon: int, block: int | None = None, seed: int = 7) -> DataFrame:
    """Consecutive stretches of ``block`` values (default min(sqrt(n), 20)) from hashed starts."""
    length = F.lit(block) if block else F.least(F.floor(F.sqrt(F.size("w"))), F.lit(20)).cast("int")

    def value(k: Column) -> Column:
        b = F.floor((k - 1) / length).cast("int")
        start = _index(_u(seed, "block", b), F.size("w") - length + 1)
        return F.get("w", start + F.pmod(k - 1, length))

    return sims.withColumn("path", F.transform(_steps(horizon), value))


def _normal_draw(seed: int, k: Column) -> Column:
    return F.sqrt(-2 * F.log(_u(seed, "a", k))) * F.cos(2 * math.pi * _u(seed, "b", k))


def _with_moments(sims: DataFrame) -> DataFrame:
    s = sims.withColumn("mu", array_mean(F.col("w")))
    ss = F.transform(F.array(array_mean(F.col("w"))), lambda mu: F.aggregate("w", F.lit(0.0), lambda a, x: a + (x - mu) * (x - mu)))[0]
    return s.withColumn("sigma", F.sqrt(ss / (F.size("w") - 1)))


def normal_paths(sims: DataFrame, horizon: int, seed: int = 7) -> DataFrame:
    s = _with_moments(sims)
    return s.withColumn("path", F.transform(_steps(horizon), lambda k: F.col("mu") + F.col("sigma") * _normal_draw(seed, k)))


def student_paths(sims: DataFrame, horizon: int, dof: float, seed: int = 7) -> DataFrame:
    """Student-t steps with the window's mean and standard deviation."""
    s = _with_moments(sims)
    scale = math.sqrt((dof - 2) / dof)

    def value(k: Column) -> Column:
        t = F.sqrt(dof * (F.pow(_u(seed, "a", k), F.lit(-2.0 / dof)) - 1)) * F.cos(2 * math.pi * _u(seed, "b", k))
        return F.col("mu") + F.col("sigma") * scale * t

    return s.withColumn("path", F.transform(_steps(horizon), value))


def filtered_paths(windows: DataFrame, n_sims: int, horizon: int, lam: float = 0.94, seed: int = 7, floor: float = 1e-12) -> DataFrame:
    """Resampled EWMA-standardised residuals, variance rolled forward along each path.

    Residuals and the starting variance are worked out once per window, before it
    fans out to simulations.
    """
    w = windows.withColumn("mu", array_mean(F.col("w"))).withColumn("v", ewma_variances(F.col("w"), lam))
    w = w.withColumn("z", standardised_residuals(F.col("w"), F.col("v"), F.col("mu"), floor)).withColumn("v0", ewma_next_variance(F.col("w"), lam))
    sims = simulations(w.select("asset", "date", "mu", "z", "v0"), n_sims)
    draws = F.transform(_steps(horizon), lambda k: F.get("z", _index(_u(seed, "iid", k), F.size("z"))))
    start = F.struct(F.col("v0").alias("v"), F.array().cast("array<double>").alias("path"))

    def step(s: Column, z: Column) -> Column:
        r = F.col("mu") + F.sqrt(F.greatest(s["v"], F.lit(floor))) * z
        return F.struct((lam * s["v"] + (1 - lam) * r * r).alias("v"), F.concat(s["path"], F.array(r)).alias("path"))

    return sims.withColumn("draws", draws).withColumn("path", F.aggregate("draws", start, step, lambda s: s["path"])).drop("draws")


def horizon_sums(paths: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Cumulative return of every path at each horizon: one path set serves all horizons."""
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), array_sum(F.slice("path", 1, h)).alias("total")) for h in horizons])
    return paths.select("asset", "date", "sim", F.inline(rows))


def scenario_risk(sums: DataFrame, confidence: Sequence[float], keys: Sequence[str] = ("asset", "date", "horizon")) -> DataFrame:
    """Order-statistic VaR and CVaR of simulated totals, per key.

    Simulations are ranked inside their key; the key includes asset, window end
    and horizon, so a group is exactly the simulation count.
    """
    from riskloom.operators.risk import order_statistic_by_group

    return order_statistic_by_group(sums.withColumn("loss", -F.col("total")), list(keys), confidence)


def random_portfolios(ids: DataFrame, universe: Column, seed: int = 7) -> DataFrame:
    """(portfolio_id, asset, w): 2..n active assets with flat Dirichlet weights.

    Assets are ordered by a draw inside the portfolio's row and the first k kept.
    """
    p = ids.withColumn("u", universe)
    k = 2 + F.floor(uniform_draw(seed, F.lit("k"), F.col("portfolio_id")) * (F.size("u") - 1)).cast("int")
    ranked = F.array_sort(F.transform("u", lambda a: F.struct(uniform_draw(seed, F.lit("r"), F.col("portfolio_id"), a).alias("o"), a.alias("asset"))))
    p = p.select("portfolio_id", F.slice(ranked, 1, k).alias("picked"))
    e = F.transform("picked", lambda x: F.struct(x["asset"].alias("asset"), (-F.log(uniform_draw(seed, F.lit("w"), F.col("portfolio_id"), x["asset"]))).alias("e")))
    p = p.withColumn("e", e)
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x["e"])
    p = p.withColumn("total", total)
    return p.select("portfolio_id", "total", F.explode("e").alias("x")).select("portfolio_id", F.col("x.asset").alias("asset"), ratio(F.col("x.e"), F.col("total")).alias("w"))
