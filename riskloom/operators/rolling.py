"""Returns and rolling estimators per asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import ratio
from riskloom.functions.constants import TRADING_DAYS
from riskloom.session import spread


def by_asset():
    return Window.partitionBy("asset").orderBy("date")


def rows(n: int, lag: int = 0):
    """Frame of the last ``n`` rows; ``lag=1`` leaves the current row out."""
    return by_asset().rowsBetween(-(n - 1) - lag, -lag)


def returns(prices: DataFrame, kind: str = "log") -> DataFrame:
    """(asset, date, r): log or simple one-period returns, first row dropped."""
    previous = F.lag("price").over(by_asset())
    r = F.log(F.col("price") / previous) if kind == "log" else F.col("price") / previous - 1
    return prices.withColumn("r", r).filter(F.col("r").isNotNull()).select("asset", "date", "r")


def rolling_moments(rets: DataFrame, windows: list[int], population: bool = False, step: int = 1, lag: int = 0) -> DataFrame:
    """Rolling mean and volatility for several windows, warm-up rows left out.

    All windows are computed in one pass over the same (asset, date) order and
    then fanned out to rows.
    """
    std = F.stddev_pop if population else F.stddev_samp
    parts = []
    for w in windows:
        f = rows(w, lag)
        parts.append(
            F.struct(
                F.lit(w).alias("estimation_window"), F.count("r").over(f).alias("n"),
                F.avg("r").over(f).alias("mu"), std("r").over(f).alias("sigma"),
            )
        )
    out = rets.withColumn("rn", F.row_number().over(by_asset())).withColumn("m", F.array(*parts))
    out = out.select("asset", "date", "r", "rn", F.inline("m")).filter(F.col("n") >= F.col("estimation_window"))
    # Thinning counts from the first full window, as a loop with a stride would.
    return out.filter((F.col("rn") - F.col("estimation_window") - lag) % step == 0).drop("n", "rn") if step > 1 else out.drop("n", "rn")


def annualised_mean_last(rets: DataFrame, window: int, periods: float = TRADING_DAYS) -> DataFrame:
    """Annualised mean of the last ``window`` rows of each asset."""
    tail = rets.withColumn("back", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date")))).filter(F.col("back") <= window)
    return tail.groupBy("asset").agg((F.avg("r") * periods).alias("mu"), F.max("date").alias("date"))


def rolling_quantile(rets: DataFrame, window: int, q: float, value: str = "loss") -> DataFrame:
    f = rows(window)
    out = rets.withColumn("threshold", F.percentile(value, F.lit(q)).over(f)).withColumn("n", F.count(value).over(f))
    return out.filter(F.col("n") == window).drop("n")


def window_arrays(rets: DataFrame, window: int, step: int = 1, lag: int = 0, value: str = "r") -> DataFrame:
    """(asset, date, w): the window's values oldest first, for folds that need order.

    Bounded by ``window``; spread over tasks by (asset, date) because the folds
    that follow are the expensive part and there may be few assets.
    """
    f = rows(window, lag)
    out = rets.withColumn("rn", F.row_number().over(by_asset())).withColumn("w", F.collect_list(value).over(f))
    out = out.filter((F.size("w") == window) & ((F.col("rn") - window - lag) % step == 0))
    return spread(out.select("asset", "date", F.col(value).alias("current"), "w"), "asset", "date")


def ewma_next_variance(w: Column, lam: float) -> Column:
    """One-step variance forecast of the recursion started at the first squared value."""
    start = F.struct(F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("p"))

    def step(s: Column, r: Column) -> Column:
        nxt = F.when(s["s"].isNull(), r * r).otherwise(lam * s["s"] + (1 - lam) * s["p"] * s["p"])
        return F.struct(nxt.alias("s"), r.alias("p"))

    return F.aggregate(w, start, step, lambda s: lam * s["s"] + (1 - lam) * s["p"] * s["p"])


def ewma_variances(w: Column, lam: float) -> Column:
    """Variance path of the recursion, one entry per value of the window."""

    def step(acc: Column, r: Column) -> Column:
        prev = F.element_at(acc["v"], -1)
        nxt = F.when(F.size(acc["v"]) == 0, r * r).otherwise(lam * prev + (1 - lam) * acc["p"] * acc["p"])
        return F.struct(F.concat(acc["v"], F.array(nxt)).alias("v"), r.alias("p"))

    start = F.struct(F.array().cast("array<double>").alias("v"), F.lit(0.0).alias("p"))
    return F.aggregate(w, start, step, lambda s: s["v"])


def standardised_residuals(w: Column, variances: Column, mean: Column, floor: float = 1e-12) -> Column:
    """(r - mean) / sigma_t for each value of the window."""
    return F.zip_with(w, variances, lambda r, v: (r - mean) / (F.sqrt(F.greatest(v, F.lit(floor))) + 1e-10))


def pair_returns(rets: DataFrame, ordered: bool = True) -> DataFrame:
    """(date, i, j, ri, rj) for every unordered pair of assets on the same date.

    The day's assets are gathered into one row (bounded by the universe) and
    paired inside it, so no self-join shuffles the panel twice.
    """
    day = rets.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("asset", "r"))).alias("xs"))
    out = day.select("date", "xs", F.explode("xs").alias("a")).select("date", "a", F.explode("xs").alias("b"))
    keep = F.col("a.asset") <= F.col("b.asset") if ordered else F.lit(True)
    return out.filter(keep).select(
        "date", F.col("a.asset").alias("i"), F.col("b.asset").alias("j"), F.col("a.r").alias("ri"), F.col("b.r").alias("rj")
    )


def rolling_pair_stats(rets: DataFrame, window: int) -> DataFrame:
    """Rolling covariance and correlation of every pair at every full window end."""
    f = Window.partitionBy("i", "j").orderBy("date").rowsBetween(-(window - 1), 0)
    out = pair_returns(rets).select(
        "date", "i", "j", F.covar_samp("ri", "rj").over(f).alias("cov"),
        F.corr("ri", "rj").over(f).alias("corr"), F.count("*").over(f).alias("n"),
    )
    return out.filter(F.col("n") == window).drop("n")


def drawdown_series(rets: DataFrame, key: str = "asset") -> DataFrame:
    """Cumulative growth, running peak and drawdown of simple returns."""
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = rets.withColumn("growth", F.exp(F.sum(F.log1p("r")).over(w)))
    out = out.withColumn("peak", F.max("growth").over(w))
    return out.withColumn("drawdown", F.col("growth") / F.col("peak") - 1)


def longest_negative_run(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Longest stretch of consecutive negative periods per key (gaps and islands)."""
    neg = F.col(value) < 0
    a = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    b = F.row_number().over(Window.partitionBy(*keys, neg).orderBy(order))
    runs = series.withColumn("neg", neg).withColumn("island", a - b).groupBy(*keys, "neg", "island").agg(F.count("*").alias("len"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("neg"), F.col("len"))), F.lit(0)).alias("longest_negative_run"))


def squared_autocorrelation(rets: DataFrame, lags: range = range(1, 6), key: str = "asset") -> DataFrame:
    """Autocorrelation of squared returns for several lags, one pass."""
    w = Window.partitionBy(key).orderBy("date")
    out = rets.withColumn("sq", F.col("r") * F.col("r"))
    for k in lags:
        out = out.withColumn(f"l{k}", F.lag("sq", k).over(w))
    wide = out.groupBy(key).agg(*[F.corr("sq", f"l{k}").alias(str(k)) for k in lags])
    return wide.unpivot([key], [str(k) for k in lags], "lag", "acf").withColumn("lag", F.col("lag").cast("int"))


def turnover(weights: DataFrame, order: str = "rebalance") -> DataFrame:
    """Sum of absolute weight changes between consecutive rebalances."""
    w = Window.partitionBy("portfolio_id", "asset").orderBy(order)
    moved = weights.withColumn("delta", F.abs(F.col("w") - F.lag("w").over(w))).filter(F.col("delta").isNotNull())
    return moved.groupBy("portfolio_id", order).agg(F.sum("delta").alias("turnover"))


def latest_per_key(df: DataFrame, keys: list[str], order: str = "date") -> DataFrame:
    """The row with the largest ``order`` value of each key."""
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("s"))
    return best.select(*keys, *[F.col(f"s.{c}").alias(c) for c in cols])


def block_stability(df: DataFrame, order: str, value: str, block: int) -> DataFrame:
    """Mean shift and rank correlation between the last two blocks of ``block`` rows.

    Only the last ``2 * block`` rows are ordered, so the sort is a top-k.
    """
    tail = df.select(order, value).orderBy(F.desc(order)).limit(2 * block)
    tail = tail.withColumn("back", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(order))))
    tail = tail.withColumn("blk", F.when(F.col("back") <= block, 1).otherwise(0)).withColumn("pos", (F.col("back") - 1) % block)
    tail = tail.withColumn("rk", F.rank().over(Window.partitionBy("blk").orderBy(value)) + (F.count("*").over(Window.partitionBy("blk", value)) - 1) / 2.0)
    pairs = tail.groupBy("pos").agg(
        F.max(F.when(F.col("blk") == 0, F.col(value))).alias("v0"), F.max(F.when(F.col("blk") == 1, F.col(value))).alias("v1"),
        F.max(F.when(F.col("blk") == 0, F.col("rk"))).alias("k0"), F.max(F.when(F.col("blk") == 1, F.col("rk"))).alias("k1"),
    )
    return pairs.agg(
        F.avg("v0").alias("mean_previous"), F.avg("v1").alias("mean_last"),
        ratio(F.abs(F.avg("v1") - F.avg("v0")), F.abs(F.avg("v0"))).alias("relative_change"),
        F.corr("k0", "k1").alias("rank_stability"),
    )
