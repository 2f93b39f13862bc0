"""Portfolio selection as table jobs over candidate portfolios."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import fan_out, literal_rows, ratio
from riskloom.operators.factors import mirror
from riskloom.operators.portfolio import MAX_UNROLLED, asset_sets, evaluate, is_invested, quadratic_form, set_dictionary
from riskloom.session import materialise
from riskloom.sources.portfolios import weight_arrays


def best_candidates(scored: DataFrame, keys: Sequence[str], risk_aversion: float = 1.0) -> DataFrame:
    """Minimum-variance, risk-return and maximum-Sharpe candidate per key.

    One aggregate with map-side ``min_by``/``max_by``; ties go to the smaller id.
    Candidates without a variance (no known asset) never win.
    """
    scored = scored.where("variance IS NOT NULL")
    pid = F.col("portfolio_id")
    objective = risk_aversion * F.col("variance") - F.col("expected_return")
    return scored.groupBy(*keys).agg(
        F.min_by("portfolio_id", F.struct("variance", pid)).alias("min_variance_id"), F.min("variance").alias("min_variance"),
        F.min_by("portfolio_id", F.struct(objective, pid)).alias("trade_off_id"), F.min(objective).alias("trade_off_objective"),
        F.max_by("portfolio_id", F.struct("ex_ante_sharpe", -pid)).alias("max_sharpe_id"), F.max("ex_ante_sharpe").alias("max_sharpe"),
    )


def frontier(scored: DataFrame, ret: str, risk: str, buckets: int) -> DataFrame:
    """Lowest-risk candidate in each of ``buckets`` even target-return ranges; candidates without risk or return are left out."""
    scored = scored.where(F.col(ret).isNotNull() & F.col(risk).isNotNull())
    span = scored.agg(F.struct(F.min(ret).alias("lo"), F.max(ret).alias("hi")).alias("s")).scalar()
    s = scored.withColumn("__s", span)
    width = (F.col("__s.hi") - F.col("__s.lo")) / buckets
    b = F.least(F.lit(buckets - 1), F.coalesce(F.floor(ratio(F.col(ret) - F.col("__s.lo"), width)), F.lit(0))).cast("int")
    best = F.min_by(F.struct("portfolio_id", F.col(ret).alias("target_return"), F.col(risk).alias("risk")), F.struct(risk, "portfolio_id"))
    return s.groupBy(b.alias("bucket")).agg(best.alias("k"), F.count("*").alias("candidates")).select("bucket", "k.*", "candidates")


def frontier_is_monotone(points: DataFrame, ret: str = "target_return", risk: str = "risk") -> DataFrame:
    """Is return non-decreasing in risk along the frontier (one row per bucket)?"""
    prev = F.lag(ret).over(Window.partitionBy(F.lit(0)).orderBy(risk, ret))
    c = points.withColumn("ok", F.coalesce(F.col(ret) >= prev, F.lit(True)))
    return c.agg(F.every("ok").alias("monotone"), F.count_if(~F.col("ok")).alias("violations"), F.count("*").alias("points"))


def cvar_scores(weights: DataFrame, scenario_returns: DataFrame, confidence: float = 0.95, cvar_weight: float = 1.0, mean_weight: float = 1.0) -> DataFrame:
    """Objective cvar_weight * CVaR - mean_weight * mean of every candidate on a scenario table."""
    s = evaluate(weights, scenario_returns, alpha=1 - confidence)
    out = s.select("portfolio_id", F.col("mean").alias("mean_return"), F.col("conditional_value_at_risk").alias("cvar"))
    return out.withColumn("objective", cvar_weight * F.col("cvar") - mean_weight * F.col("mean_return"))


def best_by(scores: DataFrame, objective: str, k: int = 1, largest: bool = False) -> DataFrame:
    order = F.desc(objective) if largest else F.asc(objective)
    return scores.where(F.col(objective).isNotNull()).orderBy(order, "portfolio_id").limit(k)


def rebalance_calendar(dates: DataFrame, every: int | None = None, start: int = 1) -> DataFrame:
    """Month-end dates, or every ``every``-th date beginning with number ``start``.

    ``dates`` is the trading calendar (one row per date).
    """
    if every is None:
        return dates.groupBy(F.trunc("date", "month").alias("__m")).agg(F.max("date").alias("date")).select("date")
    cal = dates.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("c"))
    return cal.select(F.posexplode("c").alias("pos", "date")).filter((F.col("pos") + 1 >= start) & ((F.col("pos") + 1 - start) % every == 0)).select("date")


def as_of(left: DataFrame, right: DataFrame, key: str, mode: str = "backward") -> DataFrame:
    """Match each (key, date) of ``left`` with a date of ``right``.

    ``backward`` the last date not after it, ``forward`` the next date or else the
    last, ``nearest`` the closer of both (earlier on a tie).  The two tables are
    merged in date order and the match is carried along, so no range join is
    needed.
    """
    both = left.select(key, "date", F.lit(1).alias("__side")).unionByName(right.select(key, "date", F.lit(0).alias("__side")))
    w = Window.partitionBy(key).orderBy("date", "__side")
    mark = F.when(F.col("__side") == 0, F.col("date"))
    back = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(mark, ignorenulls=True).over(Window.partitionBy(key).orderBy("date", F.desc("__side")).rowsBetween(0, Window.unboundedFollowing))
    m = both.withColumn("__b", back).withColumn("__a", ahead).filter("__side = 1")
    b, a = F.col("__b"), F.col("__a")
    if mode == "backward":
        pick = b
    elif mode == "forward":
        pick = F.coalesce(a, b)
    else:
        pick = F.when(b.isNull(), a).when(a.isNull(), b).when(F.date_diff("date", b) <= F.date_diff(a, F.col("date")), b).otherwise(a)
    return m.select(key, "date", pick.alias("matched"))


def set_covariance(sets: DataFrame, cov: DataFrame) -> DataFrame:
    """(set_id, assets, cells): the covariance entries of each asset set as one array per set."""
    legs = sets.select("set_id", "assets", F.explode("assets").alias("i")).select("set_id", "assets", "i", F.explode("assets").alias("j"))
    full = materialise(mirror(cov.select("i", "j", "cov")), "covariance")
    return legs.join(full, ["i", "j"]).groupBy("set_id").agg(F.first("assets").alias("assets"), F.array_sort(F.collect_list(F.struct("i", "j", "cov"))).alias("cells"))


def dense(assets, cells):
    """Square matrix from sorted (i, j, cov) cells."""
    import numpy as np

    n = len(assets)
    return np.array([c["cov"] for c in cells], dtype=float).reshape(n, n)


def equal_risk_weights(sets: DataFrame, cov: DataFrame, tolerance: float = 1e-10, max_iter: int = 500) -> DataFrame:
    """Equal-risk-contribution weights of every asset set, all sets in one distributed pass.

    The damped fixed point w <- normalise(sqrt(w / (S w))) runs per set, where its
    small matrix lives; the remaining gap is reported.
    """
    import numpy as np

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for set_id, assets, cells in zip(pdf["set_id"], pdf["assets"], pdf["cells"]):
                s, n = dense(assets, cells), len(assets)
                w, it = np.full(n, 1.0 / n), 0
                for it in range(1, max_iter + 1):
                    sw = np.maximum(s @ w, 1e-12)
                    nxt = np.sqrt(w / sw)
                    nxt /= nxt.sum()
                    moved = np.abs(nxt - w).max()
                    w = nxt
                    if moved < tolerance:
                        break
                vol = float(np.sqrt(w @ s @ w))
                rc = w * (s @ w) / vol
                rows.append((set_id, list(assets), w.tolist(), vol, float(np.sqrt(np.mean((rc - vol / n) ** 2)) / (vol / n)), it))
            yield pd.DataFrame(rows, columns=["set_id", "assets", "weights", "volatility", "deviation_score", "iterations"])

    schema = "set_id string, assets array<string>, weights array<double>, volatility double, deviation_score double, iterations int"
    return set_covariance(sets, cov).mapInPandas(solve, schema)


def rolling_min_variance(weights: DataFrame, rolling_cov: DataFrame, max_unrolled: int = MAX_UNROLLED) -> DataFrame:
    """Lowest-variance candidate at every rebalance date: (date, portfolio_id, variance).

    ``rolling_cov`` holds (date, i, j, cov) at the rebalance dates only.  The
    matrices (dates x assets squared, at most ``max_unrolled`` assets) meet each
    portfolio row in place and the winner per date is kept by a map-side
    ``min_by``.  Portfolios without a known asset never win.
    """
    full = mirror(rolling_cov.select("date", "i", "j", "cov"))
    best = F.min_by(F.struct("portfolio_id", "variance"), F.struct("variance", "portfolio_id")).alias("k")
    n = rolling_cov.select("i").distinct().count()
    if n > max_unrolled:
        held = weights.where("w <> 0")
        a = held.select("portfolio_id", F.col("asset").alias("i"), F.col("w").alias("wi"))
        b = held.select("portfolio_id", F.col("asset").alias("j"), F.col("w").alias("wj"))
        scored = a.join(b, "portfolio_id").join(full, ["i", "j"]).groupBy("portfolio_id", "date").agg(F.sum(F.col("wi") * F.col("wj") * F.col("cov")).alias("variance"))
        return scored.groupBy("date").agg(best).select("date", "k.portfolio_id", "k.variance")
    row = F.transform(F.array_sort(F.collect_list(F.struct("j", "cov"))), lambda x: x["cov"])
    rows = full.groupBy("date", "i").agg(row.alias("row"))
    per_date = rows.groupBy("date").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda x: x["row"]).alias("m"))
    u = rolling_cov.agg(F.array_sort(F.collect_set("i")).alias("u")).scalar()
    matrices = materialise(per_date, "matrices").agg(F.collect_list(F.struct("date", "m")).alias("a")).scalar()
    p = weight_arrays(weights, u).where(is_invested()).select("portfolio_id", "w", F.explode(matrices).alias("d"))
    p = p.select("portfolio_id", "w", F.col("d.date").alias("date"), F.col("d.m").alias("m"))
    scored = p.select("portfolio_id", "date", quadratic_form("w", "m", n).alias("variance"))
    return scored.groupBy("date").agg(best).select("date", "k.portfolio_id", "k.variance")


def rebalance_path(choices: DataFrame, weights: DataFrame, min_change: float = 0.0) -> DataFrame:
    """What is held from each rebalance on: (date, wanted, portfolio_id, turnover, traded).

    Turnover is the absolute weight change from what is held to what is wanted;
    below ``min_change`` nothing is traded and the old portfolio stays.  That
    hangs on the step before, so the choices, one row per rebalance date, are
    folded in order within one row.
    """
    u = weights.agg(F.array_sort(F.collect_set("asset")).alias("u")).scalar()
    wanted = weight_arrays(weights.join(choices.select("portfolio_id").distinct(), "portfolio_id", "left_semi"), u).select("portfolio_id", "w")
    steps = choices.join(wanted, "portfolio_id").agg(F.array_sort(F.collect_list(F.struct("date", "portfolio_id", "w"))).alias("steps"))
    empty = F.array().cast("array<struct<date: date, wanted: bigint, portfolio_id: bigint, turnover: double, traded: boolean>>")
    start = F.struct(F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("array<double>").alias("w"), empty.alias("out"))

    def step(state: Column, x: Column) -> Column:
        gap = F.aggregate(F.zip_with(state["w"], x["w"], lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, d: s + d)
        trade = F.coalesce(gap >= min_change, F.lit(True))
        held = F.when(trade, x["portfolio_id"]).otherwise(state["id"])
        row = F.struct(x["date"].alias("date"), x["portfolio_id"].cast("bigint").alias("wanted"), held.cast("bigint").alias("portfolio_id"), gap.alias("turnover"), trade.alias("traded"))
        return F.struct(held.cast("bigint").alias("id"), F.when(trade, x["w"]).otherwise(state["w"]).alias("w"), F.concat(state["out"], F.array(row)).alias("out"))

    return steps.select(F.inline(F.aggregate("steps", start, step, lambda s: s["out"])))


def rebalance_periods(path: DataFrame, weights: DataFrame, rets: DataFrame) -> DataFrame:
    """``path`` with the number of returns, compounded return and volatility from each rebalance to the next."""
    daily = hold_until_next(path, weights, rets)
    per = daily.groupBy(F.col("rebalance").alias("date")).agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("period_return"), F.stddev_samp("r").alias("period_std"))
    return path.join(per, "date", "left")


def hold_until_next(choices: DataFrame, weights: DataFrame, rets: DataFrame) -> DataFrame:
    """Returns of the chosen portfolio from one rebalance to the next.

    ``choices`` has one row per rebalance date.
    """
    held = choices.select(F.col("date").alias("rebalance"), "portfolio_id").join(weights, "portfolio_id").select("rebalance", "portfolio_id", "asset", "w")
    # Each trading date belongs to the last rebalance before it.
    cal = choices.agg(F.array_sort(F.collect_list("date")).alias("c")).scalar()
    r = rets.withColumn("c", cal).withColumn("rebalance", F.get(F.reverse(F.filter("c", lambda x: x < F.col("date"))), F.lit(0)))
    r = r.filter("rebalance IS NOT NULL").select("asset", "date", "r", "rebalance")
    return held.join(r, ["rebalance", "asset"]).groupBy("rebalance", "portfolio_id", "date").agg(F.sum(F.col("w") * F.col("r")).alias("r"))


# --- binary selection --------------------------------------------------------------------


def _z(df: DataFrame, value: str) -> Column:
    w = Window.partitionBy(F.lit(0))
    sd = F.stddev_pop(value).over(w)
    return F.when(sd > 1e-10, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(F.col(value))


def selection_coefficients(
    mu: DataFrame, cvar: DataFrame, corr: DataFrame, return_weight: float, risk_weight: float, diversification_weight: float,
    budget_penalty: float, cardinality_penalty: float, min_assets: int, max_assets: int,
) -> DataFrame:
    """(i, j, coef) of x'Qx for choosing assets, plus the constant as (NULL, NULL).

    Diagonal: -return * mu + risk * cvar on z-scores over the universe (cvar as the
    signed tail mean of returns); off-diagonal: correlation; all entries:
    penalties for budget and for the middle of the cardinality range.
    """
    target = (min_assets + max_assets) / 2
    a = mu.join(cvar, "asset").select("asset", _z(mu, "mu").alias("zm"), _z(cvar, "cvar").alias("zc"))
    full = mirror(corr.select("i", "j", "corr"))
    parts = [
        a.select(F.col("asset").alias("i"), F.col("asset").alias("j"), (-return_weight * F.col("zm") + risk_weight * F.col("zc")).alias("coef")),
        full.filter("i <> j").select("i", "j", (diversification_weight * F.col("corr")).alias("coef")),
        full.select("i", "j", F.lit(budget_penalty + cardinality_penalty).alias("coef")),
        a.select(F.col("asset").alias("i"), F.col("asset").alias("j"), F.lit(-2 * budget_penalty - 2 * cardinality_penalty * target).alias("coef")),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("i", "j").agg(F.sum("coef").alias("coef"))


def selection_constant(budget_penalty: float, cardinality_penalty: float, min_assets: int, max_assets: int) -> float:
    return budget_penalty + cardinality_penalty * ((min_assets + max_assets) / 2) ** 2


def selection_energies(weights: DataFrame, q: DataFrame, constant: float, min_assets: int, max_assets: int) -> DataFrame:
    """Energy x'Qx + c of every candidate within the cardinality range.

    Energy depends on the held set only, so it is summed once per distinct set
    and joined back.
    """
    sets = asset_sets(weights)
    d = set_dictionary(sets).filter(F.col("n_assets").between(min_assets, max_assets))
    legs = d.select("set_id", "assets", F.explode("assets").alias("i")).select("set_id", "i", F.explode("assets").alias("j"))
    e = legs.join(q, ["i", "j"]).groupBy("set_id").agg((F.sum("coef") + constant).alias("energy"))
    return sets.select("portfolio_id", "set_id").join(e, "set_id")


def lowest_energies(energies: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """The k lowest energies (per key), with rank; the limit is pushed below the exchange."""
    if not keys:
        top = energies.orderBy("energy", "portfolio_id").limit(k)
        return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("energy", "portfolio_id")))
    rk = F.row_number().over(Window.partitionBy(*keys).orderBy("energy", "portfolio_id"))
    return energies.withColumn("rank", rk).filter(F.col("rank") <= k)


def energy_quality(energies: DataFrame) -> DataFrame:
    """Best energy, gap to the second distinct energy and number of distinct sets."""
    two = energies.select(F.round("energy", 9).alias("energy")).distinct().orderBy("energy").limit(2)
    best = two.agg(F.min("energy").alias("best"), F.max("energy").alias("second"), F.count("*").alias("n"))
    n = energies.agg(F.count_distinct("set_id").alias("n")).scalar()
    return best.select(F.col("best").alias("best_energy"), F.when(F.col("n") > 1, F.col("second") - F.col("best")).alias("gap_to_second"), n.alias("unique_sets"))


def binary_weight_coefficients(
    mu: DataFrame, cov: DataFrame, risk_weight: float, bits: int, step: float, budget_penalty: float, max_weight: float, max_weight_penalty: float,
) -> DataFrame:
    """(i, bit_i, j, bit_j, coef) of the mean-variance form on weights bit * step."""
    levels = literal_rows([{"bit": b, "weight": b * step} for b in range(bits)])
    full = mirror(cov.select("i", "j", "cov"))
    pairs = full.withColumn("a", F.explode(levels)).withColumn("b", F.explode(levels))
    pairs = pairs.select("i", F.col("a.bit").alias("bit_i"), "j", F.col("b.bit").alias("bit_j"), ((risk_weight * F.col("cov") + budget_penalty) * F.col("a.weight") * F.col("b.weight")).alias("coef"))
    over = F.when(F.col("weight") > max_weight, max_weight_penalty * (F.col("weight") - max_weight) ** 2).otherwise(0.0)
    own = fan_out(mu, levels).select(
        F.col("asset").alias("i"), F.col("bit").alias("bit_i"), F.col("asset").alias("j"), F.col("bit").alias("bit_j"),
        (-(F.col("mu") + 2 * budget_penalty) * F.col("weight") + over).alias("coef"),
    )
    return pairs.unionByName(own).groupBy("i", "bit_i", "j", "bit_j").agg(F.sum("coef").alias("coef"))


def discretised_weights(weights: DataFrame, step: float, max_weight: float) -> DataFrame:
    """Weights rounded to the grid, capped and renormalised; portfolios rounded to nothing drop out."""
    w = weights.select("portfolio_id", "asset", F.least(F.round(F.col("w") / step) * step, F.lit(max_weight)).alias("w")).filter("w > 0")
    return w.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("portfolio_id")))
