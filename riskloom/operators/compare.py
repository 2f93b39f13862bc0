"""Comparison layer: summaries, rankings and checks across models, tools and portfolios."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import ratio
from riskloom.operators.ordering import _ranged, exact_quantiles, global_row_number, quantile_columns
from riskloom.session import materialise

#: Cells of the grid of ``pareto_front``.
GRID_CELLS = 4096


def union_models(tables: dict[str, DataFrame]) -> DataFrame:
    """Stack model outputs with different columns, tagged with the model name."""
    out = None
    for name, df in tables.items():
        tagged = df.withColumn("model", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def common_assets(df: DataFrame, by: str = "model") -> DataFrame:
    """Keep assets present in every model."""
    n = df.agg(F.count_distinct(by).alias("n")).scalar()
    keep = df.groupBy("asset").agg(F.count_distinct(by).alias("k")).filter(F.col("k") == n)
    return df.join(keep, "asset", "left_semi")


def to_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    casted = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return casted.unpivot(list(keys), list(metrics), "metric", "value").filter("value IS NOT NULL")


def summary(long: DataFrame, keys: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """Count, mean, standard deviation, extremes and quantiles of ``value`` per key.

    ``long`` is read twice (moments and quantiles); pass a stored table.
    """
    keys = list(keys)
    a = long.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantile_columns(long, keys, "value", quantiles)
    return a.join(q, keys)


def configurable_summary(df: DataFrame, group_by: Sequence[str], metrics: Sequence[str], stats: Sequence[str], digits: int = 6) -> DataFrame:
    """group_by x metrics x statistics named in ``stats`` (mean, std, median, p95, min, max), rounded.

    The groups are configurations, so percentiles use the plain aggregate.
    """
    makers = {
        "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
        "median": lambda c: F.percentile(c, F.lit(0.5)), "p95": lambda c: F.percentile(c, F.lit(0.95)),
    }
    return df.groupBy(*group_by).agg(*[F.round(makers[s](m), digits).alias(f"{m}_{s}") for m in metrics for s in stats])


def coverage_accuracy(metrics: DataFrame) -> DataFrame:
    """Hit rate against expectation per model and confidence level."""
    expected = 1 - F.col("confidence_level")
    return metrics.groupBy("model", "confidence_level").agg(
        F.avg("hit_rate").alias("mean_hit_rate"), F.percentile("hit_rate", F.lit(0.5)).alias("median_hit_rate"), F.percentile("hit_rate", F.lit(0.95)).alias("p95_hit_rate"),
        F.avg(expected).alias("expected_hit_rate"), F.avg(F.abs(F.col("hit_rate") - expected)).alias("mean_abs_deviation"), F.avg("violation_ratio").alias("mean_violation_ratio"))


def rejection_rates(metrics: DataFrame) -> DataFrame:
    """Rejection percentage and mean p-value per model and test."""
    tests = F.array(*[
        F.struct(F.lit(t).alias("test"), F.col(f"{t}_reject").alias("reject"), F.col(f"{t}_p_value").alias("p_value")) for t in ("kupiec", "independence", "conditional_coverage")])
    long = metrics.select("model", F.inline(tests))
    return long.groupBy("model", "test").agg((F.avg(F.col("reject").cast("double")) * 100).alias("rejection_pct"), F.avg("p_value").alias("mean_p_value"), F.count("*").alias("n"))


def zone_counts(metrics: DataFrame, zones: Sequence[str] = ("green", "yellow", "red")) -> DataFrame:
    """Traffic-light counts and percentages per model, zones without rows kept."""
    wide = metrics.groupBy("model").agg(F.count("*").alias("n"), *[F.count_if(F.col("traffic_light_zone") == z).alias(z) for z in zones])
    return wide.unpivot(["model", "n"], list(zones), "zone", "n_zone").select("model", "zone", "n_zone", (F.col("n_zone") * 100.0 / F.col("n")).alias("pct"))


def within_tolerance(metrics: DataFrame, multiples: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Share of configurations whose hit rate is within k percentage points of expectation."""
    gap = F.abs(F.col("hit_rate") - (1 - F.col("confidence_level")))
    return metrics.groupBy("model").agg(*[(F.avg((gap <= k * 0.01 + 1e-12).cast("double")) * 100).alias(f"within_{k}pct") for k in multiples])


def sensitivity(metrics: DataFrame, dimensions: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means by one dimension at a time, all dimensions in one grouping-sets pass."""
    df = metrics.select("model", *[F.col(d).cast("string").alias(d) for d in dimensions], *values)
    sets = [["model", d] for d in dimensions]
    g = df.groupingSets(sets, "model", *dimensions).agg(F.grouping_id().alias("gid"), *[F.avg(v).alias(f"mean_{v}") for v in values], F.count("*").alias("n"))
    n = len(dimensions)
    # In grouping_id a cleared bit marks the dimension that was grouped.
    label = F.coalesce(*[F.when(F.col("gid").bitwiseAND(1 << (n - 1 - k)) == 0, F.struct(F.lit(d).alias("dimension"), F.col(d).alias("level"))) for k, d in enumerate(dimensions)])
    return g.withColumn("k", label).select("model", "k.dimension", "k.level", *[f"mean_{v}" for v in values], "n")


def parameter_diagnostics(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, standard deviation and coefficient of variation of rolling parameters."""
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"), ratio(F.stddev_samp(v), F.abs(F.avg(v))).alias(f"{v}_cv")]
    return df.groupBy(*keys).agg(*aggs)


def run_summary(metrics: DataFrame) -> DataFrame:
    """Averages, bests, normality rejections and structure correlations of a run in one pass."""
    return metrics.agg(
        F.count("*").alias("n"), F.avg("mean_return").alias("avg_return"), F.max("mean_return").alias("max_return"), F.avg("volatility").alias("avg_volatility"),
        F.min("volatility").alias("min_volatility"), F.avg("sharpe_ratio").alias("avg_sharpe"), F.max("sharpe_ratio").alias("max_sharpe"),
        (F.avg((F.col("jarque_bera_p_value") < 0.05).cast("double")) * 100).alias("normality_rejection_pct"),
        F.corr("hhi", "sharpe_ratio").alias("corr_hhi_sharpe"), F.corr("effective_number", "volatility").alias("corr_enc_volatility"))


def correlation_matrix(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlation of all metric pairs in one aggregate pass."""
    pairs = [(a, b) for k, a in enumerate(metrics) for b in metrics[k:]]
    parts = [F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.corr(a, b).alias("corr")) for a, b in pairs]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def binned_relation(df: DataFrame, x: str, y: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Mean of ``y`` in even bins of ``x`` on complete rows, with the overall correlation."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    c = d.agg(F.corr(x, y).alias("c")).scalar()
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(x) - lo) / ((hi - lo) / bins)))).cast("int")
    g = d.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))
    return g.withColumn("overall_corr", c)


# --- checks ------------------------------------------------------------------------------


def validate_metrics(df: DataFrame, required: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """Rows with all required values that satisfy every rule."""
    out = df.na.drop(subset=list(required))
    for rule in rules.values():
        out = out.filter(rule)
    return out


def rejected_counts(df: DataFrame, required: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """How many rows each requirement and rule rejects."""
    parts = [F.struct(F.lit(f"missing_{c}").alias("check"), F.count_if(F.col(c).isNull()).alias("rejected")) for c in required]
    parts += [F.struct(F.lit(n).alias("check"), F.count_if(~F.coalesce(r, F.lit(False))).alias("rejected")) for n, r in rules.items()]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def plausible_risk(series: DataFrame) -> DataFrame:
    """Keep rows with finite, positive VaR and CVaR not below it."""
    ok = ~F.isnan("var") & ~F.isnan("cvar") & (F.col("var") > 0) & (F.col("cvar") >= F.col("var")) & (F.col("cvar") < float("inf"))
    return series.filter(ok)


def portfolio_table_checks(weights: DataFrame, metrics: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Weights that do not sum to 1, negative volatilities, drawdowns of the wrong sign."""
    sums = weights.groupBy("portfolio_id").agg(F.sum("w").alias("s"), F.min("w").alias("low"))
    a = sums.agg(F.count_if(F.abs(F.col("s") - 1) > tolerance).alias("bad_weight_sums"), F.count_if(F.col("low") < 0).alias("negative_weights"), F.count("*").alias("portfolios"))
    b = metrics.agg(F.struct(F.count_if(F.col("volatility") < 0).alias("v"), F.count_if(F.col("max_drawdown") < 0).alias("d")).alias("k")).scalar()
    return a.withColumn("k", b).select("portfolios", "bad_weight_sums", "negative_weights", F.col("k.v").alias("negative_volatility"), F.col("k.d").alias("negative_drawdown"))


def cvar_table_checks(risk: DataFrame) -> DataFrame:
    """Is mean CVaR increasing in confidence, CVaR at least VaR and excess loss non-negative?"""
    by = risk.groupBy("confidence_level").agg(
        F.avg("cvar").alias("mean_cvar"), F.every(F.col("cvar") >= F.col("var")).alias("cvar_at_least_var"), F.min(F.col("cvar") - F.col("var")).alias("min_excess"))
    prev = F.lag("mean_cvar").over(Window.partitionBy(F.lit(0)).orderBy("confidence_level"))  # one row per level
    c = by.withColumn("up", F.coalesce(F.col("mean_cvar") >= prev, F.lit(True)))
    return c.agg(F.every("up").alias("cvar_monotone"), F.every("cvar_at_least_var").alias("cvar_at_least_var"), (F.min("min_excess") >= 0).alias("excess_non_negative"))


def validity_gate(rets: DataFrame, key: str, min_obs: int = 30) -> DataFrame:
    """Valid flag and reason per portfolio return series."""
    g = rets.groupBy(key).agg(F.count("r").alias("n"))
    reason = F.when(F.col("n") == 0, "empty").when(F.col("n") < min_obs, F.concat(F.lit("fewer than "), F.lit(str(min_obs)), F.lit(" observations"))).otherwise("ok")
    return g.withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok")


def completeness_audit(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Present and missing metric counts with the names of the missing ones, per row."""
    items = F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("val")) for m in metrics])
    missing = F.transform(F.filter(items, lambda x: x["val"].isNull()), lambda x: x["name"])
    out = df.select(key, missing.alias("missing"))
    return out.select(key, (len(metrics) - F.size("missing")).alias("present"), F.size("missing").alias("n_missing"), F.concat_ws(",", "missing").alias("missing_names"))


def harmonise(df: DataFrame, aliases: dict[str, Sequence[str]], absolute: Sequence[str]) -> DataFrame:
    """First present alias of each metric, absolute risk signs, return over CVaR."""
    have = set(df.columns)
    cols = {}
    for name, options in aliases.items():
        found = [F.col(o).cast("double") for o in options if o in have]
        value = F.coalesce(*found) if found else F.lit(None).cast("double")
        cols[name] = F.abs(value) if name in absolute else value
    keep = [c for c in ("tool_name", "portfolio_id") if c in have]
    out = df.select(*keep, *[c.alias(n) for n, c in cols.items()])
    return out.withColumn("return_over_cvar", ratio(F.col("mean_return"), F.col("cvar"))) if {"mean_return", "cvar"} <= set(cols) else out


def tool_checks(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Missing tools and whether risk signs are normalised."""
    g = df.agg(F.collect_set("tool_name").alias("tools"), F.every(F.coalesce(F.col("cvar") >= 0, F.lit(True)) & F.coalesce(F.col("max_drawdown") >= 0, F.lit(True))).alias("signs_normalised"))
    gone = F.array_sort(F.array_except(F.array(*[F.lit(e) for e in expected]), F.col("tools")))
    return g.select(F.concat_ws(",", gone).alias("missing_tools"), (F.size(gone) == 0).alias("coverage_complete"), "signs_normalised")


# --- rankings ----------------------------------------------------------------------------


def top_and_tail(df: DataFrame, metric: str, k: int, key: str = "portfolio_id", digits: int = 9) -> DataFrame:
    """The k best and k worst rows by a metric, ranked; each side is a distributed top-k.

    Rows are ordered by the metric at ``digits`` decimals, then by key: beyond
    that, portfolios with equal holdings differ by the order their trades were
    summed in, which must not decide a rank.  A row without the metric comes last.
    """
    w = Window.partitionBy("side")
    rows = df.select(key, metric, F.round(metric, digits).alias("o"))
    top = rows.orderBy(F.desc("o"), key).limit(k).withColumn("side", F.lit("top")).withColumn("o", -F.col("o"))
    tail = rows.orderBy(F.asc_nulls_last("o"), key).limit(k).withColumn("side", F.lit("tail"))
    return top.unionByName(tail).withColumn("rank", F.row_number().over(w.orderBy(F.asc_nulls_last("o"), key))).drop("o")


def top_k_per_tool(df: DataFrame, metrics: dict[str, bool], k: int, tool: str = "tool_name", key: str = "portfolio_id") -> DataFrame:
    """The k best rows of every tool and metric (True = higher is better).

    The rank filter limits each task to k rows per tool before the exchange, so a
    tool holding most rows costs no more.
    """
    long = to_long(df, [tool, key], list(metrics))
    sign = F.when(F.col("metric").isin([m for m, up in metrics.items() if up]), -F.col("value")).otherwise(F.col("value"))
    long = long.withColumn("o", sign)
    return long.withColumn("rank", F.row_number().over(Window.partitionBy(tool, "metric").orderBy("o", key))).filter(F.col("rank") <= k).drop("o")


def composite_score(
    df: DataFrame, components: Sequence[tuple[Column, float, bool]], missing: float | None, keep_constant: bool, name: str = "score", high_is_good: bool = False
) -> DataFrame:
    """Weighted sum of min-max normalised components (value, weight, inverted).

    A component without spread counts as its raw value (``keep_constant``) or as 0.
    A missing value is ``missing`` or, if that is None, the worst value found: the
    one that moves the score away from what is good.
    The bounds of all components come from one aggregate used as a scalar.
    """
    fill = (lambda c: c) if missing is None else (lambda c: F.coalesce(c, F.lit(missing)))
    work = df.withColumns({f"__c{k}": fill(c) for k, (c, _, _) in enumerate(components)})
    bounds = work.agg(F.struct(*[F.struct(F.min(f"__c{k}").alias("lo"), F.max(f"__c{k}").alias("hi")).alias(f"b{k}") for k in range(len(components))]).alias("b")).scalar()
    work = work.withColumn("__b", bounds)
    total = F.lit(0.0)
    for k, (_, weight, inverted) in enumerate(components):
        lo, hi = F.col(f"__b.b{k}.lo"), F.col(f"__b.b{k}.hi")
        v = F.coalesce(f"__c{k}", lo if high_is_good != inverted else hi, F.lit(0.0))
        norm = F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(v if keep_constant else F.lit(0.0))
        total = total + weight * ((1.0 - norm) if inverted else norm)
    return work.withColumn(name, total).select(*df.columns, name)


def configuration_scores(metrics: DataFrame) -> DataFrame:
    """Composite of hit-rate gap, violation-ratio gap and RMSE over violations (lower is better).

    A configuration without a violation has no RMSE; a missing component counts
    as the worst of those that have one, or as 0 where none has.
    """
    gap = F.abs(F.col("hit_rate") - (1 - F.col("confidence_level")))
    parts = [(gap, 0.5, False), (F.abs(F.col("violation_ratio") - 1.0), 0.3, False), (F.col("rmse_violations"), 0.2, False)]
    return composite_score(metrics, parts, missing=None, keep_constant=True)


def rank_portfolios(metrics: DataFrame, weights: dict[str, tuple[float, bool]], percentiles: Sequence[int] = (1, 5, 10)) -> tuple[DataFrame, DataFrame]:
    """Composite-ranked portfolios and the score found at the given percentile positions.

    A missing component counts as the worst found: the largest where small is
    good, the smallest where large is.
    """
    scored = composite_score(metrics, [(F.col(m), w, not up) for m, (w, up) in weights.items()], missing=None, keep_constant=False, high_is_good=True)
    ranked = materialise(global_row_number(scored, [F.desc("score"), F.col("portfolio_id")]), "ranked")
    n = ranked.agg(F.count("*").alias("n")).scalar()
    at = ranked.select("rank", "score").withColumn("n", n).withColumn("percentile", F.explode(F.array(*[F.lit(p) for p in percentiles])))
    at = at.filter(F.col("rank") == F.greatest(F.lit(1), F.floor(F.col("n") * F.col("percentile") / 100)))
    return ranked, at.select("percentile", "rank", "score")


def model_ranking(metrics: DataFrame, scope: Sequence[str] = ("confidence_level", "horizon")) -> DataFrame:
    """Composite score per model and scope; components are normalised and ranked afterwards.

    A missing component (no violation, so no RMSE) counts as the worst found, or as 0 where none has one.
    """
    parts = {
        "hit_rate_gap": (F.avg(F.abs(F.col("hit_rate") - (1 - F.col("confidence_level")))), 0.4), "violation_ratio_gap": (F.avg(F.abs(F.col("violation_ratio") - 1.0)), 0.25),
        "rmse": (F.avg("rmse_violations"), 0.25), "kupiec_rejection": (F.avg(F.col("kupiec_reject").cast("double")), 0.1)}
    g = metrics.groupBy("model", *scope).agg(*[c.alias(f"component_{n}") for n, (c, _) in parts.items()])
    whole = Window.partitionBy(F.lit(0))  # one row per model and scope
    g = g.withColumns({f"__{n}": F.coalesce(F.col(f"component_{n}"), F.max(f"component_{n}").over(whole), F.lit(0.0)) for n in parts})
    score = sum((F.col(f"__{n}") * w for n, (_, w) in parts.items()), F.lit(0.0))
    g = g.withColumn("composite_score", score).drop(*[f"__{n}" for n in parts])
    for c in [f"component_{n}" for n in parts] + ["composite_score"]:
        lo, hi = F.min(c).over(whole), F.max(c).over(whole)
        g = g.withColumn(c, F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.col(c)))
    return g.withColumn("rank", F.row_number().over(whole.orderBy("composite_score", "model", *scope)))


def pareto_front_2d(df: DataFrame, maximise: str, minimise: str, key: str = "portfolio_id") -> DataFrame:
    """Rows not dominated in (max, min): exact, ordered across tasks.

    In order of the first objective a row is on the front when its second one is
    below everything before it; partitions pass on their running minimum.
    """
    best = df.groupBy(maximise).agg(F.min(minimise).alias("__m"))  # a repeated first objective is one row
    r = _ranged(best, [F.desc(maximise)])
    per = r.groupBy("__part").agg(F.min("__m").alias("low"))
    before = F.min("low").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    offs = per.select("__part", before.alias("low"))
    inside = F.min("__m").over(Window.partitionBy("__part").orderBy(F.desc(maximise)).rowsBetween(Window.unboundedPreceding, -1))
    front = r.withColumn("prev", inside).join(offs, "__part").filter(F.col("__m") < F.coalesce(F.least("prev", "low"), F.lit(float("inf"))))
    keep = front.select(maximise, F.col("__m").alias(minimise))
    return df.join(keep, [maximise, minimise], "left_semi").select(key, maximise, minimise)


def _dominates(better: Sequence[Column], worse: Sequence[Column]) -> Column:
    """At least as large everywhere and larger somewhere."""
    every = reduce(lambda x, y: x & y, [a >= b for a, b in zip(better, worse)])
    return every & reduce(lambda x, y: x | y, [a > b for a, b in zip(better, worse)])


def pareto_front(df: DataFrame, objectives: dict[str, bool], key: str = "portfolio_id", cells: int = GRID_CELLS) -> DataFrame:
    """Rows not dominated over any number of objectives (True = maximise); exact, without fetching rows.

    Points, equal ones once, are put on a grid of at most ``cells`` cells cut at
    quantiles.  A cell goes as a whole if some point lies in a cell that is
    higher in every objective; in the others the best points by sum and by each
    objective remove what they dominate.  The grid is fitted anew to what is left
    as long as that halves it.  The rest is compared exactly, each point with
    the cells that are nowhere lower.  Tables of cells are bounded by the grid,
    so only they are joined by inequality.  Rows without a value are left out.
    """
    cols = list(objectives)
    names = [f"__o{k}" for k in range(len(cols))]
    base = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    base = materialise(base.select("*", *[(F.col(c) if objectives[c] else -F.col(c)).alias(n) for c, n in zip(cols, names)]), "objectives")
    side = max(s for s in range(1, 65) if s ** len(cols) <= cells)
    digit = lambda cell, k: F.floor(cell / F.lit(side**k)) % side

    def place(value: Column, cuts: Sequence[float]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(e) for e in cuts]), lambda e: e <= value)) if cuts else F.lit(0)

    def on_grid(points: DataFrame) -> DataFrame:
        steps = [k / side for k in range(1, side)] or [0.5]
        cuts = points.agg(*[F.percentile_approx(n, steps).alias(n) for n in names]).first()  # one row of at most 64 cuts an objective
        at = [place(F.col(n), (cuts[n] or [])[: side - 1]) * side**k for k, n in enumerate(names)]
        return points.withColumn("__cell", reduce(lambda x, y: x + y, at))

    def without_dominated_cells(points: DataFrame) -> DataFrame:
        point, total = F.struct(*names), reduce(lambda x, y: x + y, [F.col(n) for n in names])
        best = materialise(points.groupBy("__cell").agg(F.array(*[F.max_by(point, F.struct(x, total)) for x in [total, *map(F.col, names)]]).alias("__best")), "cells")
        higher = reduce(lambda x, y: x & y, [digit(F.col("h.__cell"), k) > digit(F.col("c.__cell"), k) for k in range(len(cols))])
        open_cells = best.alias("c").join(F.broadcast(best.select("__cell").alias("h")), higher, "left_anti")
        worse = F.exists("__best", lambda b: _dominates([b[n] for n in names], [F.col(n) for n in names]))
        return points.join(F.broadcast(open_cells), "__cell").where(~worse).select(*names, "__cell")

    points = materialise(base.select(*names).distinct(), "points")
    size = points.count()
    while True:
        points = materialise(without_dominated_cells(on_grid(points.select(*names))), "points")
        before, size = size, points.count()
        if 2 * size > before or not size:
            break
    own = materialise(points.select("__cell").distinct(), "cells")
    nowhere_lower = reduce(lambda x, y: x & y, [digit(F.col("h.__cell"), k) >= digit(F.col("c.__cell"), k) for k in range(len(cols))])
    meet = materialise(own.alias("c").join(F.broadcast(own.alias("h")), nowhere_lower).select(F.col("c.__cell").alias("__cell"), F.col("h.__cell").alias("__higher")), "meet")
    other = points.toDF(*[f"{n}_h" for n in names], "__higher_cell")
    dominated = points.join(meet, "__cell").join(
        other, (F.col("__higher") == F.col("__higher_cell")) & _dominates([F.col(f"{n}_h") for n in names], [F.col(n) for n in names]), "left_semi")
    front = points.select(*names).join(dominated.select(*names).distinct(), names, "left_anti")
    return base.join(front, names, "left_semi").select(key, *cols)


def quartile_dominance(df: DataFrame, objectives: dict[str, bool], tool: str = "tool_name") -> DataFrame:
    """Share of rows per tool that are in the best quartile of every objective."""
    long = materialise(to_long(df, [tool], list(objectives)), "objectives")
    q = exact_quantiles(long, [tool, "metric"], "value", [0.25, 0.75])
    cut = materialise(q.groupBy(tool).agg(*[
        F.max(F.when((F.col("metric") == m) & (F.col("q") == (0.75 if up else 0.25)), F.col("quantile"))).alias(f"cut_{m}") for m, up in objectives.items()]), "cuts")
    good = F.lit(True)
    for m, up in objectives.items():
        good = good & ((F.col(m) >= F.col(f"cut_{m}")) if up else (F.col(m) <= F.col(f"cut_{m}")))
    j = df.join(cut, tool)
    return j.groupBy(tool).agg(F.count("*").alias("n"), F.count_if(good).alias("n_dominant"), (F.avg(good.cast("double")) * 100).alias("dominant_pct"))


def slice_means(slices: DataFrame, values: Sequence[str], min_rows: int) -> DataFrame:
    """Means per slice dimension, slice and model, where enough rows exist."""
    return slices.groupBy("slice_type", "slice", "model").agg(*[F.avg(v).alias(f"mean_{v}") for v in values], F.count("*").alias("n")).filter(F.col("n") >= min_rows)
