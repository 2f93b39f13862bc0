"""Stratified samples of portfolios and convergence checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import ratio, uniform_draw
from riskloom.operators.ordering import exact_quantiles, running_totals
from riskloom.operators.rolling import block_stability
from riskloom.session import materialise, spread

# Upper bounds of the asset-count bins.
COUNT_BINS = [3, 5, 7, 10]


def _tercile(value: str, labels: Sequence[str], cuts: Column) -> Column:
    v = F.col(value)
    return F.when(v.isNull(), "unknown").when(v <= cuts["lo"], labels[0]).when(v <= cuts["hi"], labels[1]).otherwise(labels[2])


def stratify(portfolios: DataFrame, cuts: Sequence[float] = (0.33, 0.66)) -> DataFrame:
    """Adds count bin, volatility and concentration terciles and the combined stratum.

    ``portfolios`` has portfolio_id, n_assets, equal_weight_volatility and
    equal_weight_hhi.
    """
    values = {"equal_weight_volatility": ("low", "medium", "high"), "equal_weight_hhi": ("diversified", "moderate", "concentrated")}
    long = materialise(portfolios.unpivot(["portfolio_id"], list(values), "metric", "value").filter("value IS NOT NULL").select("metric", "value"), "strata")
    q = exact_quantiles(long, ["metric"], "value", list(cuts))
    packed = q.agg(F.collect_list(F.struct("metric", "q", "quantile")).alias("qs")).scalar()  # two metrics x two levels
    p = portfolios.withColumn("__q", packed)

    def level(metric: str, c: float) -> Column:
        hit = F.filter("__q", lambda x: (x["metric"] == metric) & (x["q"] == F.lit(float(c))))
        return F.get(hit, F.lit(0))["quantile"]

    for k, (metric, labels) in enumerate(values.items()):
        p = p.withColumn(f"__c{k}", F.struct(level(metric, cuts[0]).alias("lo"), level(metric, cuts[1]).alias("hi")))
        p = p.withColumn(f"{metric}_bin", _tercile(metric, labels, F.col(f"__c{k}")))
    size = F.coalesce(*[F.when(F.col("n_assets") <= b, F.lit(f"assets_{b}")) for b in COUNT_BINS], F.lit(f"assets_{COUNT_BINS[-1]}_plus"))
    p = p.withColumn("count_bin", size)
    return p.withColumn("stratum", F.concat_ws("_", "count_bin", "equal_weight_volatility_bin", "equal_weight_hhi_bin")).drop("__q", "__c0", "__c1")


def _positions(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Position of every row within its key in a reproducible random order, ordered across tasks."""
    d = df.withColumn("__u", uniform_draw(seed, F.col("portfolio_id"))).withColumn("one", F.lit(1).cast("long"))
    return running_totals(d, [F.col("__u"), F.col("portfolio_id")], ["one"], keys).withColumnRenamed("cum_one", "__pos").drop("one")


def stratified_sample(portfolios: DataFrame, n: int, seed: int = 42, min_per_bin: int = 0) -> DataFrame:
    """Proportional sample of about ``n`` rows by stratum, topped up to ``n``, with a minimum per count bin.

    Rows keep their full set of columns and a ``how`` column: stratum, top_up or bin_minimum.
    """
    total = portfolios.count()
    placed = materialise(_positions(portfolios, ["stratum"], seed), "positions")
    sizes = materialise(placed.groupBy("stratum").agg(F.floor(F.count("*") * n / F.lit(total)).alias("__quota")), "quotas")
    main = placed.join(sizes, "stratum").filter(F.col("__pos") <= F.col("__quota")).drop("__quota", "__pos")
    main = materialise(main.withColumn("how", F.lit("stratum")), "sample")
    short = n - main.count()
    out = main
    if short > 0:
        rest = placed.join(main, "portfolio_id", "left_anti").drop("__pos")
        top_up = rest.orderBy("__u", "portfolio_id").limit(short).withColumn("how", F.lit("top_up"))
        out = materialise(main.unionByName(top_up), "sample")
    if min_per_bin > 0:
        have = out.groupBy("count_bin").agg(F.count("*").alias("k"))
        need = placed.select("count_bin").distinct().join(have, "count_bin", "left").select("count_bin", (min_per_bin - F.coalesce("k", F.lit(0))).alias("need")).filter("need > 0")
        rest = placed.join(out, "portfolio_id", "left_anti").drop("__pos").join(materialise(need, "need"), "count_bin")
        extra = _positions(rest, ["count_bin"], seed + 1).filter(F.col("__pos") <= F.col("need")).drop("need", "__pos").withColumn("how", F.lit("bin_minimum"))
        out = out.unionByName(extra.select(*out.columns))
    return out.drop("__u")


def study_samples(portfolios: DataFrame, main: int, robustness: int, convergence: int, extremes: int, seed: int = 42) -> DataFrame:
    """Main sample, a disjoint robustness sample, a convergence sample and the extreme cases, tagged by role."""
    first = materialise(stratified_sample(portfolios, main, seed).drop("how"), "main")
    rest = portfolios.join(first, "portfolio_id", "left_anti")
    second = materialise(stratified_sample(rest, robustness, seed + 1).drop("how"), "robustness")
    third = stratified_sample(rest.join(second, "portfolio_id", "left_anti"), convergence, seed + 2).drop("how")
    v = "equal_weight_volatility"
    edge = portfolios.orderBy(F.desc(v), "portfolio_id").limit(extremes).unionByName(portfolios.orderBy(F.asc(v), "portfolio_id").limit(extremes)).distinct()
    parts = {"main": first, "robustness": second, "convergence": third, "extreme": edge}
    out = None
    for role, df in parts.items():
        part = df.select("portfolio_id", "stratum").withColumn("role", F.lit(role))
        out = part if out is None else out.unionByName(part)
    return out


def bootstrap_interval(df: DataFrame, value: str, key: str, replicates: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Bootstrap interval of the mean by Poisson(1) resampling weights.

    Every row draws its count for every replicate; partial sums per replicate are
    combined on the map side, so ``replicates`` rows per task are exchanged.
    """
    u = uniform_draw(seed, F.col(key), F.col("b"))
    # Poisson(1) cumulative probabilities at 0..6.
    cum, p, acc = [], 2.718281828459045 ** -1, 0.0
    for k in range(7):
        acc += p
        cum.append(acc)
        p /= k + 1
    rows = spread(df.select(key, value).filter(F.col(value).isNotNull()), key)
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("u", u)
    count = sum((F.when(F.col("u") > c, 1).otherwise(0) for c in cum), F.lit(0))
    means = rows.withColumn("k", count).groupBy("b").agg(ratio(F.sum(F.col("k") * F.col(value)), F.sum("k").cast("double")).alias("m"))
    a = (1 - level) / 2
    return means.agg(F.percentile("m", F.lit(a)).alias("lower"), F.percentile("m", F.lit(1 - a)).alias("upper"), F.avg("m").alias("centre")).withColumn(
        "width_fraction", ratio(F.col("upper") - F.col("lower"), F.abs("centre")))


def convergence(df: DataFrame, order: str, value: str, block: int, tolerance: float = 0.02, max_width: float = 0.1, min_rank: float = 0.95) -> DataFrame:
    """Mean stability, interval width and rank stability of a metric, with the verdict of each."""
    s = block_stability(df, order, value, block)
    ci = bootstrap_interval(df, value, order).select(F.struct("lower", "upper", "width_fraction").alias("c")).scalar()
    out = s.withColumn("c", ci)
    return out.select(
        "relative_change", F.col("c.width_fraction").alias("width_fraction"), "rank_stability", (F.col("relative_change") <= tolerance).alias("mean_stable"),
        (F.col("c.width_fraction") <= max_width).alias("interval_narrow"), (F.col("rank_stability") >= min_rank).alias("ranks_stable"))
