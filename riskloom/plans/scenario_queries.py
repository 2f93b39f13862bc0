"""Queries for scenario tables and the fidelity of generated samples."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from riskloom.functions.periods import with_periods
from riskloom.operators import fidelity, rolling, scenarios
from riskloom.plans.base import CONFIDENCE, d, log_returns, simple_returns
from riskloom.plans.registry import cte, query
from riskloom.sources import tables
from riskloom.sources.portfolios import universe_array

N_SIMS, HORIZONS, SEED, W = 200, [1, 10], 7, 52


def u_sql(*parts: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0)"


def latest_windows(spark, sf):
    return rolling.latest_per_key(rolling.window_arrays(log_returns(spark, sf), W), ["asset"]).drop("current")


cte("latest_window", f"""
    SELECT asset, max(date) AS date, list(r ORDER BY date) AS w, avg(r) AS mu, stddev_samp(r) AS sigma FROM
      (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS back FROM log_returns) WHERE back <= {W} GROUP BY asset""")
cte("sim_steps", f"""
    SELECT asset, date, w, mu, sigma, sim, step FROM latest_window CROSS JOIN (SELECT CAST(unnest(range(1, {N_SIMS + 1})) AS INTEGER) AS sim) CROSS JOIN (SELECT unnest(range(1, 11)) AS step)""")


def draw_sql(tag: str, step: str = "step") -> str:
    return u_sql(f"'{SEED}'", f"'{tag}'", "asset", "CAST(date AS VARCHAR)", "CAST(sim AS VARCHAR)", f"CAST({step} AS VARCHAR)")


STEP_VALUES = {
    "iid": f"w[CAST(floor({draw_sql('iid')} * {W}) AS INTEGER) + 1]",
    "block": f"w[CAST(floor({draw_sql('block', 'CAST((step - 1) // 5 AS INTEGER)')} * ({W} - 5 + 1)) AS INTEGER) + ((step - 1) % 5) + 1]",
    "normal": f"mu + sigma * sqrt(-2 * ln({draw_sql('a')})) * cos(2 * pi() * {draw_sql('b')})",
    "student": f"mu + sigma * {d(math.sqrt(3 / 5))} * sqrt(5e0 * (pow({draw_sql('a')}, -4e-1) - 1)) * cos(2 * pi() * {draw_sql('b')})",
}
for _name, _value in STEP_VALUES.items():
    cte(f"{_name}_totals", f"""
        SELECT asset, date, sim, CAST(1 AS INTEGER) AS horizon, sum(v) FILTER (WHERE step <= 1) AS total FROM (SELECT *, {_value} AS v FROM sim_steps) GROUP BY 1, 2, 3
        UNION ALL SELECT asset, date, sim, 10, sum(v) FROM (SELECT *, {_value} AS v FROM sim_steps) GROUP BY 1, 2, 3""")


def all_paths(windows):
    sims = scenarios.simulations(windows, N_SIMS)
    return {
        "iid": scenarios.iid_paths(sims, 10, SEED), "block": scenarios.block_paths(sims, 10, 5, SEED),
        "normal": scenarios.normal_paths(sims, 10, SEED), "student": scenarios.student_paths(sims, 10, 5.0, SEED),
    }


def _register(name: str, covers: str):
    @query(f"{name}_scenarios", covers, f"SELECT * FROM {name}_totals", "total")
    def run(spark, sf):
        return scenarios.horizon_sums(all_paths(latest_windows(spark, sf))[name], HORIZONS)


_register("iid", "S-2 S-7")
_register("block", "S-3 S-7")
_register("normal", "S-4 S-7")
_register("student", "S-5 S-7")


cte("window_rows", f"SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY date) AS k, r FROM log_returns QUALIFY row_number() OVER (PARTITION BY asset ORDER BY date DESC) <= {W}")
cte("window_pos", "SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY k) AS k, r, avg(r) OVER (PARTITION BY asset) AS mu FROM window_rows")
cte("window_scan", """
    SELECT asset, k, r, mu, r * r AS s FROM window_pos WHERE k = 1
    UNION ALL SELECT p.asset, p.k, p.r, p.mu, 94e-2 * w.s + 6e-2 * w.r * w.r FROM window_scan w JOIN window_pos p ON p.asset = w.asset AND p.k = w.k + 1""")
cte("filtered_draws", f"""
    SELECT x.asset, x.date, x.sim, x.step, s.mu, (s.r - s.mu) / (sqrt(greatest(s.s, 1e-12)) + 1e-10) AS z, 94e-2 * l.s + 6e-2 * l.r * l.r AS v0
    FROM (SELECT *, CAST(floor({draw_sql('iid')} * {W}) AS INTEGER) + 1 AS pos FROM sim_steps) x JOIN window_scan s ON s.asset = x.asset AND s.k = x.pos JOIN window_scan l ON l.asset = x.asset AND l.k = {W}""")
cte("filtered_scan", """
    SELECT asset, date, sim, step, mu + sqrt(greatest(v0, 1e-12)) * z AS total, mu + sqrt(greatest(v0, 1e-12)) * z AS r, v0 AS v FROM filtered_draws WHERE step = 1
    UNION ALL SELECT d.asset, d.date, d.sim, d.step, f.total + d.mu + sqrt(greatest(94e-2 * f.v + 6e-2 * f.r * f.r, 1e-12)) * d.z, d.mu + sqrt(greatest(94e-2 * f.v + 6e-2 * f.r * f.r, 1e-12)) * d.z, 94e-2 * f.v + 6e-2 * f.r * f.r
    FROM filtered_scan f JOIN filtered_draws d ON d.asset = f.asset AND d.sim = f.sim AND d.step = f.step + 1""")


@query("filtered_scenarios", "S-6 S-7 W7", "SELECT asset, date, sim, CAST(step AS INTEGER) AS horizon, total FROM filtered_scan WHERE step IN (1, 10)", "total", 7)
def filtered_scenarios(spark, sf):
    return scenarios.horizon_sums(scenarios.filtered_paths(latest_windows(spark, sf), N_SIMS, 10, seed=SEED), HORIZONS)


_all = " UNION ALL ".join(f"SELECT '{n}' AS method, * FROM {n}_totals" for n in STEP_VALUES)
cte("mc_ranked", f"""
    SELECT *, -total AS loss, row_number() OVER (PARTITION BY method, asset, date, horizon ORDER BY -total) - 1 AS rk, count(*) OVER (PARTITION BY method, asset, date, horizon) AS n FROM ({_all})""")
cte("mc_risk", " UNION ALL ".join(f"""
    SELECT method, asset, date, horizon, {d(c)} AS confidence_level, any_value(v) AS var, greatest(any_value(v), avg(loss) FILTER (WHERE loss >= v)) AS cvar FROM (
      SELECT *, greatest(0e0, max(CASE WHEN rk = least(floor({d(c)} * n), n - 1) THEN loss END) OVER (PARTITION BY method, asset, date, horizon)) AS v FROM mc_ranked)
    GROUP BY method, asset, date, horizon""" for c in CONFIDENCE))


def monte_carlo(spark, sf):
    """Risk of the four path models that a checking engine can redraw."""
    out = None
    for name, paths in all_paths(latest_windows(spark, sf)).items():
        part = scenarios.horizon_sums(paths, HORIZONS).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return scenarios.scenario_risk(out, CONFIDENCE, ("method", "asset", "date", "horizon"))


@query("monte_carlo_risk", "S-8 R6", "SELECT * FROM mc_risk", "confidence_level var cvar")
def monte_carlo_risk(spark, sf):
    return monte_carlo(spark, sf)


@query("monte_carlo_rolling_risk", "S-8")
def monte_carlo_rolling_risk(spark, sf):
    w = rolling.window_arrays(log_returns(spark, sf), W, 26).drop("current")
    sums = scenarios.horizon_sums(scenarios.filtered_paths(w, N_SIMS, 10, seed=SEED), HORIZONS)
    return scenarios.scenario_risk(sums, CONFIDENCE)


@query("method_comparison", "A21", """
    SELECT method, confidence_level, count(*) AS n, avg(var) AS mean_var, median(var) AS median_var, avg(cvar) AS mean_cvar, median(cvar) AS median_cvar FROM mc_risk GROUP BY 1, 2""",
       "confidence_level mean_var median_var mean_cvar median_cvar")
def method_comparison(spark, sf):
    return monte_carlo(spark, sf).groupBy("method", "confidence_level").agg(
        F.count("*").alias("n"), F.avg("var").alias("mean_var"), F.percentile("var", F.lit(0.5)).alias("median_var"),
        F.avg("cvar").alias("mean_cvar"), F.percentile("cvar", F.lit(0.5)).alias("median_cvar"))


@query("historical_scenarios", "S-1", f"""
    WITH dates AS (SELECT DISTINCT date FROM simple_returns ORDER BY date DESC LIMIT 104),
    picked AS (SELECT date FROM dates ORDER BY {u_sql("'7'", "CAST(date AS VARCHAR)")}, date LIMIT 60),
    ids AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS scenario_id FROM picked)
    SELECT scenario_id, date, asset, r FROM simple_returns JOIN ids USING (date)""", "r")
def historical_scenarios(spark, sf):
    return scenarios.historical_scenarios(simple_returns(spark, sf), 104, 60, 7)


cte("scenario_rows", "SELECT date, asset, r FROM simple_returns WHERE date IN (SELECT DISTINCT date FROM simple_returns ORDER BY date DESC LIMIT 104)")
cte("scenario_pr", "SELECT portfolio_id, date, sum(w * r) AS r FROM weights JOIN scenario_rows USING (asset) GROUP BY 1, 2")


@query("portfolio_scenario_returns", "S-9", """
    SELECT portfolio_id, count(*) AS n_scenarios, avg(r) AS mean, min(r) AS worst, max(r) AS best, stddev_samp(r) AS std FROM scenario_pr GROUP BY 1""", "mean worst best std")
def portfolio_scenario_returns(spark, sf):
    from riskloom.operators import portfolio

    s = scenarios.historical_scenarios(simple_returns(spark, sf), 104).select("date", "asset", "r")
    r = portfolio.batch_returns(tables.weights(spark, sf), s)
    return r.groupBy("portfolio_id").agg(F.count("*").alias("n_scenarios"), F.avg("r").alias("mean"), F.min("r").alias("worst"), F.max("r").alias("best"), F.stddev_samp("r").alias("std"))


_PID = "CAST(c_custkey AS VARCHAR)"


@query("random_portfolios", "S-10", f"""
    WITH a AS (SELECT DISTINCT asset FROM raw_prices), n AS (SELECT count(*) AS n FROM a),
    k AS (SELECT c_custkey, 2 + floor({u_sql("'7'", "'k'", _PID)} * (n - 1)) AS k FROM customer CROSS JOIN n),
    o AS (SELECT c_custkey, asset, k, row_number() OVER (PARTITION BY c_custkey ORDER BY {u_sql("'7'", "'r'", _PID, "asset")}, asset) AS rk,
                 -ln({u_sql("'7'", "'w'", _PID, "asset")}) AS e FROM k CROSS JOIN a)
    SELECT c_custkey AS portfolio_id, asset, e / sum(e) OVER (PARTITION BY c_custkey) AS w FROM o WHERE rk <= k""", "w")
def random_portfolios(spark, sf):
    ids = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("portfolio_id"))
    return scenarios.random_portfolios(ids, universe_array(tables.prices(spark, sf)), 7)


# Purchases stand for the real sample and clicks for the generated one.
cte("samples", "SELECT CASE WHEN event_type = 'purchase' THEN 'real' ELSE 'generated' END AS sample, value, CAST(ts AS DATE) AS date FROM events WHERE event_type IN ('purchase', 'click') AND value IS NOT NULL")


def samples(spark, sf):
    e = tables.read(spark, sf, "events").filter(F.col("event_type").isin("purchase", "click") & F.col("value").isNotNull())
    return e.select(F.when(F.col("event_type") == "purchase", fidelity.REAL).otherwise(fidelity.GENERATED).alias("sample"), "value", F.to_date("ts").alias("date"))


def _distance_sql(source: str, key: str) -> str:
    lead = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    return f"""
    SELECT {lead}sum(abs(fa - fb) * gap) AS wasserstein, max(abs(fa - fb)) AS ks_statistic FROM (
      SELECT {lead}value, coalesce(lead(value) OVER ({part}ORDER BY value) - value, 0) AS gap, sum(a) OVER ({part}ORDER BY value) / sum(a) OVER ({part}) AS fa,
             sum(b) OVER ({part}ORDER BY value) / sum(b) OVER ({part}) AS fb FROM (
        SELECT {lead}value, count(*) FILTER (WHERE sample = 'real') AS a, count(*) FILTER (WHERE sample = 'generated') AS b FROM {source} GROUP BY {lead}value)) {f'GROUP BY {key}' if key else ''}"""


@query("sample_distances", "Q1 Q2", _distance_sql("samples", ""), "wasserstein ks_statistic", 7)
def sample_distances(spark, sf):
    return fidelity.distances(samples(spark, sf))


cte("sample_bins", """
    SELECT bin, count(*) FILTER (WHERE sample = 'real') AS a, count(*) FILTER (WHERE sample = 'generated') AS b FROM (
      SELECT sample, least(49, floor((value - lo) / ((hi - lo) / 50))) AS bin FROM samples CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM samples)) GROUP BY bin""")


@query("jensen_shannon", "Q3", """
    SELECT sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0e0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0e0 END) / 2, 0e0)) AS js_distance
    FROM (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM sample_bins)""", "js_distance")
def jensen_shannon(spark, sf):
    return fidelity.jensen_shannon(samples(spark, sf))


@query("mode_coverage", "Q7", """
    SELECT count(*) FILTER (WHERE b > 0) / 50e0 AS bin_coverage, count(*) FILTER (WHERE a > 0 AND b > 0) / count(*) FILTER (WHERE a > 0) AS real_bin_coverage FROM sample_bins""", "bin_coverage real_bin_coverage")
def mode_coverage(spark, sf):
    return fidelity.coverage(samples(spark, sf))


def _moment_sql(source: str, key: str) -> str:
    lead, g = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    central = f"SELECT {lead}sample, value, value - avg(value) OVER (PARTITION BY {lead}sample) AS e FROM {source}"

    def m(k: int, s: str) -> str:
        return f"avg(pow(e, {k})) FILTER (WHERE sample = '{s}')"

    def skew(s: str) -> str:
        return f"{m(3, s)} / nullif(pow({m(2, s)}, 15e-1), 0)"

    def kurt(s: str) -> str:
        return f"({m(4, s)} / nullif(pow({m(2, s)}, 2), 0) - 3)"

    return f"""
    SELECT {lead}abs(avg(value) FILTER (WHERE sample = 'real') - avg(value) FILTER (WHERE sample = 'generated')) AS mean_error,
           abs({m(2, 'real')} - {m(2, 'generated')}) AS variance_error, abs({skew('real')} - {skew('generated')}) AS skewness_error,
           abs({kurt('real')} - {kurt('generated')}) AS kurtosis_error FROM ({central}) {g}"""


@query("moment_errors", "Q4", _moment_sql("samples", ""), "mean_error variance_error skewness_error kurtosis_error", 6)
def moment_errors(spark, sf):
    return fidelity.moment_errors(samples(spark, sf))


@query("tail_errors", "Q5", " UNION ALL ".join(f"""
    SELECT {d(c)} AS confidence_level, abs(va - vb) AS var_error,
           abs(avg(-value) FILTER (WHERE sample = 'real' AND -value >= va) - avg(-value) FILTER (WHERE sample = 'generated' AND -value >= vb)) AS cvar_error,
           abs(avg(CASE WHEN -value >= va THEN 1e0 ELSE 0e0 END) FILTER (WHERE sample = 'real') - avg(CASE WHEN -value >= va THEN 1e0 ELSE 0e0 END) FILTER (WHERE sample = 'generated')) AS tail_mass_error,
           abs(ea - eb) AS extreme_quantile_error
    FROM samples CROSS JOIN (SELECT quantile_cont(-value, {d(c)}) FILTER (WHERE sample = 'real') AS va, quantile_cont(-value, {d(c)}) FILTER (WHERE sample = 'generated') AS vb,
      quantile_cont(-value, 999e-3) FILTER (WHERE sample = 'real') AS ea, quantile_cont(-value, 999e-3) FILTER (WHERE sample = 'generated') AS eb FROM samples) GROUP BY va, vb, ea, eb"""
    for c in CONFIDENCE), "confidence_level var_error cvar_error tail_mass_error extreme_quantile_error", 7)
def tail_errors(spark, sf):
    return fidelity.tail_errors(samples(spark, sf), CONFIDENCE)


@query("stylised_fact_gaps", "Q6", """
    WITH a AS (SELECT 'A' || CAST((CAST(substr(asset, 2) AS INTEGER) // 2) AS VARCHAR) AS series, CAST(substr(asset, 2) AS INTEGER) % 2 AS side, date, r FROM simple_returns),
    l AS (SELECT series, side, lag, corr(sq, l) AS acf FROM (SELECT series, side, lag, r * r AS sq, lag(r * r, lag) OVER (PARTITION BY series, side, lag ORDER BY date) AS l
      FROM a CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS lag)) GROUP BY series, side, lag),
    g AS (SELECT series, avg(abs(x.acf - y.acf)) AS acf_gap FROM l x JOIN l y USING (series, lag) WHERE x.side = 0 AND y.side = 1 GROUP BY series),
    e AS (SELECT series, side, r - avg(r) OVER (PARTITION BY series, side) AS e FROM a),
    m AS (SELECT series, side, avg(pow(e, 3)) / pow(avg(e * e), 15e-1) AS sk, avg(pow(e, 4)) / pow(avg(e * e), 2) - 3 AS ku FROM e GROUP BY 1, 2)
    SELECT series, acf_gap, abs(x.sk - y.sk) AS skewness_gap, abs(x.ku - y.ku) AS kurtosis_gap FROM g JOIN m x USING (series) JOIN m y USING (series) WHERE x.side = 0 AND y.side = 1""",
       "acf_gap skewness_gap kurtosis_gap", 6)
def stylised_fact_gaps(spark, sf):
    # Even-numbered assets against their odd-numbered neighbours.
    n = F.substring("asset", 2, 10).cast("int")
    r = simple_returns(spark, sf).select(F.concat(F.lit("A"), F.floor(n / 2).cast("string")).alias("series"), (n % 2).alias("side"), "date", "r")
    return fidelity.stylised_fact_gaps(r.filter("side = 0"), r.filter("side = 1"))


cte("month_samples", "SELECT *, strftime(date, '%Y-%m') AS slice FROM samples")


@query("fidelity_slices", "T14", f"""
    SELECT * FROM ({_distance_sql('month_samples', 'slice')}) JOIN ({_moment_sql('month_samples', 'slice')}) USING (slice)""",
       "wasserstein ks_statistic mean_error variance_error skewness_error kurtosis_error", 6)
def fidelity_slices(spark, sf):
    s = with_periods(samples(spark, sf), slice_types=("month",)).drop("slice_type")
    return fidelity.sliced(s, ["slice"])
