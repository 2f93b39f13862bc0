"""Monte-Carlo risk on daily returns at every window end: 20 000 paths, windows of one and two years."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import rolling_simulation as mc
from riskloom.plans.base import CONFIDENCE, DAILY_WINDOWS, HORIZONS, d, log_returns
from riskloom.plans.registry import cte, query

N_SIMS, SEED, BLOCK, DOF = 20_000, 7, 5, 5.0


def simulated(spark, sf, methods=mc.METHODS, horizons=HORIZONS) -> DataFrame:
    rets = log_returns(spark, sf, "day")
    parts = [
        mc.rolling_monte_carlo(rets, w, CONFIDENCE, horizons, N_SIMS, methods, SEED, BLOCK, DOF).withColumn("estimation_window", F.lit(w)) for w in DAILY_WINDOWS
    ]
    return reduce(DataFrame.unionByName, parts)


@query("monte_carlo_daily", "S-8 S-2 S-3 S-4 S-5 S-6 R6", digits=7)
def monte_carlo_daily(spark, sf):
    return simulated(spark, sf)


cte("mcd_steps", f"SELECT sim, step FROM (SELECT unnest(range(1, {N_SIMS + 1})) AS sim) CROSS JOIN (SELECT unnest(range(1, {max(HORIZONS) + 1})) AS step)")
cte("mcd_values", f"""
    SELECT 'normal' AS method, sim, step, sqrt(-2 * ln({mc.draw_sql(SEED, 'normal_a')})) * cos(2 * pi() * {mc.draw_sql(SEED, 'normal_b')}) AS z FROM mcd_steps
    UNION ALL SELECT 'student', sim, step, {d(math.sqrt((DOF - 2) / DOF))} * sqrt({d(DOF)} * (pow({mc.draw_sql(SEED, 'student_a')}, {d(-2 / DOF)}) - 1)) * cos(2 * pi() * {mc.draw_sql(SEED, 'student_b')}) FROM mcd_steps""")
cte("mcd_sums", " UNION ALL ".join(f"SELECT method, CAST({h} AS INTEGER) AS horizon, sim, -sum(z) AS loss FROM mcd_values WHERE step <= {h} GROUP BY method, sim" for h in HORIZONS))
cte("mcd_tails", " UNION ALL ".join(f"""
    SELECT method, horizon, {d(c)} AS confidence_level, any_value(q) AS q, avg(loss) FILTER (WHERE loss >= q) AS e FROM (
      SELECT *, max(CASE WHEN rk = CAST(floor({d(c)} * {N_SIMS}) AS BIGINT) THEN loss END) OVER (PARTITION BY method, horizon) AS q FROM (
        SELECT *, row_number() OVER (PARTITION BY method, horizon ORDER BY loss) - 1 AS rk FROM mcd_sums)) GROUP BY method, horizon""" for c in CONFIDENCE))
cte("mcd_moments", " UNION ALL ".join(f"""
    SELECT asset, date, CAST({w} AS INTEGER) AS estimation_window, avg(r) OVER w AS mu, stddev_samp(r) OVER w AS sd FROM log_returns_day
    WINDOW w AS (PARTITION BY asset ORDER BY date ROWS {w - 1} PRECEDING) QUALIFY row_number() OVER (PARTITION BY asset ORDER BY date) >= {w}""" for w in DAILY_WINDOWS))


@query("monte_carlo_daily_parametric", "S-8 S-4 S-5 R6", """
    SELECT asset, date, method, horizon, confidence_level, -mu * horizon + sd * q AS var, -mu * horizon + sd * e AS cvar, estimation_window
    FROM mcd_moments CROSS JOIN mcd_tails WHERE sd > 0 AND -mu * horizon + sd * q > 0""", "confidence_level var cvar", 7)
def monte_carlo_daily_parametric(spark, sf):
    return simulated(spark, sf, ("normal", "student"))


cte("mcd_picks", " UNION ALL ".join(f"""
    SELECT '{m}' AS method, {w} AS estimation_window, CAST(floor({mc.draw_sql(SEED, m, 'sim', '1')} * {w - less}) AS INTEGER) AS pos, count(*) AS n
    FROM (SELECT unnest(range(1, {N_SIMS + 1})) AS sim) GROUP BY pos""" for w in DAILY_WINDOWS for m, less in (("iid", 0), ("block", BLOCK - 1))))
cte("mcd_numbered", "SELECT asset, date, r, row_number() OVER (PARTITION BY asset ORDER BY date) AS k FROM log_returns_day")
cte("mcd_losses", " UNION ALL ".join(f"""
    SELECT e.asset, e.date, p.method, p.estimation_window, -x.r AS loss, p.n FROM mcd_numbered e JOIN mcd_numbered x ON x.asset = e.asset AND x.k > e.k - {w} AND x.k <= e.k
    JOIN mcd_picks p ON p.estimation_window = {w} AND p.pos = x.k - e.k + {w - 1} WHERE e.k >= {w}""" for w in DAILY_WINDOWS))
cte("mcd_upto", """
    SELECT *, sum(n) OVER (PARTITION BY asset, date, method, estimation_window ORDER BY loss) AS upto FROM mcd_losses""")


@query("monte_carlo_daily_one_day", "S-8 S-2 S-3 R6", " UNION ALL ".join(f"""
    SELECT asset, date, method, CAST(1 AS INTEGER) AS horizon, {d(c)} AS confidence_level, v AS var, sum(n * loss) FILTER (WHERE loss >= v) / sum(n) FILTER (WHERE loss >= v) AS cvar,
           CAST(estimation_window AS INTEGER) AS estimation_window
    FROM (SELECT *, min(CASE WHEN upto > CAST(floor({d(c)} * {N_SIMS}) AS BIGINT) THEN loss END) OVER (PARTITION BY asset, date, method, estimation_window) AS v FROM mcd_upto)
    GROUP BY asset, date, method, estimation_window, v HAVING v > 0""" for c in CONFIDENCE), "confidence_level var cvar", 7)
def monte_carlo_daily_one_day(spark, sf):
    return simulated(spark, sf, ("iid", "block"), [1])
