"""Daily forms: a row at every window end."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom.operators import rolling
from riskloom.plans import daily_queries as D

SF = "/root/testdata/sf0.01"


def ends(spark, lag=0):
    n = {r.asset: r["count"] for r in D.daily(spark, SF).groupBy("asset").count().collect()}
    return {(a, w): k - w + 1 - lag for a, k in n.items() for w in D.DAILY_WINDOWS}


def test_every_window_end_has_a_row(spark):
    for name, lag in [("pot_parameters_daily", 0), ("garch_volatility_daily", 1), ("student_dof_daily", 0)]:
        rows = entry.queries()[name](spark, SF).groupBy("asset", "estimation_window").agg(F.count_distinct("date").alias("n")).collect()
        assert {(r.asset, r.estimation_window): r.n for r in rows} == ends(spark, lag), name


def test_paths_are_drawn_only_as_far_as_they_are_summed(spark, panel):
    windows = rolling.latest_per_key(rolling.window_arrays(panel[0], 30), ["asset"]).drop("current")
    long = D.method_paths(windows, 5)
    for method, paths in D.method_paths(windows, 5, 1).items():
        short = {(r.asset, r.sim): r.path for r in paths.collect()}
        assert {len(p) for p in short.values()} == {1}
        assert short == {(r.asset, r.sim): r.path[:1] for r in long[method].collect()}, method
