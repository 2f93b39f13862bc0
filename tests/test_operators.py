import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import constants as K
from riskloom.functions.columns import chi2_sf, max_drawdown, normal_cdf
from riskloom.operators import backtest, black_litterman, evt, factors, ordering, panel as prep, portfolio, risk, rolling, scenarios, selection, volatility

DAY = dt.date(2021, 1, 1)


def test_distribution_constants():
    assert K.normal_quantile(0.95) == pytest.approx(1.6448536269, abs=1e-9)
    assert K.t_quantile(0.95, 5) == pytest.approx(2.015048373, abs=1e-8)
    assert K.t_quantile(0.99, 10) == pytest.approx(2.763769458, abs=1e-8)
    assert K.es_factor_normal(0.95) == pytest.approx(2.062712807, abs=1e-8)


def test_tail_probabilities(spark):
    r = spark.range(1).select(chi2_sf(F.lit(3.841458820694124), 1).alias("a"), chi2_sf(F.lit(5.991464547), 2).alias("b"), normal_cdf(F.lit(-1.6448536269)).alias("c"), chi2_sf(F.lit(None).cast("double"), 1).alias("d")).first()
    assert r.a == pytest.approx(0.05, abs=1e-6) and r.b == pytest.approx(0.05, abs=1e-9) and r.c == pytest.approx(0.05, abs=1e-6) and r.d is None


def test_kupiec_golden_value(spark):
    r = spark.range(1).select(backtest.kupiec_lr(F.lit(1972), F.lit(24), F.lit(0.01)).alias("lr")).first()
    assert r.lr == pytest.approx(0.8775730410, abs=1e-8)
    zero = spark.range(1).select(backtest.kupiec_lr(F.lit(250), F.lit(0), F.lit(0.01)).alias("lr")).first()
    assert zero.lr == pytest.approx(-2 * 250 * math.log(0.99))


def test_violation_transitions(spark):
    flags = [0, 0, 1, 1, 0, 0, 1, 0, 0, 0]
    rows = [("A", 0.95, 1, 10, DAY + dt.timedelta(days=k), bool(v)) for k, v in enumerate(flags)]
    df = spark.createDataFrame(rows, "asset string, confidence_level double, horizon int, estimation_window int, date date, violation boolean")
    t = backtest.transitions(df).first()
    assert (t.n00, t.n01, t.n10, t.n11) == (4, 2, 2, 1)
    assert backtest.accuracy(df).first().hit_rate == pytest.approx(0.3)


def test_order_statistics(spark):
    df = spark.createDataFrame([("A", float(x)) for x in range(1, 101)], "asset string, loss double")
    r = risk.order_statistic_by_group(df, ["asset"], [0.95]).first()
    assert (r["var"], r["cvar"]) == (96.0, 98.0)
    packed = df.groupBy().agg(F.collect_list("loss").alias("l")).select(risk.order_statistic_var_cvar(F.col("l"), F.lit(0.95)).alias("x")).first().x
    assert (packed["var"], packed["cvar"]) == (96.0, 98.0)
    q = risk.quantile_var_cvar(df, ["asset"], [0.95]).first()
    assert q["var"] == pytest.approx(95.05)


def test_structure_and_drawdown(spark):
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.3), (1, "c", 0.2)], "portfolio_id long, asset string, w double")
    s = portfolio.structure(w).first()
    assert s.hhi == pytest.approx(0.38) and s.effective_number == pytest.approx(2.631579, abs=1e-6) and s.entropy == pytest.approx(1.0297, abs=1e-4)
    d = spark.range(1).select(max_drawdown(F.array(F.lit(0.1), F.lit(-0.2), F.lit(0.05))).alias("d")).first().d
    assert d == pytest.approx(0.2)


def test_gap_filling(spark):
    p = [1.0, None, 4.0, None]
    days = [0, 1, 3, 5]
    df = spark.createDataFrame([("A", DAY + dt.timedelta(days=k), v) for k, v in zip(days, p)], "asset string, date date, price double")
    assert [r.price for r in prep.fill_time(df).orderBy("date").collect()] == [1.0, 2.0, 4.0, 4.0]
    assert [r.price for r in prep.fill_linear(df).orderBy("date").collect()] == [1.0, 2.5, 4.0, 4.0]
    assert [r.price for r in prep.fill_forward(df).orderBy("date").collect()] == [1.0, 1.0, 4.0, 4.0]
    assert [r.price for r in prep.fill_backward(df).orderBy("date").collect()] == [1.0, 4.0, 4.0, None]


def portfolios(spark, n=40):
    rng = np.random.default_rng(9)
    w = rng.dirichlet(np.ones(4), size=n)
    return spark.createDataFrame([(p, f"X{a}", float(w[p, a])) for p in range(n) for a in range(4)], "portfolio_id long, asset string, w double"), w


def test_evaluation_paths_agree(spark, panel):
    rets, m = panel
    weights, w = portfolios(spark)
    inline = {r.portfolio_id: r for r in portfolio.evaluate(weights, rets).collect()}
    joined = {r.portfolio_id: r for r in portfolio.evaluate(weights, rets, max_cells=10).collect()}
    x = w @ m.T
    for p in range(len(w)):
        assert inline[p].mean == pytest.approx(x[p].mean())
        assert inline[p].value_at_risk == pytest.approx(abs(np.quantile(x[p], 0.05)))
        c = np.cumprod(1 + x[p])
        assert inline[p].max_drawdown == pytest.approx(-(c / np.maximum.accumulate(c) - 1).min())
        for name in portfolio.STATISTICS:
            assert inline[p][name] == pytest.approx(joined[p][name], rel=1e-9, abs=1e-12), name
    assert portfolio.evaluate(weights, rets.filter("date < '1990-01-01'")).count() == 0
    sliced = portfolio.evaluate(weights, rets, "year")
    again = portfolio.evaluate(weights, rets, "year", max_cells=10)
    assert sliced.count() == again.count() == 2 * len(w)


def test_daily_returns_agree_with_and_without_salt(spark, panel):
    rets, m = panel
    weights, w = portfolios(spark, 5)
    some = rets.filter("NOT (asset = 'X3' AND day(date) < 10)")
    for renormalise in (True, False):
        a = {(r.portfolio_id, r.date): r.r for r in portfolio.portfolio_returns(weights, some, renormalise).collect()}
        b = {(r.portfolio_id, r.date): r.r for r in portfolio.portfolio_returns(weights, some, renormalise, max_broadcast=10).collect()}
        assert a.keys() == b.keys() and len(a) == 300
        assert all(a[k] == pytest.approx(b[k]) for k in a)
    c = {(r.portfolio_id, r.date): r.r for r in portfolio.batch_returns(weights, rets).collect()}
    assert c[(2, dt.date(2020, 1, 1))] == pytest.approx(float(w[2] @ m[0]))


def test_ex_ante_paths_agree(spark, panel):
    rets, m = panel
    weights, w = portfolios(spark)
    mu, cov = factors.expected_returns(rets), factors.sample_covariance(rets)
    a = {r.portfolio_id: r for r in portfolio.ex_ante(weights, mu, cov).collect()}
    b = {r.portfolio_id: r for r in portfolio._ex_ante_by_join(weights, mu, cov, 0.0).collect()}
    s = np.cov(m.T)
    for p in range(len(w)):
        assert a[p].variance == pytest.approx(w[p] @ s @ w[p]) == pytest.approx(b[p].variance)
        assert a[p].expected_return == pytest.approx(b[p].expected_return)


def test_global_order_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    v = np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000).round(2))
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "id long, v double")
    got = {r.id: r["rank"] for r in ordering.global_row_number(df, [F.col("v"), F.col("id")]).collect()}
    want = {k: n + 1 for n, k in enumerate(sorted(range(len(v)), key=lambda k: (v[k], k)))}
    assert got == want
    pr = {r.id: r.percent_rank for r in ordering.percent_rank(df, "v").collect()}
    assert pr[int(np.argmax(v == 7.0))] == pytest.approx((v < 7.0).sum() / 2999)
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for limit in (10, 10_000):
        q = {r.q: r.quantile for r in ordering.exact_quantiles(df, [], "v", qs, limit).collect()}
        for k in qs:
            assert q[k] == pytest.approx(np.quantile(v, k))
    keyed = df.withColumn("g", F.col("id") % 2)
    q = {(r.g, r.q): r.quantile for r in ordering.exact_quantiles(keyed, ["g"], "v", qs, 10).collect()}
    assert q[(1, 0.9)] == pytest.approx(np.quantile(v[1::2], 0.9))


def test_pareto_fronts_match_brute_force(spark):
    from riskloom.operators import compare

    rng = np.random.default_rng(11)
    v = rng.normal(size=(400, 3)).round(1)
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(v)], "portfolio_id long, a double, b double, c double")
    s = v * np.array([1, -1, 1])
    brute = lambda m: {k for k in range(len(m)) if not ((m >= m[k]).all(axis=1) & (m > m[k]).any(axis=1)).any()}
    up = {"a": True, "b": False, "c": True}
    for cells in (1, 64, compare.GRID_CELLS):
        got = [r.portfolio_id for r in compare.pareto_front(df, up, cells=cells).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(s)
    flat = np.column_stack([v[:, 0], v[:, 0] + v[:, 1], -v[:, 1]])  # none dominates another but by ties: almost all stay
    flat_df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(flat)] + [(900, None, 0.0, 0.0)], df.schema)
    assert {r.portfolio_id for r in compare.pareto_front(flat_df, up).collect()} == brute(flat * np.array([1, -1, 1]))
    assert compare.pareto_front(df.limit(0), up).count() == 0
    two = {r.portfolio_id for r in compare.pareto_front_2d(df, "a", "b").collect()}
    assert two == brute(s[:, :2])


def test_garch_grid_matches_a_loop(spark, panel):
    rets, m = panel
    got = {(r.asset, r.date): r for r in volatility.garch_forecasts(rets, 30, 10).collect()}
    start = dt.date(2020, 1, 1)
    x = m[0:30, 0]
    e2, best = (x - x.mean()) ** 2, None
    for g in volatility.garch_grid():
        a, b = g["alpha"], g["beta"]
        om, v, ll = e2.mean() * (1 - a - b), e2.mean(), 0.0
        for e in e2:
            ll -= 0.5 * (math.log(v) + e / v)
            v = om + a * e + b * v
        if best is None or ll > best[0] + 1e-12:
            best = (ll, a, b, v)
    r = got[("X0", start + dt.timedelta(days=7 * 30))]
    assert (r.alpha, r.beta) == (best[1], best[2]) and r.sigma == pytest.approx(math.sqrt(best[3])) and r.log_likelihood == pytest.approx(best[0])


def test_gpd_fit_and_threshold(spark, panel):
    rets, m = panel
    r = evt.pot_parameters(rets, 60, [0.9], 5).filter("asset = 'X1'").first()
    losses = np.sort(-m[:, 1])
    u = np.quantile(losses, 0.9)
    x = np.sort(losses[losses > u] - u)
    n = len(x)
    m0, m1 = x.mean(), np.mean(x * (n - 1 - np.arange(n)) / (n - 1))
    assert r.threshold == pytest.approx(u) and r.num_exceedances == n
    assert r.xi == pytest.approx(np.clip(2 - m0 / (m0 - 2 * m1), -0.5, 0.5)) and r.beta == pytest.approx(max(0.001, 2 * m0 * m1 / (m0 - 2 * m1)))


def test_shrinkage_and_eigen_factors(spark, panel):
    rets, m = panel
    x = m - m.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(((x ** 2).T @ (x ** 2) / n - s ** 2).sum() / (p * n), d2)
    got = {(r.i, r.j): r for r in factors.shrunk_covariance(rets).collect()}
    assert got[("X0", "X0")].shrinkage == pytest.approx(b2 / d2)
    assert got[("X0", "X1")]["cov"] == pytest.approx((1 - b2 / d2) * s[0, 1])
    cov = factors.sample_covariance(rets).select(F.lit(0).alias("date"), "i", "j", "cov")
    f = factors.eigen_factors(cov, 2).orderBy("factor_id").collect()
    ev = np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1]
    assert [r.eigenvalue for r in f] == pytest.approx(list(ev[:2])) and f[1].cumulative_explained_variance == pytest.approx(ev[:2].sum() / ev.sum())
    repaired = factors.repair_psd(spark.createDataFrame([(0, "a", "a", 1.0), (0, "a", "b", 2.0), (0, "b", "b", 1.0)], "date int, i string, j string, cov double"), "date")
    k = np.array([[r["cov"] for r in repaired.orderBy("i", "j").collect()]]).ravel()
    assert np.linalg.eigvalsh([[k[0], k[1]], [k[1], k[2]]]).min() > -1e-12


def test_equal_risk_and_posterior(spark, panel):
    rets, m = panel
    cov = factors.sample_covariance(rets)
    sets = spark.createDataFrame([("all", ["X0", "X1", "X2", "X3"]), ("two", ["X0", "X2"])], "set_id string, assets array<string>")
    e = {r.set_id: r for r in selection.equal_risk_weights(sets, cov).collect()}
    s = np.cov(m.T)
    w = np.array(e["all"].weights)
    rc = w * (s @ w)
    assert rc.std() / rc.mean() < 1e-6 and w.sum() == pytest.approx(1) and e["two"].deviation_score < 1e-6
    prior = spark.createDataFrame([(f"X{k}", 0.01 * (k + 1)) for k in range(4)], "asset string, pi double")
    views = spark.createDataFrame([("v1", "X0", 1.0, 0.05, 0.5), ("v2", "X1", 1.0, 0.02, 0.9), ("v2", "X3", -1.0, 0.02, 0.9)], "view_id string, asset string, p double, q double, confidence double")
    post = {r.set_id: r for r in black_litterman.posterior(sets, cov, prior, views).collect()}
    tau, pi, q = 0.025, np.array([0.01, 0.02, 0.03, 0.04]), np.array([0.05, 0.02])
    p = np.array([[1, 0, 0, 0], [0, 1, 0, -1.0]])
    om = np.diag(np.diag(tau * p @ s @ p.T))
    inv = np.linalg.inv
    mm = inv(inv(tau * s) + p.T @ inv(om) @ p)
    want = mm @ (inv(tau * s) @ pi + p.T @ inv(om) @ q)
    assert post["all"].posterior == pytest.approx(list(want)) and post["all"].n_views == 2 and post["two"].n_views == 1
    assert post["all"].posterior_variance == pytest.approx(list(np.diag(s + mm)))


def test_posterior_slices_match_numpy(spark, panel):
    rets, m = panel
    names = ["X0", "X1", "X2", "X3"]
    cov, s = factors.sample_covariance(rets), np.cov(m.T)
    market = spark.createDataFrame(list(zip(names, [0.4, 0.3, 0.2, 0.1])), "asset string, w double")
    pi = np.array([0.01, 0.02, 0.03, 0.04])
    prior = spark.createDataFrame(list(zip(names, map(float, pi))), "asset string, pi double")
    views = spark.createDataFrame([("v1", "X0", 1.0, 0.05, 0.5)], "view_id string, asset string, p double, q double, confidence double")
    sets = spark.createDataFrame([("all", names), ("unseen", ["X1", "X3"])], "set_id string, assets array<string>")
    tau = 0.025

    def weights(at, view):
        c, mu = s[np.ix_(at, at)], pi[at]
        mm = tau * c
        if view:
            p = np.array([1.0] + [0.0] * (len(at) - 1))
            om = tau * p @ c @ p
            inv = np.linalg.inv
            mm = inv(inv(tau * c) + np.outer(p, p) / om)
            mu = mm @ (inv(tau * c) @ mu + p * 0.05 / om)
        raw = np.maximum(np.linalg.inv(c + mm) @ mu, 0)
        return raw / raw.sum()

    dates = sorted(r.date for r in rets.select("date").distinct().collect())
    for slice_type, key in (("year", lambda x: str(x.year)), ("quarter", lambda x: f"{x.year}Q{(x.month + 2) // 3}")):
        got = {(r.set_id, r.slice): r for r in black_litterman.posterior_slices(sets, rets, cov, prior, views, market, slice_type, 52).collect()}
        assert {k[1] for k in got} == {key(x) for x in dates} and len(got) == 2 * len({key(x) for x in dates})
        for (name, period), r in got.items():
            at = [0, 1, 2, 3] if name == "all" else [1, 3]
            rows = m[[key(x) == period for x in dates]]
            own, plain = rows[:, at] @ weights(at, name == "all"), rows[:, at] @ weights(at, False)
            for d, bench in ((own - plain, "prior"), (own - rows @ [0.4, 0.3, 0.2, 0.1], "market")):
                assert r[f"active_return_vs_{bench}"] == pytest.approx(d.mean() * 52, abs=1e-12)
                if len(d) > 1:
                    assert r[f"tracking_error_vs_{bench}"] == pytest.approx(d.std(ddof=1) * 52**0.5, abs=1e-12)
        assert any(abs(r.active_return_vs_prior) > 1e-6 for k, r in got.items() if k[0] == "all")


def test_scenarios_are_reproducible(spark, panel):
    rets, m = panel
    w = rolling.latest_per_key(rolling.window_arrays(rets, 30), ["asset"]).drop("current")
    a = scenarios.iid_paths(scenarios.simulations(w, 50), 5)
    first = sorted((r.asset, r.sim, tuple(r.path)) for r in a.collect())
    assert first == sorted((r.asset, r.sim, tuple(r.path)) for r in a.repartition(3).collect())
    values = set(np.round(m[30:, 0], 12))
    assert all(round(x, 12) in values for asset, _, path in first if asset == "X0" for x in path)
    n = scenarios.normal_paths(scenarios.simulations(w, 2000), 1).filter("asset = 'X2'").select(F.avg(F.col("path")[0]).alias("m"), F.stddev(F.col("path")[0]).alias("s")).first()
    assert n.m == pytest.approx(m[30:, 2].mean(), abs=0.002) and n.s == pytest.approx(m[30:, 2].std(ddof=1), rel=0.08)


def test_as_of_matching(spark):
    d = lambda k: DAY + dt.timedelta(days=k)
    right = spark.createDataFrame([("A", d(0)), ("A", d(10))], "asset string, date date")
    left = spark.createDataFrame([("A", d(4)), ("A", d(6)), ("A", d(10)), ("A", d(12))], "asset string, date date")
    get = lambda mode: [r.matched for r in selection.as_of(left, right, "asset", mode).orderBy("date").collect()]
    assert get("backward") == [d(0), d(0), d(10), d(10)]
    assert get("forward") == [d(10), d(10), d(10), d(10)]
    assert get("nearest") == [d(0), d(10), d(10), d(10)]


@pytest.fixture(scope="module")
def edge_weights(spark, panel):
    """A held portfolio, one of zeros, one of unknown assets only, one of both kinds, one with a NULL weight."""
    rows = [(1, "X0", 0.4), (1, "X3", 0.6), (2, "X0", 0.0), (2, "X1", 0.0), (3, "ZZ", 1.0), (4, "ZZ", 0.5), (4, "X2", 0.5), (5, "X1", None), (5, "X2", 1.0)]
    return spark.createDataFrame(rows, "portfolio_id bigint, asset string, w double")


def _rows(df, digits=9):
    return sorted(tuple("~" if v is None else round(v, digits) if isinstance(v, float) else str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("slice_type", [None, "year"])
def test_evaluate_ways_agree_on_edge_portfolios(panel, edge_weights, slice_type):
    rets, _ = panel
    inline, joined = portfolio.evaluate(edge_weights, rets, slice_type), portfolio.evaluate(edge_weights, rets, slice_type, max_cells=10)
    assert inline.columns == joined.columns and _rows(inline) == _rows(joined)
    ids = {r.portfolio_id: r for r in inline.collect()}
    assert set(ids) == {1, 2, 3, 4, 5} and ids[2]["mean"] is None and ids[3]["std"] is None and ids[4]["mean"] is not None


def test_returns_and_ex_ante_ways_agree_on_edge_portfolios(spark, panel, edge_weights):
    rets, m = panel
    a, b = portfolio.batch_returns(edge_weights, rets), portfolio.batch_returns(edge_weights, rets, max_cells=10)
    assert _rows(a.select("portfolio_id", "date", "r")) == _rows(b.select("portfolio_id", "date", "r")) and a.where("portfolio_id = 3 and r is null").count() == 60
    mu = spark.createDataFrame([(f"X{i}", float(m[:, i].mean())) for i in range(4)], "asset string, mu double")
    c = np.cov(m.T)
    cov = spark.createDataFrame([(f"X{i}", f"X{j}", float(c[i, j])) for i in range(4) for j in range(i, 4)], "i string, j string, cov double")
    inline, joined = portfolio.ex_ante(edge_weights, mu, cov), portfolio.ex_ante(edge_weights, mu, cov, max_unrolled=2)
    assert _rows(inline) == _rows(joined)
    assert {r.portfolio_id for r in inline.where("variance is null").collect()} == {2, 3}
    best = selection.best_candidates(inline, []).first()
    assert best.min_variance > 0 and best.min_variance_id in (1, 4, 5)
    dated = cov.selectExpr("date'2020-01-01' AS date", "*")
    chosen = [selection.rolling_min_variance(edge_weights, dated, n).collect() for n in (64, 2)]
    assert chosen[0][0].portfolio_id == chosen[1][0].portfolio_id == best.min_variance_id


def test_panel_with_gaps_is_an_error(panel, edge_weights):
    rets, _ = panel
    gap = rets.where("NOT (asset = 'X1' AND date = '2020-01-01')")
    for cells in (10, 10_000):
        with pytest.raises(ValueError, match="align"):
            portfolio.evaluate(edge_weights, gap, max_cells=cells)
        with pytest.raises(ValueError, match="align"):
            portfolio.batch_returns(edge_weights, gap, max_cells=cells)


def test_quantiles_and_ranks_keep_nulls(spark):
    rows = [("a", float(v)) for v in range(7)] + [(None, 1.0), (None, 5.0), ("none", None), ("a", None), ("b", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    small, large = (ordering.exact_quantiles(df, ["k"], "v", [0.25, 0.5, 1.0], n) for n in (1000, 0))
    assert _rows(small) == _rows(large) and small.count() == 12
    assert _rows(ordering.exact_quantiles(df, [], "v", [0.1, 0.9], 1000)) == _rows(ordering.exact_quantiles(df, [], "v", [0.1, 0.9], 0))
    ranks = ordering.percent_rank(df, "v")
    assert ranks.count() == len(rows) and ranks.where("v is null and percent_rank is null").count() == 2 and ranks.where("v = 6").first().percent_rank == 1.0


def test_losses_beyond_all_compound_alike_on_both_sides_of_the_switch(spark):
    """A short position that loses more than everything: products, not sums of logarithms."""
    import datetime as dt

    from riskloom.operators import portfolio

    day = lambda i: dt.date(2022, 1, 3) + dt.timedelta(days=i)
    rets = spark.createDataFrame([("A", day(i), v) for i, v in enumerate([0.1, 0.2, -0.1])] + [("B", day(i), v) for i, v in enumerate([0.05, 1.9, 0.3])], "asset string, date date, r double")
    weights = spark.createDataFrame([(1, "A", 2.0), (1, "B", -1.0), (2, "A", 1.0)], "portfolio_id bigint, asset string, w double")
    near, far = ({r.portfolio_id: r for r in portfolio.evaluate(weights, rets, max_cells=m).collect()} for m in (1000, 0))
    growth = 1.0
    for a, b in zip([0.1, 0.2, -0.1], [0.05, 1.9, 0.3]):
        growth *= 1 + 2 * a - b
    for p in (1, 2):
        for c in ("compounded_return", "annual_growth", "max_drawdown", "mean"):
            x, y = near[p][c], far[p][c]
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-12), (p, c, x, y)
    assert growth < 0 and abs(far[1].compounded_return - (growth - 1)) < 1e-12


def test_a_missing_component_is_the_worst(spark):
    from riskloom.operators import compare

    rows = [("full", 0.95, 1, 0.05, 1.0, 0.3, False), ("bare", 0.95, 1, 0.05, 1.0, None, False), ("bad", 0.95, 1, 0.05, 1.0, 0.9, False)]
    metrics = spark.createDataFrame(rows, "model string, confidence_level double, horizon int, hit_rate double, violation_ratio double, rmse_violations double, kupiec_reject boolean")
    ranks = {r.model: r["rank"] for r in compare.model_ranking(metrics).collect()}
    assert ranks["full"] == 1 and ranks["bare"] > 1
    table = spark.createDataFrame([(1, 2.0, 0.1), (2, None, 0.1), (3, 1.0, None), (4, 1.0, 0.3)], "portfolio_id bigint, gain double, risk double")
    ranked, _ = compare.rank_portfolios(table, {"gain": (0.5, True), "risk": (0.5, False)})
    score = {r.portfolio_id: r.score for r in ranked.collect()}
    assert score == {1: 1.0, 2: 0.5, 3: 0.0, 4: 0.0}


def test_top_and_tail_breaks_ties_of_equal_portfolios_by_key(spark):
    from riskloom.operators import compare

    # Copies of one portfolio whose metric differs in its last bits only, by the order of summation.
    noisy = [(k, 0.5 + (5 - k) * 2.0 ** -52) for k in range(6)] + [(10, 0.25), (11, 0.75 - 2.0 ** -53), (12, 0.75), (13, None)]
    df = spark.createDataFrame(noisy, "portfolio_id long, sharpe_ratio double")
    got = {(r["side"], r["rank"]): r["portfolio_id"] for r in compare.top_and_tail(df, "sharpe_ratio", 4).collect()}
    assert [got[("top", k)] for k in range(1, 5)] == [11, 12, 0, 1]
    assert [got[("tail", k)] for k in range(1, 5)] == [10, 0, 1, 2]
