"""Covariance estimators, shrinkage, risk contributions and eigen-factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import ratio
from riskloom.functions.constants import TRADING_DAYS
from riskloom.operators.rolling import pair_returns
from riskloom.session import materialise


def last_rows(rets: DataFrame, window: int | None) -> DataFrame:
    """The last ``window`` dates of each asset (all when None)."""
    if window is None:
        return rets
    back = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date")))
    return rets.withColumn("__b", back).filter(F.col("__b") <= window).drop("__b")


def expected_returns(rets: DataFrame, window: int | None = None, periods: float = TRADING_DAYS) -> DataFrame:
    return last_rows(rets, window).groupBy("asset").agg((F.avg("r") * periods).alias("mu"))


def sample_covariance(rets: DataFrame, window: int | None = None) -> DataFrame:
    """(i, j, cov, corr) for i <= j."""
    return pair_returns(last_rows(rets, window)).groupBy("i", "j").agg(F.covar_samp("ri", "rj").alias("cov"), F.corr("ri", "rj").alias("corr"))


def mirror(cov: DataFrame) -> DataFrame:
    """All (i, j) entries of a symmetric table stored for i <= j."""
    other = cov.filter("i <> j").withColumnsRenamed({"i": "__i"}).withColumnsRenamed({"j": "i"}).withColumnsRenamed({"__i": "j"})
    return cov.unionByName(other)


def _centred(rets: DataFrame) -> DataFrame:
    mean = F.avg("r").over(Window.partitionBy("asset"))
    return rets.select("asset", "date", (F.col("r") - mean).alias("r"))


def shrunk_covariance(rets: DataFrame, method: str = "ledoit_wolf", window: int | None = None) -> DataFrame:
    """(i, j, cov, shrinkage): population covariance shrunk to a scaled identity.

    Everything the intensity needs is a sum over pairs, so one aggregate over the
    pair table gives it as a scalar.
    """
    pairs = pair_returns(_centred(last_rows(rets, window)))
    s = pairs.groupBy("i", "j").agg(
        F.avg(F.col("ri") * F.col("rj")).alias("s"), F.avg(F.col("ri") ** 2 * F.col("rj") ** 2).alias("q"), F.count("*").alias("n")
    )
    diag = F.col("i") == F.col("j")
    twice = F.when(diag, 1.0).otherwise(2.0)
    t = s.agg(
        F.count_if(diag).alias("p"), F.max("n").alias("n"), (F.sum(F.when(diag, F.col("s"))) / F.count_if(diag)).alias("mu"),
        F.sum(twice * F.col("s") ** 2).alias("s2"), F.sum(twice * F.col("q")).alias("q"),
    )
    p, n, mu, s2, q = (F.col(c) for c in ("p", "n", "mu", "s2", "q"))
    if method == "ledoit_wolf":
        spread_ = (s2 - p * mu * mu) / p
        noise = F.least((q - s2) / (p * n), spread_)
        delta = F.when(noise == 0, F.lit(0.0)).otherwise(ratio(noise, spread_))
    elif method == "oas":
        alpha = s2 / (p * p)
        delta = F.least(F.lit(1.0), F.coalesce(ratio(alpha + mu * mu, (n + 1) * (alpha - mu * mu / p)), F.lit(1.0)))
    else:
        raise ValueError(f"unknown shrinkage {method!r}")
    pars = t.select(F.struct(delta.alias("delta"), mu.alias("mu")).alias("k")).scalar()
    out = s.withColumn("k", pars)
    target = F.when(diag, F.col("k.delta") * F.col("k.mu")).otherwise(0.0)
    return out.select("i", "j", ((1 - F.col("k.delta")) * F.col("s") + target).alias("cov"), F.col("k.delta").alias("shrinkage"))


def ewma_covariance(rets: DataFrame, lam: float = 0.94, window: int | None = None) -> DataFrame:
    """Exponentially weighted covariance with the weighted mean removed."""
    base = last_rows(rets, window)
    back = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date"))) - 1
    w = base.withColumn("k", F.pow(F.lit(lam), back))
    w = w.withColumn("k", F.col("k") / F.sum("k").over(Window.partitionBy("asset")))
    mean = F.sum(F.col("k") * F.col("r")).over(Window.partitionBy("asset"))
    # Scaling each side by sqrt(k) puts the weight into the product.
    scaled = w.select("asset", "date", ((F.col("r") - mean) * F.sqrt("k")).alias("r"))
    return pair_returns(scaled).groupBy("i", "j").agg(F.sum(F.col("ri") * F.col("rj")).alias("cov"))


def trace_normalised(cov: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Covariance divided by its trace (unit-trace matrix), per key."""
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("cov"))).over(Window.partitionBy(*(keys or (F.lit(0),))))
    return cov.withColumn("rho", ratio(F.col("cov"), trace))


def _matrix(pdf):
    import numpy as np

    names = sorted(set(pdf["i"]) | set(pdf["j"]))
    pos = {a: k for k, a in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, v in zip(pdf["i"], pdf["j"], pdf["cov"]):
        m[pos[a], pos[b]] = m[pos[b], pos[a]] = v
    return names, m


def repair_psd(cov: DataFrame, key: str, floor: float = 1e-10) -> DataFrame:
    """Clip negative eigenvalues of each matrix and report its condition number.

    One small dense matrix per key; keys are processed in parallel.
    """
    import numpy as np
    import pandas as pd

    key_type = cov.schema[key].dataType.simpleString()

    def fix(pdf):
        names, m = _matrix(pdf)
        ev, vec = np.linalg.eigh(m)
        if ev.min() < floor:
            ev = np.maximum(ev, floor)
            m = (vec * ev) @ vec.T
        i, j = np.triu_indices(len(names))
        return pd.DataFrame({key: pdf[key].iloc[0], "i": np.array(names)[i], "j": np.array(names)[j], "cov": m[i, j], "condition_number": ev.max() / ev.min()})

    return cov.select(key, "i", "j", "cov").groupBy(key).applyInPandas(fix, f"{key} {key_type}, i string, j string, cov double, condition_number double")


def eigen_factors(cov: DataFrame, top_k: int, key: str = "date") -> DataFrame:
    """Top factors of each matrix: eigenvalue, explained share, cumulative share and loadings.

    (key, factor_id, eigenvalue, explained_variance_ratio, cumulative_explained_variance, loadings ARRAY in asset order)
    """
    import numpy as np
    import pandas as pd

    key_type = cov.schema[key].dataType.simpleString()

    def factors(pdf):
        names, m = _matrix(pdf)
        ev, vec = np.linalg.eigh(m)
        order = np.argsort(ev)[::-1]
        ev, vec = ev[order], vec[:, order]
        vec = vec * np.where(vec[np.abs(vec).argmax(axis=0), np.arange(len(names))] < 0, -1.0, 1.0)  # fixed sign
        share = ev / ev.sum()
        k = min(top_k, len(names))
        return pd.DataFrame({
            key: [pdf[key].iloc[0]] * k, "factor_id": np.arange(1, k + 1), "eigenvalue": ev[:k], "explained_variance_ratio": share[:k],
            "cumulative_explained_variance": share.cumsum()[:k], "assets": [names] * k, "loadings": [vec[:, c].tolist() for c in range(k)],
        })

    schema = (f"{key} {key_type}, factor_id int, eigenvalue double, explained_variance_ratio double, cumulative_explained_variance double, "
              "assets array<string>, loadings array<double>")
    return cov.select(key, "i", "j", "cov").groupBy(key).applyInPandas(factors, schema)


def exposures(factors: DataFrame, key: str = "date") -> DataFrame:
    """(key, factor_id, asset, exposure, eigenvalue) from the loading arrays."""
    return factors.select(key, "factor_id", "eigenvalue", F.explode(F.arrays_zip("assets", "loadings")).alias("e")).select(
        key, "factor_id", F.col("e.assets").alias("asset"), F.col("e.loadings").alias("exposure"), "eigenvalue"
    )


def factor_risk(expo: DataFrame, total_variance: DataFrame, grid: Column, key: str = "date") -> DataFrame:
    """Idiosyncratic variance and factor-implied Gaussian VaR/CVaR per asset."""
    from riskloom.functions.columns import fan_out

    explained = expo.groupBy(key, "asset").agg(F.sum(F.col("exposure") ** 2 * F.col("eigenvalue")).alias("explained"))
    j = explained.join(total_variance, [key, "asset"])
    idio = F.greatest(F.col("variance") - F.col("explained"), F.lit(1e-12))
    out = j.withColumn("idiosyncratic_variance", idio).withColumn("sigma", F.sqrt(F.greatest(F.col("explained") + F.col("idiosyncratic_variance"), F.lit(1e-12))))
    out = fan_out(out, grid)
    return out.select(key, "asset", "confidence_level", "idiosyncratic_variance", (-F.col("z") * F.col("sigma")).alias("var_factor"), (F.col("es") * F.col("sigma")).alias("cvar_factor"))


def factor_shock_loss(expo: DataFrame, shock_sigma: float, key: str = "date") -> DataFrame:
    """Loss per asset when every factor moves by ``shock_sigma`` of its own volatility."""
    move = F.col("exposure") * shock_sigma * F.sqrt(F.greatest("eigenvalue", F.lit(0.0)))
    return expo.groupBy(key, "asset").agg((-F.sum(move)).alias("shock_loss"))


def factor_stability(factors: DataFrame, key: str = "date") -> DataFrame:
    """Mean |cos| between each factor's loadings and the previous window's."""
    from riskloom.functions.columns import dot

    prev = F.lag("loadings").over(Window.partitionBy("factor_id").orderBy(key))
    s = factors.withColumn("prev", prev).filter("prev IS NOT NULL")
    return s.groupBy(key).agg(F.avg(F.abs(dot(F.col("loadings"), F.col("prev")))).alias("factor_stability"))


def compare_factor_sets(a: DataFrame, b: DataFrame, key: str = "date") -> DataFrame:
    """Principal angle, explained-variance gap, exposure correlation and Frobenius distance of two factor sets."""
    import numpy as np
    import pandas as pd

    key_type = a.schema[key].dataType.simpleString()

    def pack(f: DataFrame, name: str) -> DataFrame:
        return f.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("factor_id", "eigenvalue", "loadings"))).alias(name))

    joined = pack(a, "a").join(pack(b, "b"), key)

    def angles(batches):
        for pdf in batches:
            rows = []
            for kv, fa, fb in zip(pdf[key], pdf["a"], pdf["b"]):
                va, vb = np.array([x["loadings"] for x in fa]).T, np.array([x["loadings"] for x in fb]).T
                ea, eb = np.array([x["eigenvalue"] for x in fa]), np.array([x["eigenvalue"] for x in fb])
                cos = np.clip(np.linalg.svd(va.T @ vb, compute_uv=False), -1, 1)
                gap = np.abs(ea.cumsum() / ea.sum() - eb.cumsum() / eb.sum()).max()
                corr = [np.corrcoef(va[:, c], vb[:, c])[0, 1] for c in range(va.shape[1])]
                rows.append((kv, float(np.arccos(cos).mean()), float(gap), float(np.nan_to_num(corr).mean()), float(np.linalg.norm((va * ea) @ va.T - (vb * eb) @ vb.T))))
            yield pd.DataFrame(rows, columns=[key, "principal_angle", "explained_variance_gap", "exposure_correlation", "frobenius_distance"])

    return joined.mapInPandas(angles, f"{key} {key_type}, principal_angle double, explained_variance_gap double, exposure_correlation double, frobenius_distance double")


def risk_contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """(portfolio_id, asset, w, marginal, contribution, portfolio_volatility) for the held assets.

    Contribution of asset i is w_i (S w)_i / sigma_p.
    """
    a = weights.filter("w > 0")
    # Written first, so that the planner knows its size before it moves any weights.
    full = materialise(mirror(cov.select("i", "j", "cov")), "covariance")
    sw = a.withColumnsRenamed({"asset": "j"}).join(full, "j")
    sw = sw.groupBy("portfolio_id", F.col("i").alias("asset")).agg(F.sum(F.col("cov") * F.col("w")).alias("sw"))
    out = a.join(sw, ["portfolio_id", "asset"])
    vol = F.sqrt(F.sum(F.col("w") * F.col("sw")).over(Window.partitionBy("portfolio_id")))
    return out.withColumn("portfolio_volatility", vol).select(
        "portfolio_id", "asset", "w", ratio(F.col("sw"), F.col("portfolio_volatility")).alias("marginal"),
        ratio(F.col("w") * F.col("sw"), F.col("portfolio_volatility")).alias("contribution"), "portfolio_volatility",
    )


def risk_parity_scores(rc: DataFrame) -> DataFrame:
    """How far the risk contributions of each portfolio are from equal."""
    target = F.col("portfolio_volatility") / F.count("*").over(Window.partitionBy("portfolio_id"))
    g = rc.withColumn("target", target).groupBy("portfolio_id").agg(
        F.avg("contribution").alias("mean_contribution"), F.var_pop("contribution").alias("variance"), F.stddev_pop("contribution").alias("std"),
        F.max("contribution").alias("max_risk_contribution"), F.min("contribution").alias("min_risk_contribution"),
        F.avg(F.abs(F.col("contribution") - F.col("target"))).alias("equal_risk_gap"),
        ratio(F.sqrt(F.avg((F.col("contribution") - F.col("target")) ** 2)), F.first("target")).alias("deviation_score"),
        F.avg("marginal").alias("mean_marginal"),
    )
    return g.withColumn("coefficient_of_variation", F.when(F.col("mean_contribution") > 0, F.col("std") / F.col("mean_contribution")))


def compare_risk_gaps(own: DataFrame, baseline: DataFrame) -> DataFrame:
    """Mean distance from equal risk contributions of each portfolio and of its baseline, and by how much it is smaller."""
    a = risk_parity_scores(own).select("portfolio_id", "equal_risk_gap", "deviation_score")
    b = risk_parity_scores(baseline).select("portfolio_id", F.col("equal_risk_gap").alias("equal_weight_gap"), F.col("deviation_score").alias("baseline_score"))
    return a.join(b, "portfolio_id").select(
        "portfolio_id", "equal_risk_gap", "equal_weight_gap", (F.col("equal_weight_gap") - F.col("equal_risk_gap")).alias("gap_reduction"),
        (F.col("baseline_score") - F.col("deviation_score")).alias("deviation_reduction"),
    )
