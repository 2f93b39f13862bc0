"""Fits over time blocks against the row-wise fits."""

import datetime as dt

import numpy as np
import pytest

from riskloom.operators import evt, sliding_fits, volatility


@pytest.fixture(scope="module")
def series(spark):
    """A heavy-tailed, a repeating, a flat and a short series."""
    rng = np.random.default_rng(11)
    day = lambda i: dt.date(2019, 1, 1) + dt.timedelta(days=i)
    rows = [("tail", day(i), float(v)) for i, v in enumerate(rng.standard_t(3, 90) * 0.01)]
    rows += [("steps", day(i), float(v)) for i, v in enumerate(rng.integers(-2, 3, 90) * 0.01)]
    rows += [("flat", day(i), 0.0) for i in range(60)] + [("short", day(i), 0.01 * i) for i in range(10)]
    return spark.createDataFrame(rows, "asset string, date date, r double").repartition(4)


def table(df, *keys):
    return {tuple(r[k] for k in keys): {c: r[c] for c in df.columns if c not in keys} for r in df.collect()}


def agree(a, b, loose=()):
    assert a.keys() == b.keys() and a
    for k in a:
        for c, v in a[k].items():
            w = b[k][c]
            assert (v is None) == (w is None), (k, c, v, w)
            if v is not None and c not in loose:
                assert v == w if isinstance(v, int) else abs(v - w) < 1e-8, (k, c, v, w)


@pytest.mark.parametrize("mode", ["textbook", "reference"])
@pytest.mark.parametrize("least", [3, 25])
def test_tails(series, mode, least):
    keys = ("asset", "date", "threshold_quantile")
    mine = sliding_fits.pot_parameters(series, 30, [0.95, 0.9], least, mode)
    agree(table(mine, *keys), table(evt.pot_parameters(series, 30, [0.95, 0.9], least, 1, mode).select(mine.columns), *keys))


def test_garch(series):
    got, want = table(sliding_fits.garch_forecasts(series, 40), "asset", "date"), table(volatility.garch_forecasts(series, 40, 1), "asset", "date")
    flat = {k for k in want if k[0] == "flat"}
    agree({k: v for k, v in got.items() if k not in flat}, {k: v for k, v in want.items() if k not in flat})
    assert flat <= got.keys() and all(got[k]["log_likelihood"] is None and got[k]["sigma"] == 0 for k in flat)


def test_student(series):
    got = sliding_fits.student_dof(series, 40)
    agree(table(got, "asset", "date"), table(volatility.student_dof(series, 40, 1), "asset", "date"))


def test_empty(spark):
    none = spark.createDataFrame([], "asset string, date date, r double")
    for df in (sliding_fits.pot_parameters(none, 5, [0.9], 2), sliding_fits.garch_forecasts(none, 5), sliding_fits.student_dof(none, 5)):
        assert df.count() == 0
