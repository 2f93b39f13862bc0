import math

import numpy as np
import pytest

from riskloom.llm import whitening


def plain(rows, components=8):
    """{position: (deviation, whitened)} with the explained shares, in exact and double arithmetic on one machine."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return dev, y @ u / np.sqrt(e), e / np.trace(cov)


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 12 * 7)  # 7 rows of 12
    monkeypatch.setattr(whitening, "MEETING", 2)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_equals_numpy(spark, small_blocks):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12))
    v = (rng.normal(size=(203, 12)) * np.linspace(0.2, 2, 12) @ mix + 3).astype(np.float32)
    v[50:90] = v[49]  # a common vector
    rows = [(int(i), [float(c) for c in r]) for i, r in enumerate(v)]
    got = whitening.whiten(frame(spark, [(*r, 0) for r in rows]).repartition(5)).collect()
    dev, white, share = plain(rows)
    assert len(got) == 8 * len(rows)
    byid = {}
    for r in got:
        assert r.n == 203 and int(r.deviation) == dev[r.vec_id] and abs(r.explained - share[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
        byid[r.vec_id, r.component] = r.whitened
    for c in range(8):
        mine = np.array([byid[i, c + 1] for i in range(203)])
        sign = np.sign(mine @ white[:, c])
        assert np.allclose(sign * mine, white[:, c], atol=1e-8)


def test_large_entries_stay_exact(spark, small_blocks):
    rows = [(i, [float(3e8 * (i % 5) + i), float(i * i), 1e9]) for i in range(30)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert [got[i] for i in range(30)] == plain(rows, 2)[0]


def test_odd_rows(spark, small_blocks):
    """NULLs, other lengths, non-finite and huge entries are left out; repeated and unnamed rows count."""
    rng = np.random.default_rng(8)
    good = [(i if i != 4 else None, [float(c) for c in rng.normal(size=3).astype(np.float32)], None) for i in range(20)] + [(7, [0.5, 0.5, 0.5], 1)] * 3
    bad = [(100, None, 0), (101, [1.0, None, 2.0], 0), (102, [float("nan"), 0.0, 1.0], 0), (103, [float("inf"), 0.0, 1.0], 0), (104, [1.0, 2.0], 0), (105, [], 0), (106, [0.0, -1e30, 0.0], 0)]
    got = whitening.whiten(frame(spark, good + bad)).collect()
    assert len(got) == 3 * len(good) and {r.n for r in got} == {len(good)} and {r.component for r in got} == {1, 2, 3}
    assert sorted(str(r.vec_id) for r in got if r.component == 1) == sorted(str(r[0]) for r in good)
    assert sorted(int(r.deviation) for r in got if r.component == 2) == sorted(plain(good and [(i, v) for i, v, _ in good], 3)[0])


def test_nothing_to_scale(spark):
    """Empty tables, one vector and equal vectors have no component with variance."""
    for rows in ([], [(1, [0.5, 0.25], 0)], [(i, [0.5, 0.25], 0) for i in range(5)], [(1, None, 0)]):
        out = whitening.whiten(frame(spark, rows))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    two = whitening.whiten(frame(spark, [(1, [0.0, 0.0], 0), (2, [1.0, 1.0], 0)])).collect()
    assert sorted((r.vec_id, r.component, round(r.whitened, 9)) for r in two) == [(1, 1, -1.0), (2, 1, 1.0)]
