"""Partial autocorrelation and the unit-root test against plain regressions."""

import math

import numpy as np
import pandas as pd
import pytest

from sungrid.operators import stationarity


def series(n, level, seed):
    rng, x = np.random.default_rng(seed), np.zeros(n)
    for i in range(2, n):
        x[i] = level * x[i - 1] + 0.4 * (x[i - 1] - x[i - 2]) + rng.normal()
    return 500 + x


def regression(x, p, begin):
    """Plain least squares of the change on a constant, the level and p changes before."""
    d = np.diff(x, prepend=np.nan)
    at = np.arange(begin, len(x))
    a = np.column_stack([np.ones(len(at)), x[at - 1], *[d[at - k] for k in range(1, p + 1)]])
    ok = ~np.isnan(a).any(axis=1) & ~np.isnan(d[at])
    a, b = a[ok], d[at][ok]
    w, *_ = np.linalg.lstsq(a, b, rcond=None)
    rss = ((b - a @ w) ** 2).sum()
    error = math.sqrt(rss / (len(b) - p - 2) * np.linalg.inv(a.T @ a)[1, 1])
    return w[1] / error, len(b) * math.log(rss / len(b)) + 2 * (p + 2), len(b)


def plain(x):
    most = max(0, min(math.ceil(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 3))
    best = min(range(most + 1), key=lambda p: regression(x, p, most + 1)[1])
    t, _, n = regression(x, best, best + 1)
    return t, best, n


@pytest.fixture(scope="module")
def made():
    gaps = series(300, 0.9, 5)
    gaps[[40, 41, 200]] = np.nan
    return {"walk": series(700, 1.0, 1), "steady": series(500, 0.5, 2), "short": series(23, 0.8, 3), None: series(260, 0.97, 4), "gaps": gaps}


@pytest.fixture(scope="module")
def df(spark, made):
    more = {**made, "flat": np.full(60, 7.0), "two": np.array([1.0, 2.0]), "none": np.full(5, np.nan)}
    rows = [(k, i, None if math.isnan(v) else float(v)) for k, x in more.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, i long, v double").repartition(5)


@pytest.mark.parametrize("rows", [16, 65_536])
def test_unit_root_with_chosen_lags(df, made, rows):
    got = {r.k: r for r in stationarity.unit_root_test(df, key=["k"], index="i", value="v", rows=rows).collect()}
    assert got.keys() == {*made, "flat", "two", "none"}
    for k, x in made.items():
        t, lags, n = plain(x)
        assert (got[k].lags, got[k].n_used) == (lags, n) and got[k].statistic == pytest.approx(t, rel=1e-7), k
    assert all(got[k].statistic is None and got[k].p_value is None and got[k].crit_5 is None for k in ("flat", "two", "none"))
    assert got["steady"].p_value < 0.001 and got["walk"].p_value > 0.1
    assert got["steady"].statistic < got["steady"].crit_1 < got["steady"].crit_5 < got["steady"].crit_10


def test_unit_root_with_given_lags(df, made):
    got = {r.k: r for r in stationarity.unit_root_test(df, key=["k"], index="i", value="v", lags=3, rows=64).collect()}
    for k, x in made.items():
        t, _, n = regression(x, 3, 4)
        assert got[k].lags == 3 and got[k].n_used == n and got[k].statistic == pytest.approx(t, rel=1e-7), k
    assert stationarity.unit_root_test(df.limit(0), key=["k"], index="i", value="v").count() == 0


def test_p_values_meet_the_critical_values():
    """The two published tables agree where they overlap: long series at 1, 5 and 10 %."""
    for p, c in zip((0.01, 0.05, 0.1), stationarity.CRITICAL.values(), strict=True):
        # Moments of a fit whose statistic is the critical value: level and change of unit variance.
        n = 10_000_000
        r = c[0] / math.sqrt(n - 2 + c[0] ** 2)
        m = n * np.array([[1, 0, 0], [0, 1, r], [0, r, 1]])
        row = stationarity._statistic.func(pd.Series([m.ravel()])).iloc[0]
        assert row.statistic == pytest.approx(c[0], rel=1e-6) and row.p_value == pytest.approx(p, abs=0.001)


def test_partial_autocorrelation(df, made):
    got = stationarity.partial_autocorrelation(df.where("k in ('walk', 'steady', 'flat')"), key=["k"], index="i", value="v", lags=12, rows=32).toPandas()
    for k in ("walk", "steady"):
        d = made[k] - made[k].mean()
        r = np.array([1.0] + [(d[j:] * d[:-j]).sum() / (d * d).sum() for j in range(1, 13)])
        # The last weight of the prediction from j rows, each solved on its own.
        want = [np.linalg.solve(r[np.abs(np.subtract.outer(range(j), range(j)))], r[1:j + 1])[-1] for j in range(1, 13)]
        np.testing.assert_allclose(got[got.k == k].sort_values("lag").pacf, want, rtol=1e-8)
    assert got[got.k == "flat"].pacf.isna().all() and len(got) == 36
