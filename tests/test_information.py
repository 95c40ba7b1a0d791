"""The nearest-neighbour estimate against comparing all points."""

import numpy as np
import pandas as pd
import pytest

from sungrid.operators import information


def digamma(n):
    return -0.57721566490153286 + np.array([np.sum(1 / np.arange(1, m)) for m in np.atleast_1d(n)])


def brute(x, y, k):
    x, y = (v / (v.std() or 1) for v in (x, y))
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    eps = np.sort(np.maximum(dx, dy), axis=1)[:, k]
    near = lambda d: np.where(eps > 0, (d < (eps * (1 - 1e-9))[:, None]).sum(axis=1), (d == 0).sum(axis=1))
    return max(0, digamma(len(x))[0] + digamma(k)[0] - np.mean(digamma(near(dx)) + digamma(near(dy))))


def test_nearest_distances():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (5, 4), (200, 3), (300, 7)):
        c, q = rng.integers(0, 40, (2, n)).astype(float), rng.normal(20, 15, (2, 50))
        d = np.sort(np.maximum(np.abs(q[0][:, None] - c[0]), np.abs(q[1][:, None] - c[1])), axis=1)
        np.testing.assert_array_equal(information.nearest_distances(*q, *c, k), np.hstack((d, np.full((50, k), np.inf)))[:, :k])


@pytest.mark.parametrize("tile", [512, 4])
def test_information_with_ties_outliers_and_dependence(spark, tile):
    rng = np.random.default_rng(3)
    n = 260
    y = np.where(rng.random(n) < 0.35, 0.0, rng.gamma(2, 50, n))  # a third of one value
    pdf = pd.DataFrame({
        "k": "a", "y": y, "noise": rng.normal(0, 1, n), "line": 3 * y + 1, "near": y + rng.normal(0, 5, n), "coarse": np.round(y / 60),
        "far": np.where(rng.random(n) < 0.03, 10.0 ** rng.integers(3, 6, n), rng.random(n)), "same": np.full(n, 2.0)})
    few = pd.DataFrame({"k": [None] * 5, **{c: [1.0, 2.0, 4.0, 8.0, 16.0] for c in pdf.columns[1:]}})
    tiny = pd.DataFrame({"k": "tiny", **{c: [1.0, 2.0, 3.0] for c in pdf.columns[1:]}})
    holes = pdf.head(4).assign(noise=np.nan)
    df = spark.createDataFrame(pd.concat([pdf, few, tiny, holes])).replace(float("nan"), None).repartition(4)
    features = [c for c in pdf.columns if c not in "ky"]
    got = {(r.k, r.feature): r.mi for r in information.mutual_information_knn(df, key=["k"], target="y", features=features, k=3, tile=tile).collect()}
    for f in features:
        assert got["a", f] == pytest.approx(brute(pdf[f].to_numpy(), y, 3), abs=1e-9), f
        assert got[None, f] == pytest.approx(brute(few[f].to_numpy(), few.y.to_numpy(), 3), abs=1e-9) and got["tiny", f] is None
