"""Least squares by merged factors, and successive halving, against plain versions."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sungrid.operators import model


def exact(x, y):
    """Least squares in rational numbers."""
    rows = [[Fraction(1), *map(Fraction, r)] for r in x.tolist()]
    p = len(rows[0])
    a = [[sum(r[i] * r[j] for r in rows) for j in range(p)] + [sum(r[i] * Fraction(t) for r, t in zip(rows, y.tolist(), strict=True))] for i in range(p)]
    for i in range(p):
        pivot = next(j for j in range(i, p) if a[j][i])
        a[i], a[pivot] = a[pivot], a[i]
        a[i] = [v / a[i][i] for v in a[i]]
        for j in range(p):
            if j != i:
                a[j] = [v - a[j][i] * w for v, w in zip(a[j], a[i], strict=True)]
    return [float(r[-1]) for r in a]


def test_factors_keep_digits(spark):
    """A pressure in Pa that hardly varies, its square nearly, and a flag."""
    rng = np.random.default_rng(2)
    parts, want = [], {}
    for k, n in (("a", 300), (None, 60)):
        pa_ = 101_325 + rng.random(n)
        x = np.stack((pa_, pa_ * 1e3 + rng.random(n), rng.integers(0, 2, n).astype(float)), axis=1)
        y = x @ [2.0, -0.5, 3.0] + 1e3 + rng.normal(0, 1e-3, n)
        parts.append(pd.DataFrame({"k": k, "p": x[:, 0], "q": x[:, 1], "f": x[:, 2], "y": y}))
        want[k] = exact(x, y)
    df = spark.createDataFrame(pd.concat(parts)).repartition(7)
    df = df.union(spark.createDataFrame([("a", None, 1.0, 1.0, 5.0)], df.schema))
    got = {r.k: r for r in model.fit_linear_qr(df, key=["k"], features=["p", "q", "f"], y="y").collect()}
    for k, w in want.items():
        assert got[k].n == len(parts[0 if k else 1])
        np.testing.assert_allclose(got[k].weights[1:], w[1:], rtol=1e-5)  # the condition is about 1e10
    plain = {r.k: r for r in model.fit_linear_by_series(df, key=["k"], features=["p", "q", "f"], y="y").collect()}
    assert abs(got["a"].weights[2] - want["a"][2]) <= abs(plain["a"].weights[2] - want["a"][2])


def test_factors_of_columns_that_others_determine(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i, 7.0, 3.0 * i + 1) for i in range(20)] + [("one", 1.0, 2.0, 7.0, 5.0)], "k string, x double, z double, c double, y double")
    got = {r.k: r.weights for r in model.fit_linear_qr(df, key=["k"], features=["x", "z", "c"], y="y").collect()}
    for k, x, y in (("a", 11.0, 34.0), ("one", 1.0, 5.0)):
        w = got[k]
        assert w[0] + w[1] * x + w[2] * 2 * x + w[3] * 7 == pytest.approx(y)
    assert model.fit_linear_qr(df.limit(0), key=["k"], features=["x"], y="y").count() == 0


def test_halving_follows_the_full_search(spark):
    rng = np.random.default_rng(5)
    n = 240
    pdf = pd.concat([pd.DataFrame({"k": k, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "h"), "x": rng.normal(0, s, n)}) for k, s in (("a", 1.0), ("b", 30.0))])
    pdf["y"] = 2 * pdf.x + rng.normal(0, 3, 2 * n)
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    how = dict(key=["k"], ts="ts", features=["x"], y="y", penalties=[0.0, 1.0, 5.0, 50.0, 500.0])
    full = {(r.k, r.penalty): r for r in model.ridge_search(df, k=6, **how).collect()}
    got = model.ridge_halving(df, k=6, **how).collect()
    assert len(got) == 10 and {r.rung for r in got} == {0, 1, 2, 3}
    by_rung = {0: 1, 1: 2, 2: 4, 3: 6}
    for r in got:
        assert r.n_folds == by_rung[r.rung]
        if r.rung == 3:
            assert r.mean_loss == pytest.approx(full[r.k, r.penalty].mean_loss)
    for k in "ab":
        assert [sum(r.k == k and r.rung == i for r in got) for i in range(4)] == [2, 1, 1, 1]
