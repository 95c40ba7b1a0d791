"""Boosted trees against the same method in plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sungrid.operators import boosting

UNIT = boosting.UNIT


def plain(x, y, rounds, depth, bins, rate, penalty, least):
    """Predictions of the rows themselves."""
    low, high = x.min(axis=0), x.max(axis=0)
    span = np.where(high > low, high - low, 1)
    codes = np.where(high > low, np.clip(np.floor((x - low) / span * bins), 0, bins - 1), 0).astype(int)
    f = np.full(len(y), round(y.mean(), 6))
    score = lambda g, n: g * g / (n + penalty)
    for _ in range(rounds):
        g = np.floor(np.abs(y - f) * UNIT + 0.5) * np.sign(y - f)
        node = np.zeros(len(y), int)
        for _ in range(depth):
            step = np.zeros(len(y), int)
            for at in np.unique(node):
                mine, best = node == at, None
                total, n = g[mine].sum() / UNIT, mine.sum()
                for j in range(x.shape[1]):
                    for b in range(bins - 1):
                        left = mine & (codes[:, j] <= b)
                        nl = left.sum()
                        if nl >= least and n - nl >= least:
                            gl = g[left].sum() / UNIT
                            gain = score(gl, nl) + score(total - gl, n - nl) - score(total, n)
                            if gain > 0 and (best is None or gain > best[0] + 1e-12 * abs(gain)):
                                best = (gain, j, b)
                if best:
                    step[mine] = codes[mine, best[1]] > best[2]
            node = node * 2 + step
        for at in np.unique(node):
            mine = node == at
            f[mine] += rate * (g[mine].sum() / UNIT) / (mine.sum() + penalty)
    return f


@pytest.mark.parametrize("depth, bins, least", [(1, 4, 1), (2, 8, 3), (3, 16, 5)])
def test_trees_of_series(spark, depth, bins, least):
    rng = np.random.default_rng(depth)
    rows, want = [], {}
    for k, n in (("a", 180), (None, 40), ("one", 1)):
        x = np.stack((rng.random(n), rng.integers(0, 3, n).astype(float), np.full(n, 2.0)), axis=1)
        y = np.round(3 * (x[:, 0] > 0.4) + x[:, 1] + rng.normal(0, 0.2, n), 3)
        want[k] = plain(x, y, 3, depth, bins, 0.3, 1.0, least)
        rows += [(k, i, v, w) for i, (v, w) in enumerate(zip(x.tolist(), y.tolist()))]
    schema = "k string, i int, x array<double>, y double"
    df = spark.createDataFrame(rows, schema).repartition(4)
    odd = spark.createDataFrame([("a", 900, [1.0, None, 2.0], 1.0), ("a", 901, None, 1.0), ("new", 902, [0.0, 0.0, 0.0], None)], schema)
    models = boosting.fit(df.union(odd.where("k = 'a'")), key=["k"], x="x", y="y", width=3, rounds=3, depth=depth, bins=bins, least=least)
    got = boosting.predict(df.union(odd), models, key=["k"], x="x", name="p", depth=depth, bins=bins).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        if r.i >= 900:
            assert r.p is None
        else:
            assert r.p == pytest.approx(want[r.k][r.i], abs=1e-9)
    loss = {k: np.mean([(r.y - r.p) ** 2 for r in got if r.k == k and r.i < 900]) for k in ("a", None)}
    spread = {k: np.var([r.y for r in got if r.k == k and r.i < 900]) for k in loss}
    assert all(loss[k] < spread[k] for k in loss)


def test_values_beyond_the_ends_take_the_end_bins(spark):
    df = spark.createDataFrame([("a", [float(i)], float(i > 4)) for i in range(10)], "k string, x array<double>, y double")
    models = boosting.fit(df, key=["k"], x="x", y="y", width=1, rounds=4, depth=1, bins=5, least=1)
    out = spark.createDataFrame([("a", [-100.0]), ("a", [0.0]), ("a", [9.0]), ("a", [1e300])], "k string, x array<double>")
    p = [r.p for r in boosting.predict(out, models, key=["k"], x="x", name="p", depth=1, bins=5).orderBy(F.col("x")[0]).collect()]
    assert p[0] == p[1] < p[2] == p[3]
    assert boosting.fit(df.limit(0), key=["k"], x="x", y="y", width=1, rounds=1, depth=1).count() == 0
