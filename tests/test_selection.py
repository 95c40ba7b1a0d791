"""Quantiles by counting, against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sungrid.operators import selection, stats

PROBS = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.93, "f": 1.0}


def tables():
    rng = np.random.default_rng(5)
    yield "ties", np.where(rng.random(900) < 0.35, 0.0, np.round(rng.lognormal(1, 2, 900), 1))
    yield "signs", np.concatenate((rng.normal(0, 1, 400), -np.exp(rng.uniform(-600, 600, 300)), np.exp(rng.uniform(-600, 600, 300)), [0.0, -0.0, 5e-324, 1.7e308, -1.7e308]))
    yield "close", 1e6 + np.arange(700) * 2.0**-33
    yield "single", np.array([3.5])
    yield "pair", np.array([-1.0, 2.0])
    yield "same", np.full(500, -7.25)


@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_quantiles_of_any_scale(spark, most):
    made = dict(tables())
    pdf = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in made.items()])
    df = spark.createDataFrame(pdf).repartition(5)
    df = df.union(spark.createDataFrame([("ties", None), ("none", None), (None, 4.0), (None, 8.0)], df.schema))
    got = {r.g: r for r in selection.quantiles(df, value="v", group=["g"], probs=PROBS, most=most).collect()}
    assert set(got) == {*made, None} and [got[None][p] for p in "adf"] == [4.0, 6.0, 8.0]
    for g, v in made.items():
        np.testing.assert_allclose([got[g][p] for p in PROBS], np.quantile(v, list(PROBS.values())), rtol=1e-12)


def test_values_that_are_not_finite_come_last_and_first(spark):
    rows = [(float(v),) for v in ("-inf", 1, 2, 3, "inf", "nan", "nan")]
    got = selection.quantiles(spark.createDataFrame(rows, "v double"), value="v", group=[], probs={"a": 0.0, "b": 0.5, "c": 4 / 6, "d": 1.0}).first()
    assert got.a == float("-inf") and got.b == 3.0 and got.c == float("inf") and np.isnan(got.d)
    assert selection.quantiles(spark.createDataFrame([], "k long, v double"), value="v", group=["k"], probs={"a": 0.5}).count() == 0


def test_describe_puts_moments_together(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 600), "x": 1e9 + rng.random(600), "y": np.where(rng.random(600) < 0.3, np.nan, rng.normal(0, 1e-3, 600))})
    df = spark.createDataFrame(pdf).select("k", "x", F.nanvl("y", F.lit(None).cast("double")).alias("y"), F.lit(None).cast("double").alias("z"))
    got = stats.describe(df, key=["k"], cols=["x", "y", "z"]).toPandas().set_index(["k", "feature"])
    for k, part in pdf.groupby("k"):
        for c in "xy":
            want = part[c].describe()
            np.testing.assert_allclose(got.loc[(k, c), ["n", "mean", "std", "min", "q25", "median", "q75", "max"]].astype(float), want[["count", "mean", "std", "min", "25%", "50%", "75%", "max"]], rtol=1e-6)
        assert got.loc[(k, "z"), "n"] == 0 and np.isnan(got.loc[(k, "z"), "mean"])
