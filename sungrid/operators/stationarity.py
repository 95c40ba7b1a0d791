"""Partial autocorrelation, and a test of a series for a unit root."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut_lineage
from .blocks import block_arrays
from .keys import match
from .stats import autocorrelation

# Fixed values, published by MacKinnon (1994, 2010) for a test with a constant: the
# distribution of the statistic as polynomials in it below and above BEND, and
# critical values as polynomials in 1 / (rows used).
_LOWEST, BEND, _HIGHEST = -18.83, -1.61, 2.74
_BELOW = (2.1659, 1.4412, 0.038269)
_ABOVE = (1.7339, 0.93202, -0.12745, -0.010368)
CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _partial(acf: pd.Series) -> pd.Series:
    """Partial autocorrelations from those at lags 1, 2, ...: the last weight of the
    best prediction from k rows, each from that of k - 1 (Durbin's recursion)."""
    def recursion(r: np.ndarray) -> list[float]:
        out, weights, left = [], np.zeros(0), 1.0
        for k, x in enumerate(r):
            last = (x - weights @ r[:k][::-1]) / left if left > 0 else math.nan
            weights = np.append(weights - last * weights[::-1], last)
            left *= 1 - last * last
            out.append(last)
        return out
    return pd.Series([recursion(np.asarray(r, float)) for r in acf])


def partial_autocorrelation(df: DataFrame, *, key: Sequence[str], index: str, value: str, lags: int = 50, rows: int = 4096) -> DataFrame:
    """Partial autocorrelation at lags 1 to ``lags`` of a regular series, from the
    biased autocorrelation. A constant series has none: NULL."""
    acf = autocorrelation(df, key=key, index=index, value=value, lags=lags, rows=rows)
    cells = F.sort_array(F.collect_list(F.struct("lag", F.coalesce("acf", F.lit(math.nan)).alias("r"))))  # ``lags`` numbers a series
    found = acf.groupBy(*key).agg(cells.alias("_c"))
    found = found.select(*key, F.posexplode(_partial(F.transform("_c", lambda c: c["r"]))).alias("_k", "_p"))
    return found.select(*key, (F.col("_k") + 1).cast("long").alias("lag"), F.when(~F.isnan("_p"), F.col("_p")).alias("pacf"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _moments(dev: pd.Series, index: pd.Series, own: pd.Series, lag: pd.Series, begin: pd.Series) -> pd.Series:
    """Sums of products of 1, the level before, the ``lag`` changes before and the
    change of each own row from number ``begin`` on, as a flat square matrix."""
    def sums(x: np.ndarray, at: np.ndarray, mine: np.ndarray, p: int, begin: int) -> np.ndarray:
        x = np.asarray(x, float)
        here = np.flatnonzero(np.asarray(mine, bool) & (np.asarray(at) >= begin))
        change = np.diff(x, prepend=math.nan)
        parts = [np.ones(len(here)), x[here - 1], *[change[here - k] for k in range(1, p + 1)], change[here]]
        m = np.column_stack(parts)
        m = m[~np.isnan(m).any(axis=1)]
        return (m.T @ m).ravel()
    return pd.Series([sums(*r) for r in zip(dev, index, own, lag, begin, strict=True)])


def _solve(m: np.ndarray) -> tuple[float, float, float] | None:
    """From a matrix of moments whose last column is the one explained: the weight
    of the second, its standard error, and the sum of squared residuals."""
    a, b = m[:-1, :-1], m[:-1, -1]
    n, k = m[0, 0], len(a)
    if n <= k or np.linalg.matrix_rank(a, hermitian=True) < k:
        return None
    w = np.linalg.solve(a, b)
    rss = m[-1, -1] - b @ w
    return None if rss <= 1e-12 * m[-1, -1] else (w[1], math.sqrt(rss / (n - k) * np.linalg.inv(a)[1, 1]), rss)


@F.pandas_udf(T.LongType())
def _best_lag(sums: pd.Series) -> pd.Series:
    """The number of changes with the least information criterion (Akaike), the
    smaller of equals; the fits of all numbers are parts of one matrix."""
    def best(flat: np.ndarray) -> int | None:
        size = math.isqrt(len(flat))
        m, found = np.asarray(flat).reshape(size, size), []
        for p in range(size - 2):
            at = [*range(p + 2), size - 1]
            got = _solve(m[np.ix_(at, at)])
            if got:
                found.append((m[0, 0] * math.log(got[2] / m[0, 0]) + 2 * (p + 2), p))
        return min(found)[1] if found else None
    return pd.Series([best(s) for s in sums], dtype="Int64")


@F.pandas_udf(T.StructType().add("statistic", T.DoubleType()).add("p_value", T.DoubleType()).add("n_used", T.LongType()))
def _statistic(sums: pd.Series) -> pd.DataFrame:
    def row(flat: np.ndarray) -> tuple[float | None, float | None, int]:
        size = math.isqrt(len(flat))
        m = np.asarray(flat).reshape(size, size)
        got = _solve(m)
        if not got:
            return None, None, int(m[0, 0])
        t = got[0] / got[1]
        z = sum(c * t**i for i, c in enumerate(_BELOW if t <= BEND else _ABOVE))
        p = 0.0 if t < _LOWEST else 1.0 if t > _HIGHEST else 0.5 * math.erfc(-z / math.sqrt(2))
        return t, p, int(m[0, 0])
    return pd.DataFrame([row(s) for s in sums], columns=["statistic", "p_value", "n_used"])


def unit_root_test(df: DataFrame, *, key: Sequence[str], index: str, value: str, lags: int | None = None, rows: int = 65_536) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant: per series statistic, p_value,
    lags, n_used and the critical values at 1, 5 and 10 %.

    ``index`` numbers the rows of a series from 0. The change of a row is explained
    by the level and the ``lags`` changes before it. Without ``lags`` each series
    has its own number, from 0 to 12 (n / 100)^(1/4), by Akaike's criterion on the
    rows that all numbers can use, and is then fitted on all rows it can use.

    Rows that see a missing value are left out. A series that is constant, too short
    or explained without residual has no statistic, and no lags if they were to be chosen.

    A block gives one matrix of sums, so a series costs one pass for the choice and
    one for the fit, and matrices of a size that does not grow with the rows of a block.
    """
    series = df.groupBy(*key).agg(F.avg(value).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    if lags is None:
        most = F.greatest(F.lit(0), F.least(F.ceil(12 * F.pow(F.col("_n") / 100, F.lit(0.25))), F.floor(F.col("_n") / 2) - 3)).cast("long")
    else:
        most = F.lit(lags).cast("long")
    series = cut_lineage(series.withColumn("_most", most))  # one row a series
    reach = (series.agg(F.max("_most").alias("m")).first()["m"] or 0) + 1
    dev = match(df, series.select(*key, "_mean"), key).select(*key, index, (F.col(value) - F.col("_mean")).alias("_dev"))
    blocks = block_arrays(dev, key=key, index=index, cols=["_dev"], before=reach, rows=rows)
    blocks = cut_lineage(blocks.where(F.exists("rows", lambda r: r["own"])))
    cell = lambda f: F.transform("rows", lambda r: r[f])

    def sums(number: DataFrame) -> DataFrame:
        """Per series the matrix for its number of changes, ``_p``, on all rows it can use."""
        met = match(blocks, number, key)
        cells = met.select(*key, F.posexplode(_moments(cell("_dev"), cell("index"), cell("own"), F.col("_p"), F.col("_p") + 1)).alias("_i", "_s"))
        cells = cells.groupBy(*key, "_i").agg(F.sum("_s").alias("_s"))
        whole = F.sort_array(F.collect_list(F.struct("_i", "_s")))  # (_p + 3)^2 numbers
        return cells.groupBy(*key).agg(whole.alias("_c")).select(*key, F.transform("_c", lambda c: c["_s"]).alias("_sums"))

    number = series.select(*key, F.col("_most").alias("_p"))
    if lags is None:
        number = cut_lineage(sums(number).select(*key, _best_lag("_sums").alias("_p")))
    chosen = number.where(F.col("_p").isNotNull())
    tested = match(sums(chosen), chosen, key).select(*key, "_p", _statistic("_sums").alias("_t"))
    out = match(series.select(*key), cut_lineage(tested), key, "left").select(*key, "_t.statistic", "_t.p_value", F.col("_p").alias("lags"), "_t.n_used")
    # Critical values are polynomials in 1 / n.
    values = {c: sum((F.lit(x) * F.pow(F.lit(1.0) / F.col("n_used"), F.lit(float(i))) for i, x in enumerate(xs)), F.lit(0.0)) for c, xs in CRITICAL.items()}
    return out.withColumns({c: F.when(F.col("statistic").isNotNull(), x) for c, x in values.items()})
