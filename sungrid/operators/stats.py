"""Profiles, correlations, histograms, lag and seasonal statistics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.measures import correlation
from ..functions.timecols import floor_ts
from ..session import cut_lineage
from .keys import match
from .blocks import BLOCK, block_arrays, running_parts, with_halo
from .ranks import average_rank, long_form, rank_bin, ranked_wide
from .selection import bin_counts, moments, quantiles_of


def profile(df: DataFrame, *, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Count, mean and standard deviation of each value per group."""
    aggs = []
    for v in values:
        aggs += [F.count(v).alias(f"{v}_n"), F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std")]
    return df.groupBy(*group).agg(*aggs)


def pivot_mean(df: DataFrame, *, group: Sequence[str], by: str, labels: Sequence[int], value: str, prefix: str) -> DataFrame:
    """Mean per group and label, one column per label. The labels are given, so
    Spark needs no extra pass to find them."""
    cells = [F.avg(F.when(F.col(by) == k, F.col(value))).alias(f"{prefix}{k}") for k in labels]
    return df.groupBy(*group).agg(*cells)


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def describe(df: DataFrame, *, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Count, mean, spread, extremes and quartiles of each column, in long form.
    A column without values keeps its row."""
    rows = long_form(df.select(*key, *cols), ids=key, cols=cols)
    by = [*key, "feature"]
    bins = bin_counts(rows, value="value", group=by)
    found = match(moments(bins, group=by), quantiles_of(rows, bins, value="value", group=by, probs=QUARTILES), by)
    every = bins.select(*key).distinct().select(*key, F.explode(F.array(*[F.lit(c) for c in cols])).alias("feature"))
    return match(every, found, by, "left").fillna(0, ["n"])


def missing_counts(df: DataFrame, *, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    wide = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return long_form(wide, ids=[*key, "n_rows"], cols=cols, value="n_missing")


def night_day_summary(df: DataFrame, *, key: Sequence[str], night: str, power: str) -> DataFrame:
    is_night = F.col(night) == 1
    n, n_night = F.count(F.lit(1)), F.sum(is_night.cast("long"))
    return df.groupBy(*key).agg(
        n.alias("n_rows"), n_night.alias("n_night"), (n - n_night).alias("n_day"),
        (n_night * 100.0 / n).alias("night_pct"),
        F.avg(F.when(is_night, F.col(power))).alias("night_mean"),
        F.avg(F.when(~is_night, F.col(power))).alias("day_mean"),
        F.max(F.when(is_night, F.col(power))).alias("night_max"))


def pair_correlations(df: DataFrame, *, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns over complete rows, in long
    form. All pairs of columns come from one aggregation."""
    pairs = list(combinations(cols, 2))
    complete = df.dropna(subset=list(cols))
    wide = complete.groupBy(*key).agg(*[correlation(F.col(a), F.col(b), complete=True).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r_{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return wide.select(*key, F.inline(F.array(*cells)))


def spearman_correlations(df: DataFrame, *, key: Sequence[str], ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Spearman: Pearson on average ranks, after dropping incomplete rows."""
    ranks = ranked_wide(df.dropna(subset=list(cols)), group=key, ids=ids, cols=cols, measure=average_rank())
    return pair_correlations(ranks, key=key, cols=cols)


def target_correlations(df: DataFrame, *, key: Sequence[str], target: str, features: Sequence[str], top: int | None = None) -> DataFrame:
    """Correlation with the target, ranked by size; one aggregation."""
    complete = df.dropna(subset=[target, *features])
    wide = complete.groupBy(*key).agg(*[correlation(F.col(f), F.col(target), complete=True).alias(f) for f in features])
    rows = long_form(wide, ids=key, cols=features, value="r")
    order = W.partitionBy(*key).orderBy(F.abs("r").desc_nulls_last(), "feature")  # one row per feature
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top) if top else ranked


def redundant_pairs(df: DataFrame, *, key: Sequence[str], cols: Sequence[str], above: float = 0.9) -> DataFrame:
    return pair_correlations(df, key=key, cols=cols).where(F.abs("r") > above)


def mutual_information(df: DataFrame, *, key: Sequence[str], ids: Sequence[str], target: str, features: Sequence[str], k: int = 8) -> DataFrame:
    """Mutual information (nats) of each feature with the target on k x k
    equal-count bins. Rows become at most k*k counts per feature on the map side."""
    cols = [target, *features]
    binned = ranked_wide(df.dropna(subset=cols), group=key, ids=ids, cols=cols, measure=rank_bin(k))
    rows = binned.unpivot([*key, target], list(features), "feature", "bin")
    cells = rows.groupBy(*key, "feature", "bin", target).agg(F.count(F.lit(1)).cast("double").alias("c"))
    by = [*key, "feature"]
    cells = cells.withColumns({  # over at most k*k cells per feature
        "n": F.sum("c").over(W.partitionBy(*by)),
        "cx": F.sum("c").over(W.partitionBy(*by, "bin")),
        "cy": F.sum("c").over(W.partitionBy(*by, target))})
    gain = F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))
    return cells.groupBy(*by).agg(F.sum(gain).alias("mi"))


def histogram(df: DataFrame, *, key: Sequence[str], value: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest value, empty bins
    included. A series with one distinct value has it in bin 0."""
    known = df.where(F.col(value).isNotNull()).select(*key, value)
    ends = cut_lineage(known.groupBy(*key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    at = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(0))
    placed = match(known, ends, key).select(*key, "_lo", "_hi", F.least(at, F.lit(bins - 1)).cast("long").alias("bin"), F.lit(1).alias("_one"))
    empty = ends.select(*key, "_lo", "_hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"), F.lit(0).alias("_one"))
    counts = placed.unionByName(empty).groupBy(*key, "bin").agg(F.sum("_one").alias("n"), F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi"))
    return counts.select(*key, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"), "n")


def boxplot(df: DataFrame, *, group: Sequence[str], value: str) -> DataFrame:
    """Quartiles, and whiskers at the extremes within 1.5 box lengths."""
    known = cut_lineage(df.where(F.col(value).isNotNull()).select(*group, value))  # read three times
    bins = bin_counts(known, value=value, group=group)
    boxes = cut_lineage(quantiles_of(known, bins, value=value, group=group, probs=QUARTILES))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    v, inside = F.col(value), F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    return match(known, boxes, group).groupBy(*group, *QUARTILES).agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.sum((~inside).cast("long")).alias("n_outliers"))


# Edges in W of the ranges in which errors are reported.
RANGE_EDGES = (0, 100, 500, 1000, 2000, 5000, 10000)


def rmse_by_range(df: DataFrame, *, y: str, pred: str, edges: Sequence[float] = RANGE_EDGES) -> DataFrame:
    """RMSE and count per range of the actual value; outside values go to the end
    ranges, and a range without rows has zeros."""
    last = len(edges) - 2
    err = F.pow(F.col(y) - F.col(pred), F.lit(2.0))
    place = F.lit(0)
    for i, edge in enumerate(edges[1:-1], start=1):
        place = F.when(F.col(y) >= edge, F.lit(i)).otherwise(place)
    sums = df.where(err.isNotNull()).groupBy(place.alias("range")).agg(F.sum(err).alias("_s"), F.count(F.lit(1)).alias("_n"))
    ranges = df.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("range"))
    lows = F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("range") + 1)
    highs = F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("range") + 2)
    return ranges.join(sums, "range", "left").select(
        F.col("range").cast("long").alias("range"), lows.alias("low"), highs.alias("high"),
        F.coalesce(F.sqrt(F.try_divide("_s", "_n")), F.lit(0.0)).alias("rmse"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def linear_fit(df: DataFrame, *, key: Sequence[str], x: str, y: str, x_above: float | None = None) -> DataFrame:
    """Slope, intercept and r2 of y on x per series, also over only x > ``x_above``."""
    xs = F.col(x) if x_above is None else F.when(F.col(x) > x_above, F.col(x))
    return df.groupBy(*key).agg(
        F.regr_count(F.col(y), xs).alias("n"), F.regr_slope(F.col(y), xs).alias("slope"),
        F.regr_intercept(F.col(y), xs).alias("intercept"), F.regr_r2(F.col(y), xs).alias("r2"))


def forecast_summary(df: DataFrame, *, key: Sequence[str], ts: str, power: str) -> DataFrame:
    p = F.col(power)
    return df.groupBy(*key).agg(
        (F.sum(p) / 1000.0).alias("total_kwh"), F.max(p).alias("peak_w"),
        # earliest time on a tie
        F.max_by(F.col(ts), F.when(p.isNotNull(), F.struct(p, -F.unix_micros(F.col(ts).cast("timestamp"))))).alias("peak_ts"),
        F.avg(p).alias("mean_w"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(p).alias("n"),
        (F.sum(p) * 0.8 / 1000.0).alias("low_kwh"), (F.sum(p) * 1.2 / 1000.0).alias("high_kwh"))


def variability(df: DataFrame, *, key: Sequence[str], ts: str, value: str) -> DataFrame:
    """Spread inside hours against spread of hourly means, per hour of day."""
    hours = df.groupBy(*key, floor_ts(F.col(ts), 3600).alias("_h")).agg(
        F.stddev_samp(value).alias("_s"), F.avg(value).alias("_m"))
    return hours.groupBy(*key, F.hour("_h").cast("long").alias("hour")).agg(
        F.avg("_s").alias("within_hour_std"), F.stddev_samp("_m").alias("across_days_std"))


def daily_lags(df: DataFrame, *, key: Sequence[str], ts: str, driver: str, power: str, max_lag: int,
               min_rows: int = 12, min_peak: float = 100.0) -> DataFrame:
    """Per day: the lag (in rows) of power behind its driver with the largest
    product sum of the two min-max scaled curves; the smallest lag on a tie.

    A day of a regular grid is a small group, and the lags are window columns of
    it, so one shuffle by day serves all of them.
    """
    day = F.to_date(F.col(ts))
    rows = df.where(F.col(driver).isNotNull() & F.col(power).isNotNull()).select(*key, ts, day.alias("day"), driver, power)
    whole = W.partitionBy(*key, "day")

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(whole), F.max(c).over(whole)
        return (F.col(c) - low) / (high - low + 1e-10)

    rows = rows.withColumns({"_r": scaled(driver), "_p": scaled(power), "_n": F.count(F.lit(1)).over(whole), "_peak": F.max(power).over(whole)})
    rows = rows.where((F.col("_n") >= min_rows) & (F.col("_peak") >= min_peak))
    along = whole.orderBy(ts)
    lags = list(range(-max_lag, max_lag + 1))
    shifted = rows.withColumns({f"_x{i}": F.col("_p") * F.lag("_r", lag).over(along) for i, lag in enumerate(lags)})
    sums = shifted.groupBy(*key, "day").agg(*[F.sum(f"_x{i}").alias(f"_x{i}") for i in range(len(lags))])
    best = F.array_max(F.array(*[F.struct(F.col(f"_x{i}").alias("score"), F.lit(-lag).alias("neg")) for i, lag in enumerate(lags)]))
    return sums.withColumn("_b", best).select(*key, "day", (-F.col("_b.neg")).cast("long").alias("lag"), F.col("_b.score").alias("score"))


def typical_lag(days: DataFrame, *, key: Sequence[str], step_minutes: int) -> DataFrame:
    """Median daily lag and mean score. Lags are few distinct numbers, so the
    exact percentile keeps a short table."""
    median = F.percentile("lag", 0.5)
    return days.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_days"), median.alias("median_lag"),
        (median * step_minutes).alias("lag_minutes"), F.avg("score").alias("mean_score"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _lag_sums(dev: pd.Series, own: pd.Series, lags: pd.Series) -> pd.Series:
    """Per block the sums of x[i] * x[i - k] over its own rows, for k from 0 on."""
    def sums(x: np.ndarray, mine: np.ndarray, most: int) -> np.ndarray:
        x = np.nan_to_num(np.asarray(x, float))  # missing products count nothing
        here = np.flatnonzero(np.asarray(mine, bool))
        lo, hi = here[0], here[-1] + 1
        # Slices of one array: from each lag's start in it, as far as it has rows.
        return np.array([x[max(lo, k):hi] @ x[max(lo, k) - k:hi - k] if k < hi else 0.0 for k in range(most + 1)])
    return pd.Series([sums(x, m, k) for x, m, k in zip(dev, own, lags, strict=True)])


def autocorrelation(df: DataFrame, *, key: Sequence[str], index: str, value: str, lags: int = 50, rows: int = 4096) -> DataFrame:
    """Biased autocorrelation at lags 1 to ``lags`` of a regular series.

    A block and the ``lags`` rows before it are one array, and the products of a
    lag are a slice of it; a block gives one array of sums. Lags are rows of the
    result, so a thousand of them are the same plan.
    """
    means = cut_lineage(df.groupBy(*key).agg(F.avg(value).alias("_mean")))
    dev = match(df, means, key).select(*key, index, (F.col(value) - F.col("_mean")).alias("_dev"))
    blocks = block_arrays(dev, key=key, index=index, cols=["_dev"], before=lags, rows=rows)
    # A block that holds border rows alone belongs to no row.
    blocks = blocks.where(F.exists("rows", lambda r: r["own"]))
    cell = lambda f: F.transform("rows", lambda r: r[f])
    sums = blocks.select(*key, F.posexplode(_lag_sums(cell("_dev"), cell("own"), F.lit(lags))).alias("lag", "_s"))
    sums = sums.groupBy(*key, "lag").agg(F.sum("_s").alias("_s"))
    square = F.max(F.when(F.col("lag") == 0, F.col("_s"))).over(W.partitionBy(*key))  # over the lags of a series
    return sums.withColumn("acf", F.try_divide("_s", square)).where("lag > 0").select(*key, F.col("lag").cast("long").alias("lag"), "acf")


def seasonal_decompose(df: DataFrame, *, key: Sequence[str], index: str, ts: str, value: str, period: int, rows: int = 4096) -> DataFrame:
    """Additive trend, seasonal and residual parts of a regular series.

    The trend is the centred moving average over one period (an even period uses
    half weights at both ends) and NULL where the window is not full.
    """
    half, odd = period // 2, period % 2
    n = period if odd else period - 1  # an even period: its inner rows, and half of both ends
    copied = with_halo(df.select(*key, index, ts, value), index=index, before=half, after=half, rows=rows)
    v = F.col(value).cast("double")
    both = running_parts(copied, key=key, index=index, n=n, parts={"n": F.count(v), "s": F.sum(v)})
    along = W.partitionBy(*key, BLOCK).orderBy(index)
    total = F.coalesce("_tail.s", F.lit(0.0)) + F.coalesce("_head.s", F.lit(0.0))
    whole = F.when(F.col("_head.n") + F.coalesce("_tail.n", F.lit(0)) == n, total)  # of the n rows that end here
    centred = F.lead(whole, n // 2).over(along)
    mean = centred if odd else centred + (F.lag(v, half).over(along) + F.lead(v, half).over(along)) / 2
    rows_ = both.withColumn("trend", mean / period).where("_own").drop(BLOCK, "_own", "_head", "_tail")
    rows_ = cut_lineage(rows_.withColumn("_phase", F.pmod(F.col(index), F.lit(period))))  # read twice below
    phases = rows_.groupBy(*key, "_phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_p"))
    centred = F.col("_p") - F.avg("_p").over(W.partitionBy(*key))  # one row per phase
    seasonal = phases.select(*key, "_phase", centred.alias("seasonal"))
    return match(rows_, cut_lineage(seasonal), [*key, "_phase"]).select(
        *key, ts, value, "trend", "seasonal", (F.col(value) - F.col("trend") - F.col("seasonal")).alias("residual"))
