"""Regression baselines, lag-window regressors and their selection."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.clean import clip, zero_without_radiation
from ..session import cut_lineage
from .keys import match
from .blocks import DAY, row_index
from .stats import linear_fit


def predict_line(df: DataFrame, coefficients: DataFrame, *, key: Sequence[str], x: str, name: str) -> DataFrame:
    """Add ``intercept + slope * x`` with the coefficients of the row's series; NULL
    where the series has none."""
    lines = cut_lineage(coefficients.select(*key, "slope", "intercept"))
    return match(df, lines, key, "left").withColumn(name, F.col("intercept") + F.col("slope") * F.col(x)).drop("slope", "intercept")


def linear_baseline(df: DataFrame, *, key: Sequence[str], x: str, y: str, ghi: str, split: str = "split",
                    dark_below: float = 1.0) -> DataFrame:
    """Fit y on x over the train rows; predict the test rows, never below zero and
    zero without radiation."""
    fit = linear_fit(df.where(F.col(split) == "train"), key=key, x=x, y=y)
    out = predict_line(df.where(F.col(split) == "test"), fit, key=key, x=x, name="_raw")
    return out.withColumn("y_pred", zero_without_radiation(clip(F.col("_raw"), low=0.0), F.col(ghi), dark_below)).drop("_raw")


def fit_linear(train: DataFrame, *, features: Sequence[str], y: str) -> PipelineModel:
    """Least squares on several features in one distributed pass."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_x"),
        LinearRegression(featuresCol="_x", labelCol=y, predictionCol="y_pred", solver="normal"),
    ]).fit(train)


def fit_linear_qr(train: DataFrame, *, key: Sequence[str], features: Sequence[str], y: str) -> DataFrame:
    """Least squares per series as ``fit_linear_by_series``, without normal equations.

    A task turns its rows of a series into one triangular factor, batch by batch;
    factors of tasks are stacked and made triangular again. Sums of products
    would square the condition number: with a pressure in Pa beside flags they
    lose the digits that the factors keep. Rows with a missing value are left
    out. A feature that does not vary, or that others determine, takes the
    smallest weights.
    """
    key, width = list(key), len(features) + 2
    known = train.dropna(subset=[*features, y]).select(F.struct(*key).alias("_key"), F.array(*[F.col(c).cast("double") for c in [*features, y]]).alias("_row"))
    kind = known.schema["_key"].dataType.simpleString()

    def triangle(stacked: np.ndarray) -> np.ndarray:
        out = np.zeros((width, width))
        r = np.linalg.qr(stacked, mode="r")
        out[:len(r)] = r
        return out

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([
                pa.array([dict(k) for k in held], kind), pa.array([n for _, n in held.values()], pa.int64()),
                pa.array([r.ravel() for r, _ in held.values()], pa.list_(pa.float64()))], names=["_key", "n", "_r"])
            held.clear()
            return out

        for batch in batches:
            kind = batch.schema.field(0).type
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width - 1)
            rows = np.hstack((np.ones((len(rows), 1)), rows))
            codes = batch.column(0).to_pylist()
            at: dict = {}
            for i, k in enumerate(codes):
                at.setdefault(tuple(k.items()), []).append(i)
            for k, mine in at.items():
                r, n = held.get(k, (np.zeros((0, width)), 0))
                held[k] = triangle(np.vstack((r, rows[mine]))), n + len(mine)
            if len(held) > 10_000:
                yield flush(kind)
        if held:
            yield flush(kind)

    def merge(t: pa.Table) -> pa.Table:
        stacked = np.vstack([np.asarray(r, float).reshape(width, width) for r in t.column("_r").to_pylist()])
        return pa.table({"_key": t.column("_key").combine_chunks()[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()),
                         "_r": pa.array([triangle(stacked).ravel()], pa.list_(pa.float64()))})

    def solve(t: pa.Table) -> pa.Table:
        r = np.asarray(merge(t).column("_r").to_pylist()[0]).reshape(width, width)
        # Columns of one size let small singular values be told from rounding.
        size = np.sqrt((r[:, :-1] ** 2).sum(axis=0))
        size[size == 0] = 1
        w = np.linalg.lstsq(r[:, :-1] / size, r[:, -1], rcond=1e-13)[0] / size
        return pa.table({"_key": t.column("_key").combine_chunks()[:1], "weights": pa.array([w], pa.list_(pa.float64())), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64())})

    made = f"_key {kind}, n bigint, _r array<double>"
    partial = known.mapInArrow(factors, made).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    merged = partial.groupBy("_key", "_salt").applyInArrow(merge, made)  # a tree: by groups of tasks, then all
    return merged.groupBy("_key").applyInArrow(solve, f"_key {kind}, weights array<double>, n bigint").select("_key.*", "weights", "n")


def fit_linear_by_series(train: DataFrame, *, key: Sequence[str], features: Sequence[str], y: str) -> DataFrame:
    """Least squares on several features for each series: key, ``weights`` (the
    intercept, then a weight per feature), ``n``.

    Covariances merge exactly, so one aggregate serves all series; a row per
    series is then solved. Rows with a missing value are left out. A feature that
    does not vary, or that others determine, takes the smallest weights.
    """
    names = [*features, y]
    known = train.dropna(subset=names)
    terms = [F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in combinations_with_replacement(names, 2)]
    sums = known.groupBy(*key).agg(F.array(*terms).alias("_cov"), F.array(*[F.avg(c) for c in names]).alias("_mean"), F.count(F.lit(1)).alias("n"))
    p = len(features)

    @F.pandas_udf("array<double>")
    def solve(cov: pd.Series, mean: pd.Series) -> pd.Series:
        out = []
        for c, m in zip(cov, mean):
            square = np.zeros((p + 1, p + 1))
            square[np.triu_indices(p + 1)] = np.asarray(c, float)
            square = square + np.triu(square, 1).T
            beta = np.linalg.lstsq(square[:p, :p], square[:p, p], rcond=None)[0]
            out.append(np.concatenate([[m[p] - beta @ np.asarray(m[:p], float)], beta]))
        return pd.Series(out)

    return sums.select(*key, solve("_cov", "_mean").alias("weights"), "n")


def predict_linear(df: DataFrame, fitted: DataFrame, *, key: Sequence[str], features: Sequence[str], name: str) -> DataFrame:
    """Add the prediction of the row's series; NULL where the series has no fit."""
    lines = cut_lineage(fitted.select(*key, F.col("weights").alias("_w")))
    value = F.col("_w")[0]
    for i, c in enumerate(features, start=1):
        value = value + F.col("_w")[i] * F.col(c)
    return match(df, lines, key, "left").withColumn(name, value).drop("_w")


def ensemble_mean(preds: DataFrame, *, key: Sequence[str], pred: str = "y_pred") -> DataFrame:
    """Mean prediction of all models per row, and how many gave one."""
    return preds.groupBy(*key).agg(F.avg(pred).alias(pred), F.count(pred).alias("n_models"))


def _ridge_losses(names: Sequence[str], terms: Sequence[tuple[str, str]]):
    """Losses of ridge fits from sums of products; one row is one fold and penalty."""
    at = {t: i for i, t in enumerate(terms)}
    p = len(names)

    def square(values: np.ndarray) -> np.ndarray:
        m = np.empty((p, p))
        for (a, b), i in at.items():
            ia, ib = names.index(a), names.index(b)
            m[ia, ib] = m[ib, ia] = values[i]
        return m

    @F.pandas_udf("double")
    def loss(train: pd.Series, val: pd.Series, penalty: pd.Series) -> pd.Series:
        out = []
        for t, v, lam in zip(train, val, penalty):
            mt, mv = square(np.asarray(t, float)), square(np.asarray(v, float))
            n = mt[0, 0]
            means = mt[0] / n
            cov = mt / n - np.outer(means, means)  # names[0] is the constant, the last is y
            xx, xy = cov[1:-1, 1:-1], cov[1:-1, -1]
            beta = np.linalg.lstsq(xx + lam * np.eye(p - 2), xy, rcond=None)[0]
            weights = np.concatenate([[means[-1] - beta @ means[1:-1]], beta, [-1.0]])
            out.append(float(weights @ mv @ weights / mv[0, 0]))
        return pd.Series(out)

    return loss


def _fold_sums(df: DataFrame, key: Sequence[str], ts: str, features: Sequence[str], y: str, k: int, block_s: int) -> tuple[DataFrame, Column]:
    """Per series and fold (``_piece``, from 1) the sums of products of its training
    rows and of its validation rows, and the loss of a ``penalty`` from them.

    The folds cut a series into k+1 pieces. Sums of products per piece are all
    that any fold or penalty needs, so one pass over the data serves a whole
    search: fold i trains on the sums of the pieces before it. Columns are first
    centred per series, so that sums of large numbers do not cancel.
    """
    names = ["_one", *features, y]
    terms = list(combinations_with_replacement(names, 2))
    known = df.dropna(subset=[*features, y]).select(*key, ts, *features, y)
    means = cut_lineage(known.groupBy(*key).agg(*[F.avg(c).alias(f"_mean_{c}") for c in [*features, y]]))
    known = match(known, means, key).select(*key, ts, *[(F.col(c) - F.col(f"_mean_{c}")).alias(c) for c in [*features, y]])
    rows = row_index(known, key=key, ts=ts, block_s=block_s, total="_n").withColumn("_one", F.lit(1.0))
    size = F.floor(F.col("_n") / F.lit(k + 1))
    back = F.col("_n") - 1 - F.col("rn")
    piece = F.greatest(F.lit(k) - F.floor(F.try_divide(back, size)), F.lit(0)).alias("_piece")
    sums = rows.groupBy(*key, piece).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"_m{i}") for i, (a, b) in enumerate(terms)])
    past = W.partitionBy(*key).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)  # k+1 rows
    folds = sums.select(
        *key, "_piece",
        F.array(*[F.col(f"_m{i}") for i in range(len(terms))]).alias("_val"),
        F.array(*[F.sum(f"_m{i}").over(past) for i in range(len(terms))]).alias("_train"),
    ).where("_piece > 0")
    return folds, _ridge_losses(names, terms)("_train", "_val", "penalty")


def _penalties(penalties: Sequence[float]) -> Column:
    return F.explode(F.array(*[F.lit(float(x)) for x in penalties]))


def ridge_search(df: DataFrame, *, key: Sequence[str], ts: str, features: Sequence[str], y: str,
                 penalties: Sequence[float], k: int = 5, block_s: int = DAY) -> DataFrame:
    """Mean validation loss of each penalty over expanding-window folds."""
    folds, loss = _fold_sums(df, key, ts, features, y, k, block_s)
    losses = folds.withColumn("penalty", _penalties(penalties)).withColumn("_loss", loss)
    return losses.groupBy(*key, "penalty").agg(F.avg("_loss").alias("mean_loss"), F.count(F.lit(1)).alias("n_folds"))


def ridge_halving(df: DataFrame, *, key: Sequence[str], ts: str, features: Sequence[str], y: str, penalties: Sequence[float],
                  k: int = 5, keep: float = 0.5, block_s: int = DAY) -> DataFrame:
    """Successive halving: each penalty with the rung it reached, its mean loss
    over the folds seen until then, and their number.

    Rung r judges the penalties that are left by the first 2^r of ``k`` folds;
    the better share ``keep`` (rounded up) of each series goes on, and the last
    rung has all folds. Of equal losses the smaller penalty is better. Losses add
    up over folds, and a fold is a matrix of sums: the data is read once, and a
    rung computes the losses of its new folds for the survivors alone.
    """
    folds, loss = _fold_sums(df, key, ts, features, y, k, block_s)
    folds = cut_lineage(folds)
    alive = folds.select(*key).distinct().withColumn("penalty", _penalties(penalties)).withColumn("_sum", F.lit(0.0)).withColumn("_n", F.lit(0).cast("long"))
    out, seen, rung, left = None, 0, 0, len(penalties)
    while True:
        upto, left = min(k, 1 << rung), math.ceil(left * keep)
        new = match(alive, folds.where((F.col("_piece") > seen) & (F.col("_piece") <= upto)), key).withColumn("_loss", loss)
        alive = new.groupBy(*key, "penalty").agg((F.first("_sum") + F.sum("_loss")).alias("_sum"), (F.first("_n") + F.count(F.lit(1))).alias("_n"))
        place = F.row_number().over(W.partitionBy(*key).orderBy(F.col("_sum") / F.col("_n"), "penalty"))  # one row a penalty
        judged = cut_lineage(alive.withColumn("_place", place).withColumn("rung", F.lit(rung).cast("long")))
        stays = (F.col("_place") <= left) & F.lit(upto < k)
        ended = judged.where(~stays).select(*key, "penalty", "rung", (F.col("_sum") / F.col("_n")).alias("mean_loss"), F.col("_n").alias("n_folds"))
        out = ended if out is None else out.unionByName(ended)
        if upto == k:
            return out
        alive, seen, rung = judged.where(stays).drop("_place", "rung"), upto, rung + 1


def best_config(scores: DataFrame, *, key: Sequence[str], loss: str, config: Sequence[str]) -> DataFrame:
    """The configuration with the smallest loss per series; the first on a tie."""
    row = F.struct(F.col(loss), *config)
    return scores.groupBy(*key).agg(F.min(row).alias("_b")).select(*key, *[F.col(f"_b.{c}").alias(c) for c in [*config, loss]])


def forecast_next(history: DataFrame, forecast: DataFrame, *, key: Sequence[str], ts: str, features: Sequence[str],
                  night: str, n: int, score: Callable[[Column], Column], horizon: int = 24,
                  timed: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """Hourly forecast for ``horizon`` hours after the end of each history.

    The first hour is scored on the last ``n`` history rows. Each later hour
    moves the window on by its own forecast row; a missing one repeats the row
    before it, with the time features of ``timed`` made for its own time. Where
    the last row of the window is at night the forecast is 0.

    A series needs its last n history rows and its forecast rows only; they are
    found before anything is shuffled by series.
    """
    cols = [*features, night]
    ends = cut_lineage(history.groupBy(*key).agg(F.max(ts).alias("_end")))
    hour = F.lit(3600 * 1_000_000)
    us = lambda c: F.unix_micros(c.cast("timestamp"))

    def placed(df: DataFrame) -> DataFrame:
        return match(df, ends, key).withColumn("_h", ((us(F.col(ts)) - us(F.col("_end"))) / hour).cast("long"))

    past = placed(history).where((F.col("_h") > -n) & (F.col("_h") <= 0))
    steps = ends.select(*key, "_end", F.explode(F.sequence(F.lit(2).cast("long"), F.lit(horizon).cast("long"))).alias("_h"))
    known = placed(forecast).select(*key, "_h", *cols, F.lit(1).alias("_known"))
    ahead = match(steps, known, [*key, "_h"], "left").withColumn(
        ts, F.timestamp_micros(us(F.col("_end")) + F.col("_h") * hour).cast("timestamp_ntz"))
    rows = past.select(*key, "_end", "_h", ts, *cols, F.lit(1).alias("_known")).unionByName(ahead)
    w = W.partitionBy(*key).orderBy("_h")  # n + horizon rows
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    row = F.when(F.col("_known") == 1, F.struct(*cols))
    rows = rows.withColumn("_row", F.last(row, ignorenulls=True).over(upto)).select(
        *key, "_end", "_h", ts, *[F.col(f"_row.{c}").alias(c) for c in cols])
    if timed:
        rows = rows.withColumns(timed(F.col(ts)))
    window = w.rowsBetween(-(n - 1), 0)
    made = list(features) + (list(timed(F.col(ts))) if timed else [])
    rows = rows.withColumns({"_x": F.collect_list(F.struct(*made)).over(window), "_c": F.count(F.lit(1)).over(window)})
    rows = rows.where((F.col("_h") >= 0) & (F.col("_c") == n))
    target = F.when(F.col("_h") == 0, F.lit(1)).otherwise(F.col("_h"))
    power = F.when(F.col(night) > 0.5, F.lit(0.0)).otherwise(F.greatest(score(F.col("_x")), F.lit(0.0)))
    return rows.select(*key, F.timestamp_micros(us(F.col("_end")) + target * hour).cast("timestamp_ntz").alias(ts),
                       target.cast("long").alias("hour_ahead"), power.alias("power_w"))
