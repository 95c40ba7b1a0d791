"""Forecast error measures as aggregate expressions; one pass gives all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.measures import correlation
from ..session import cut_lineage
from .keys import match

EPS = 1e-8


def basic(y: Column, p: Column) -> dict[str, Column]:
    """MSE, RMSE, MAE and R2 as one minus the unexplained share."""
    err2 = (y - p) * (y - p)
    known = F.when(p.isNotNull(), y)
    sst = F.var_pop(known) * F.count(err2)
    return {
        "n": F.count(err2), "mse": F.avg(err2), "rmse": F.sqrt(F.avg(err2)), "mae": F.avg(F.abs(y - p)),
        "r2": F.lit(1.0) - F.try_divide(F.sum(err2), sst),
    }


def pearson_r2(y: Column, p: Column) -> dict[str, Column]:
    """R2 as the squared correlation, which ignores bias and scale."""
    r = correlation(y, p)
    return {"pearson_r2": r * r}


def mape(y: Column, p: Column) -> dict[str, Column]:
    """Four readings of the percentage error, which differ at zero actuals."""
    gap = F.abs(y - p)
    share = F.try_divide(gap, F.abs(y))
    return {
        "mape_zero_as_none": F.avg(F.when(gap.isNull(), None).when(F.abs(y) > EPS, share).otherwise(F.lit(0.0))) * 100,
        "mape_eps": F.avg(F.abs(F.try_divide(y - p, y + EPS))) * 100,
        "mape_skip_zero": F.avg(F.when(y != 0, share)) * 100,
        "mape_raw": F.avg(share) * 100,
    }


def smape(y: Column, p: Column) -> dict[str, Column]:
    """Four readings of the symmetric percentage error."""
    gap, size = F.abs(p - y), F.abs(y) + F.abs(p)
    return {
        "smape_eps": F.avg(2.0 * gap / (size + EPS)) * 100,
        "smape_half": F.avg(gap / F.when(size == 0, F.lit(1.0)).otherwise(size / 2)) * 100,
        "smape_skip_zero": F.avg(F.when(size != 0, 2.0 * F.try_divide(gap, size))) * 100,
        "smape_raw": F.avg(F.try_divide(gap, size)) * 200,
    }


def relative(y: Column, p: Column) -> dict[str, Column]:
    """Errors in percent of the mean actual value."""
    err2, mean = (y - p) * (y - p), F.avg(F.when(p.isNotNull(), y))
    return {
        "rmse_pct": F.try_divide(F.sqrt(F.avg(err2)), mean) * 100,
        "mse_pct": F.try_divide(F.avg(err2), mean) * 100,
        "mae_pct": F.try_divide(F.avg(F.abs(y - p)), mean) * 100,
    }


def measure(df: DataFrame, *measures: dict[str, Column], group: Sequence[str]) -> DataFrame:
    named = [c.alias(name) for m in measures for name, c in m.items()]
    return df.groupBy(*group).agg(*named)


def threshold_curve(df: DataFrame, *, key: Sequence[str], y: str, pred: str, n: int = 100) -> DataFrame:
    """True and false positive rates of "above the threshold", at ``n`` thresholds
    evenly from the smallest to the largest of both columns.

    Each value is placed between two thresholds, so rows shrink to counts of at
    most (n+1)^2 cells before thresholds multiply anything. Thresholds that leave
    one class are skipped; one where all predictions agree has both rates 1.
    """
    known = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).select(*key, y, pred)
    ends = cut_lineage(known.groupBy(*key).agg(F.min(F.least(y, pred)).alias("_lo"), F.max(F.greatest(y, pred)).alias("_hi")))

    def threshold(i: Column) -> Column:
        return F.col("_lo") + i * ((F.col("_hi") - F.col("_lo")) / F.lit(float(n - 1)))

    def below(c: str) -> Column:
        """How many thresholds lie below the value: a guess, corrected by one."""
        width = (F.col("_hi") - F.col("_lo")) / F.lit(float(n - 1))
        guess = F.coalesce(F.ceil(F.try_divide(F.col(c) - F.col("_lo"), width)), F.lit(0))
        lower = F.when((guess > 0) & (threshold(guess - 1) >= F.col(c)), guess - 1).otherwise(guess)
        return F.when((guess < n) & (threshold(guess) < F.col(c)), guess + 1).otherwise(lower)

    cells = match(known, ends, key).groupBy(*key, "_lo", "_hi", below(y).alias("_y"), below(pred).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"))
    steps = cells.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    real, said = F.col("_y") > F.col("step"), F.col("_p") > F.col("step")
    count = lambda cond: F.sum(F.when(cond, F.col("_n")).otherwise(F.lit(0)))
    out = steps.groupBy(*key, "_lo", "_hi", "step").agg(
        count(real).alias("_pos"), count(~real).alias("_neg"), count(said).alias("_said"),
        count(real & said).alias("_tp"), count(~real & said).alias("_fp"))
    out = out.where((F.col("_pos") > 0) & (F.col("_neg") > 0))
    one_class = (F.col("_said") == 0) | (F.col("_said") == F.col("_pos") + F.col("_neg"))
    rate = lambda hit, of: F.when(one_class, F.lit(1.0)).otherwise(F.col(hit) / F.col(of))
    return out.select(*key, F.col("step").cast("long").alias("step"), threshold(F.col("step")).alias("threshold"),
                      rate("_tp", "_pos").alias("tpr"), rate("_fp", "_neg").alias("fpr"))


def rank_configs(df: DataFrame, *, config: str, y: str, pred: str) -> DataFrame:
    """Measures of each configuration, its place by RMSE, and a flag on the best.

    There is one row per configuration when they are ranked.
    """
    scored = measure(df, basic(F.col(y), F.col(pred)), group=[config])
    place = F.rank().over(W.orderBy("rmse"))
    return scored.withColumn("place", place.cast("long")).withColumn("is_best", (F.col("place") == 1).cast("int"))
