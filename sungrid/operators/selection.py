"""Exact quantiles by iterated counting: no column is sorted, or split by estimates.

The first pass counts every value in bins of its binary order of magnitude, cut
into ``FINE`` parts. Only bins that hold a wanted rank go on: the second pass
keeps their values, each distinct one with its count. As long as such a bin has
more than ``MOST`` distinct values, equal-width bins between its known ends are
counted in its place. What is left is a running count over the few values of a
bin. A shuffle gets a count per bin or distinct value, summed in each task, so a
value that a third of all rows share, or a group of any size, is no large task.
The data is read twice, however many rounds there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .keys import match

FINE = 128  # bins in a doubling of the value
BINS = 4096  # bins of a later round
MOST = 100_000  # distinct values of a bin over which a running count goes
_FAR = 1 << 20  # beyond every finite bin: 2200 doublings


def _order_bin(v: Column) -> Column:
    """A whole number that grows with ``v``, NaN last, as Spark orders doubles."""
    size = F.floor(F.log2(F.abs(v)) * FINE) + F.lit(_FAR // 2)
    finite = F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))
    return F.when(F.isnan(v), F.lit(2 * _FAR)).when(F.abs(v) == float("inf"), F.signum(v).cast("bigint") * _FAR).otherwise(finite).cast("bigint")


def bin_counts(df: DataFrame, *, value: str, group: Sequence[str]) -> DataFrame:
    """One row per group and filled bin: count, ends, mean and squared deviations.

    Written, since every later step reads it. Missing values are left out.
    """
    v = F.col(value).cast("double")
    known = df.where(F.col(value).isNotNull()).select(*group, v.alias("_v"))
    bins = known.groupBy(*group, _order_bin(F.col("_v")).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        F.avg("_v").alias("_mean"), (F.var_pop("_v") * F.count(F.lit(1))).alias("_m2"))
    return cut_lineage(bins)


def moments(bins: DataFrame, *, group: Sequence[str]) -> DataFrame:
    """n, mean, std, min and max of each group, put together from its bins."""
    n, shift = F.col("_n"), F.col("_mean") - F.col("_centre")
    centres = bins.groupBy(*group).agg((F.sum(F.col("_mean") * n) / F.sum(n)).alias("_centre"))
    sums = match(bins, centres, group).groupBy(*group).agg(
        F.sum(n).alias("n"), F.first("_centre").alias("mean"), F.sum(F.col("_m2") + n * shift * shift).alias("_ss"),
        F.min("_lo").alias("min"), F.max("_hi").alias("max"))
    return sums.select(*group, "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("_ss") / (F.col("n") - 1))).alias("std"), "min", "max")


def _ranks(probs: Sequence[float], n: Column) -> Column:
    """The ranks, from 0, of the two neighbours of each quantile."""
    return F.array(*[F.struct(F.lit(2 * i + up).alias("slot"), f(F.lit(p) * (n - 1)).cast("bigint").alias("rank"))
                     for i, p in enumerate(probs) for up, f in enumerate((F.floor, F.ceil))])


def _with_base(counts: DataFrame, over: Sequence[str], order: str, start: Column) -> DataFrame:
    """Counted bins with ``_base``, the number of values of the group below them."""
    run = F.sum("_n").over(W.partitionBy(*over).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return counts.withColumn("_base", start + run - F.col("_n"))


def _wanted(held: DataFrame, bins: DataFrame, group: Sequence[str]) -> DataFrame:
    """The bins (_bin: that they are part of, _lo, _hi, _base, _n) that hold a rank of ``held``."""
    asked = held.where("_lo < _hi").select(*group, "_slot", "_rank", "_total", F.col("_base").alias("_bin"))
    found = match(bins, asked, [*group, "_bin"]).where("_base <= _rank and _rank < _base + _n")
    return found.select(*group, "_slot", "_rank", "_total", "_lo", "_hi", "_base", "_n")


def _in_bins(rows: DataFrame, held: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows with ``_v`` in a bin of several values that holds a rank, with its
    ends and base as ``_s``. Bins of a group are disjoint."""
    bins = held.where("_lo < _hi").groupBy(*group).agg(F.collect_set(F.struct("_lo", "_hi", "_base")).alias("_bins"))  # two a quantile
    inside = F.filter("_bins", lambda b: F.col("_v").between(b["_lo"], b["_hi"]))
    return match(rows, bins, group).withColumn("_s", F.get(inside, F.lit(0))).drop("_bins").where(F.col("_s").isNotNull())


def quantiles_of(df: DataFrame, bins: DataFrame, *, value: str, group: Sequence[str], probs: dict[str, float], most: int = MOST) -> DataFrame:
    """Exact quantiles with linear interpolation from ``bin_counts(df, ...)``."""
    group = list(group)
    # Windows over the filled bins of a group: as many as its values have orders
    # of magnitude, times FINE, whatever the number of rows.
    placed = _with_base(bins, group, "_bin", F.lit(0)).withColumn("_total", F.sum("_n").over(W.partitionBy(*group)))
    mine = F.filter(_ranks(list(probs.values()), F.col("_total")), lambda r: (r["rank"] >= F.col("_base")) & (r["rank"] < F.col("_base") + F.col("_n")))
    held = placed.select(*group, F.inline(mine).alias("_slot", "_rank"), "_total", "_lo", "_hi", "_base", "_n")
    held = cut_lineage(held)  # a row for each group and wanted rank

    def largest() -> int:
        return held.where("_lo < _hi").agg(F.max("_n")).first()[0] or 0

    rows = largest()
    found = held.where("_lo = _hi or isnan(_lo)")
    if rows:
        known = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
        kept = _in_bins(known, held, group).groupBy(*group, "_s", "_v").agg(F.count(F.lit(1)).alias("_n"))
        if rows > most:
            kept = cut_lineage(kept)
        while rows > most:  # rows; a bin of few distinct values is narrowed once more than it need be
            share = (F.col("_v") - F.col("_s._lo")) / (F.col("_s._hi") - F.col("_s._lo"))
            part = F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("_part")
            narrow = kept.groupBy(*group, "_s", part).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
            narrow = _with_base(narrow, [*group, "_s"], "_part", F.col("_s._base")).withColumn("_bin", F.col("_s._base"))  # at most BINS rows
            held = cut_lineage(_wanted(held, narrow, group).unionByName(held.where("_lo = _hi or isnan(_lo)")))
            kept = _in_bins(kept.drop("_s"), held, group)
            rows, found = largest(), held.where("_lo = _hi or isnan(_lo)")
        single = _with_base(kept, [*group, "_s"], "_v", F.col("_s._base"))  # at most ``most`` values
        single = single.select(*group, "_n", "_base", F.col("_s._base").alias("_bin"), F.col("_v").alias("_lo"), F.col("_v").alias("_hi"))
        found = found.unionByName(_wanted(held, single, group))
    at = lambda slot: F.max(F.when(F.col("_slot") == slot, F.col("_lo")))
    outs = []
    for i, (name, p) in enumerate(probs.items()):
        place, lo, hi = F.lit(p) * (F.first("_total") - 1), at(2 * i), at(2 * i + 1)
        outs.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return found.groupBy(*group).agg(*outs)


def quantiles(df: DataFrame, *, value: str, group: Sequence[str], probs: dict[str, float], most: int = MOST) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``.

    A group without known values gives no row; a missing group is a group.
    """
    return quantiles_of(df, bin_counts(df, value=value, group=group), value=value, group=group, probs=probs, most=most)
