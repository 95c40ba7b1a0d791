"""Joins, unions and de-duplication of series tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.timecols import micros
from ..session import cut_lineage
from .keys import match
from .blocks import DAY
from .grid import reindex_nearest


def outer_then_complete(tables: Sequence[DataFrame], *, on: Sequence[str]) -> DataFrame:
    """Full outer join of all tables, then only the rows without a missing value.

    A row that one table lacks is incomplete and would be dropped, and the same
    holds for a NULL in the table itself. So incomplete rows go before the
    shuffle and an inner join gives the same result.
    """
    return reduce(lambda a, b: a.join(b, list(on)), [t.dropna() for t in tables])


def asof_nearest(left: DataFrame, right: DataFrame, grid: DataFrame, *, key: Sequence[str], ts: str,
                 left_cols: Sequence[str], right_cols: Sequence[str], step_s: int, tolerance_s: int | None = None,
                 block_s: int = DAY) -> DataFrame:
    """Two irregular series on one grid, each by its nearest reading."""
    sides = [
        reindex_nearest(side, key=key, ts=ts, cols=cols, step_s=step_s, grid=grid, tolerance_s=tolerance_s, block_s=block_s)
        for side, cols in ((left, left_cols), (right, right_cols))
    ]
    return match(sides[0], sides[1], [*key, ts])


def keep_days(df: DataFrame, days: DataFrame, *, day: str) -> DataFrame:
    """Rows of the listed days; a list of days is broadcast by its written size."""
    return df.join(cut_lineage(days.select(day)), day, "left_semi")


def drop_days(df: DataFrame, days: DataFrame, *, day: str) -> DataFrame:
    return df.join(cut_lineage(days.select(day)), day, "left_anti")


def compare_results(a: DataFrame, b: DataFrame, *, on: Sequence[str], value: str) -> DataFrame:
    """Mean and largest absolute difference, and the difference of means in percent."""
    both = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), list(on))
    gap = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(gap).alias("mean_abs_diff"),
        F.max(gap).alias("max_abs_diff"),
        F.try_divide((F.avg("_b") - F.avg("_a")) * 100.0, F.avg("_a")).alias("relative_mean_pct"),
    )


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def keep_first(df: DataFrame, *, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``. A NULL key survives once.

    An aggregate and not a row number: map tasks already reduce each key to one
    row, so a key with very many copies stays cheap.
    """
    rest = [c for c in df.columns if c not in key]
    ordered = [c for c in order if c in rest]
    row = F.struct(*ordered, *[c for c in rest if c not in ordered])
    best = df.groupBy(*key).agg(F.min(row).alias("_first"))
    return best.select(*[F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in df.columns])


def last_rows(df: DataFrame, *, key: Sequence[str], ts: str, n: int, tie: Sequence[str] = (), block_s: int = DAY) -> DataFrame:
    """The last ``n`` rows of each series, first within blocks, then over blocks."""
    blocked = df.withColumn("_block", F.floor(micros(F.col(ts)) / F.lit(block_s * 1_000_000)))
    order = [F.col(ts).desc(), *[F.col(c).desc() for c in tie]]
    inside = blocked.withColumn("_r", F.row_number().over(W.partitionBy(*key, "_block").orderBy(*order))).where(F.col("_r") <= n)
    # A block cannot add rows when later blocks already hold n of them.
    counts = inside.groupBy(*key, "_block").agg(F.count(F.lit(1)).alias("_c"))
    later = F.coalesce(F.sum("_c").over(W.partitionBy(*key).orderBy(F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = counts.select(*key, "_block", later.alias("_later")).where(F.col("_later") < n)
    return match(inside, kept, [*key, "_block"]).where(F.col("_r") + F.col("_later") <= n).drop("_block", "_r", "_c", "_later")
