"""Exact ranks and quantiles without sorting a column in one task.

Equal values are first counted together, so a value that makes up a large share
of the rows is one row from there on. Distinct values are spread over buckets by
approximate quantile bounds, as many as the group's rows fill; a bucket's rank
base is the prefix sum of the bucket counts. The bounds only balance the work:
ranks are exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .keys import match

BUCKET_BITS = 10  # at most 2^bits buckets per group
BUCKET_ROWS = 250_000  # rows that fill a bucket


def _bucket(value: Column, bounds: Column, bits: int) -> Column:
    """How many bounds are below ``value``, by binary search in the sorted array."""
    jumps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    found = F.aggregate(
        jumps, F.lit(0),
        lambda at, jump: F.when(F.get(bounds, at + jump - 1) < value, at + jump).otherwise(at),
    )
    # Never NULL, and Spark can see it: else a join on it computes it twice to filter NULLs.
    return F.coalesce(F.when(F.size(bounds) > 0, found), F.lit(0))


def _bounds(known: DataFrame, value: str, group: Sequence[str], bits: int, bucket_rows: int) -> DataFrame:
    """Bucket bounds per group, as many as its rows fill; a small group has none.

    Groups are counted first, and only those that fill several buckets sketched.
    """
    most = 1 << bits
    sizes = known.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    sizes = cut_lineage(sizes.withColumn("_k", F.least(F.ceil(F.col("_rows") / F.lit(bucket_rows)), F.lit(most)).cast("int")))
    large = match(known, sizes.where("_k > 1").select(*group), group)
    shares = F.lit(np.arange(1, most) / most)  # one array literal: a thousand single ones slow the planner
    fine = large.groupBy(*group).agg(F.percentile_approx(value, shares, 10_000).alias("_fine"))
    fine = match(sizes, fine, group, "left")
    picked = F.transform(F.sequence(F.lit(1), F.col("_k") - 1), lambda i: F.get("_fine", F.floor(i * F.lit(most) / F.col("_k")).cast("int") - 1))
    return fine.select(*group, F.when(F.col("_k") > 1, picked).alias("_bounds"))


def value_ranks(df: DataFrame, *, value: str, group: Sequence[str], bits: int = BUCKET_BITS, bucket_rows: int = BUCKET_ROWS,
                distinct: bool = False) -> DataFrame:
    """Each distinct value of a group: its count ``cnt``, the number of rows with
    a smaller value ``less``, and the group size ``n``; with ``distinct`` also the
    number of smaller distinct values ``distinct_less``. Missing values are left out."""
    known = df.where(F.col(value).isNotNull()).select(*group, value)
    counts = known.groupBy(*group, value).agg(F.count(F.lit(1)).alias("cnt"))
    bounds = cut_lineage(_bounds(known, value, group, bits, bucket_rows))

    def place(rows: DataFrame) -> DataFrame:
        return match(rows, bounds, group).withColumn("_bucket", _bucket(F.col(value), F.col("_bounds"), bits)).drop("_bounds")

    placed = place(counts)
    if distinct:
        sizes = placed.groupBy(*group, "_bucket").agg(F.sum("cnt").alias("_c"), F.count(F.lit(1)).alias("_d"))
    else:  # a second scan, summed on the map side, costs less than the values' shuffle
        sizes = place(known).groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    over = W.partitionBy(*group)
    past = over.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # at most 2^bits rows
    before = {"_cb": "_c", "_db": "_d"} if distinct else {"_cb": "_c"}
    bases = sizes.select(
        *group, "_bucket", F.sum("_c").over(over).alias("n"),
        *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(name) for name, c in before.items()],
    )
    local = W.partitionBy(*group, "_bucket").orderBy(value)
    inside = F.coalesce(F.sum("cnt").over(local.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = [(F.col("_cb") + inside).alias("less")]
    if distinct:
        places.append((F.col("_db") + F.row_number().over(local) - 1).alias("distinct_less"))
    return match(placed, bases, [*group, "_bucket"]).select(*group, value, "cnt", "n", *places)


def average_rank() -> Column:
    """Rank from 1 where equal values share the mean of their places."""
    return F.col("less") + (F.col("cnt") + 1) / F.lit(2.0)


def quantiles(df: DataFrame, *, value: str, group: Sequence[str], probs: dict[str, float], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``."""
    ranked = value_ranks(df, value=value, group=group, bucket_rows=bucket_rows)
    inside = lambda place: (F.col("less") <= place) & (place < F.col("less") + F.col("cnt"))
    aggs, outs = [], []
    for name, p in probs.items():
        place = F.lit(p) * (F.col("n") - 1)
        aggs += [
            F.max(F.when(inside(F.floor(place)), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(inside(F.ceil(place)), F.col(value))).alias(f"_hi_{name}"),
            F.max(place - F.floor(place)).alias(f"_f_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * F.col(f"_f_{name}")).alias(name))
    return ranked.groupBy(*group).agg(*aggs).select(*group, *outs)


def long_form(df: DataFrame, *, ids: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row per column and row, for operators that treat all columns alike."""
    return df.unpivot(list(ids), list(cols), name, value)


def ranked_wide(df: DataFrame, *, group: Sequence[str], ids: Sequence[str], cols: Sequence[str], measure: Column,
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Replace each column by a measure of its rank (``average_rank()``, ``rank_bin(k)``).

    All columns are ranked in one pass over their long form.
    """
    rows = long_form(df.select(*group, *ids, *cols), ids=[*group, *ids], cols=cols)
    ranked = value_ranks(rows, value="value", group=[*group, "feature"], bucket_rows=bucket_rows)
    scored = ranked.select(*group, "feature", "value", measure.alias("_m"))
    joined = match(rows.where(F.col("value").isNotNull()), scored, [*group, "feature", "value"])
    wide = [F.max(F.when(F.col("feature") == c, F.col("_m"))).alias(c) for c in cols]
    return joined.groupBy(*group, *ids).agg(*wide)


def rank_bin(k: int) -> Column:
    """Equal-count bin from 0; equal values always share a bin."""
    return F.floor(F.col("less") * F.lit(k) / F.col("n"))


def sums_before(df: DataFrame, *, key: Sequence[str], index: str, cols: dict[str, str], rows: int = 4096) -> DataFrame:
    """Sum of each column over the rows of the key with a smaller ``index``.

    ``index`` is a whole number and unique within the key. Block sums first,
    then sums inside the block, so no task sorts a whole key.
    """
    blocked = df.withColumn("_rows", F.floor(F.col(index) / F.lit(rows)))
    sums = blocked.groupBy(*key, "_rows").agg(*[F.sum(c).alias(f"_s_{c}") for c in cols])
    past = W.partitionBy(*key).orderBy("_rows").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(*key, "_rows", *[F.coalesce(F.sum(f"_s_{c}").over(past), F.lit(0)).alias(f"_b_{c}") for c in cols])
    local = W.partitionBy(*key, "_rows").orderBy(index).rowsBetween(W.unboundedPreceding, -1)
    out = match(blocked, bases, [*key, "_rows"])
    out = out.withColumns({name: F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(local), F.lit(0)) for c, name in cols.items()})
    return out.drop("_rows", *[f"_b_{c}" for c in cols])


def _codes(df: DataFrame, group: Sequence[str], cols: Sequence[str], bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with each column as a dense code from 0, and per column the pairs of
    rows that it does not tie. Columns are ranked in one pass over their long form."""
    rows = cut_lineage(df.dropna(subset=list(cols)).select(*group, *cols).withColumn("_id", F.monotonically_increasing_id()))
    tall = long_form(rows, ids=[*group, "_id"], cols=cols)
    ranked = cut_lineage(value_ranks(tall, value="value", group=[*group, "feature"], bucket_rows=bucket_rows, distinct=True))
    joined = match(tall, ranked.select(*group, "feature", "value", "distinct_less"), [*group, "feature", "value"])
    wide = joined.groupBy(*group, "_id").agg(*[F.max(F.when(F.col("feature") == c, F.col("distinct_less"))).alias(c) for c in cols])
    double = lambda c: c.cast("double") * (c - 1) / 2
    free = ranked.groupBy(*group, "feature").agg(F.max("n").alias("_n"), (double(F.max("n")) - F.sum(double(F.col("cnt")))).alias("_free"))
    return cut_lineage(match(wide, free.groupBy(*group).agg(F.max("_n").alias("_n")), group)), cut_lineage(free)


def kendall_matrix(df: DataFrame, *, group: Sequence[str], cols: Sequence[str], rows: int = 4096, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Kendall's tau-b of each pair of ``cols`` over complete rows, as (a, b, n,
    tau), exact, without forming pairs of rows. NULL where a column does not vary.

    Columns become dense codes. Two different codes of y first differ, seen from
    the top, at one bit: at that level they share the higher bits, and the larger
    code has the 1. So per level and shared prefix, walking along x, every 0 met
    after a 1 is a discordant pair and every 1 after a 0 a concordant one. That
    is one running sum over n log n rows, for all pairs of columns together. Rows
    with the same x are counted together first, which leaves ties out.
    """
    coded, free = _codes(df, group, cols, bucket_rows)
    by = [*group, "a", "b"]
    cells = F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("_xc"), F.col(b).alias("_yc")) for a, b in combinations(cols, 2)]))
    cells = coded.select(*group, "_n", cells).groupBy(*by, "_n", "_xc", "_yc").agg(F.count(F.lit(1)).alias("_w"))
    top = F.floor(F.log2(F.col("_n").cast("double"))).cast("int")
    levels = cells.withColumn("_level", F.explode(F.sequence(F.lit(0), top)))
    shifted = F.call_function("shiftright", F.col("_yc"), F.col("_level"))
    bit = F.pmod(shifted, F.lit(2))
    at_x = levels.groupBy(*by, "_level", F.floor(shifted / 2).alias("_prefix"), "_xc").agg(
        F.sum(F.col("_w") * bit).alias("_ones"), F.sum(F.col("_w") * (1 - bit)).alias("_zeros"))
    walked = sums_before(at_x, key=[*by, "_level", "_prefix"], index="_xc",
                         cols={"_ones": "_ones_before", "_zeros": "_zeros_before"}, rows=rows)
    score = F.col("_ones").cast("double") * F.col("_zeros_before") - F.col("_zeros").cast("double") * F.col("_ones_before")
    scores = walked.groupBy(*by).agg(F.sum(score).alias("_score"))
    side = lambda c, name: free.select(*group, F.col("feature").alias(c), "_n", F.col("_free").alias(name))
    out = match(match(scores, side("a", "_fa").withColumnRenamed("_n", "n"), [*group, "a"]), side("b", "_fb").drop("_n"), [*group, "b"])
    return out.select(*by, "n", F.try_divide("_score", F.sqrt(F.col("_fa") * F.col("_fb"))).alias("tau"))


def kendall_tau(df: DataFrame, *, group: Sequence[str], x: str, y: str, rows: int = 4096, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Kendall's tau-b of two columns per group, as ``kendall_matrix`` computes it."""
    return kendall_matrix(df, group=group, cols=[x, y], rows=rows, bucket_rows=bucket_rows).select(*group, "n", "tau")
