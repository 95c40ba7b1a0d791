"""Mutual information from nearest neighbours, exact, on a grid of ranks.

The estimate of Kraskov, Stoegbauer and Grassberger (2004) needs, for each point
(x, y), the distance to its k-th neighbour, and how many points are closer than
that in x alone and in y alone. Points are dealt to tiles of a grid whose strips
hold about equally many points. A tile and the ring of tiles around it give a
distance, which is the right one if it does not reach over the ring; what is
left looks at all tiles that its square touches. The counts are running sums
within strips, over the points and the ends of their intervals.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .keys import match

TILE = 512  # points that a tile should have
FINE = 256  # most strips of a column
#: Distances that differ by less, relatively, count as equal: rounding must not
#: decide whether the k-th neighbour itself is closer than its distance.
SLACK = 1e-9


def nearest_distances(qx: np.ndarray, qy: np.ndarray, cx: np.ndarray, cy: np.ndarray, k: int, step: int = 16) -> np.ndarray:
    """The ``k`` smallest distances (the larger of both differences) from each
    query to the candidates, sorted, inf where there are fewer. Candidates are
    walked from the query's x outwards until x alone is too far."""
    order = np.argsort(cx, kind="stable")
    cx, cy = np.append(cx[order], np.inf), np.append(cy[order], np.inf)
    n = len(order)
    best = np.full((len(qx), k), np.inf)
    start = np.searchsorted(cx[:n], qx)
    for side, at in ((1, start.copy()), (-1, start - 1)):
        todo = np.arange(len(qx))
        while len(todo):
            i = at[todo, None] + side * np.arange(step)
            i = np.where((i < 0) | (i > n), n, i)
            d = np.maximum(np.abs(cx[i] - qx[todo, None]), np.abs(cy[i] - qy[todo, None]))
            best[todo] = np.partition(np.hstack((best[todo], d)), k - 1, axis=1)[:, :k]
            at[todo] += side * step
            inside = (at[todo] >= 0) & (at[todo] < n)
            edge = np.abs(cx[np.where(inside, at[todo], n)] - qx[todo])
            todo = todo[edge < best[todo, k - 1]]
    return np.sort(best, axis=1)


def _strip(value: Column, bounds: Column) -> Column:
    """How many bounds are below ``value``, by binary search in the sorted array."""
    jumps = F.array(*[F.lit(1 << b) for b in reversed(range(FINE.bit_length()))])
    found = F.aggregate(jumps, F.lit(0), lambda at, jump: F.when(F.get(bounds, at + jump - 1) < value, at + jump).otherwise(at))
    return F.coalesce(F.when(F.size(bounds) > 0, found), F.lit(0))


def _digamma(n: Column) -> Column:
    """Of a whole number: eight steps up, then the asymptotic series."""
    far = n + 8
    series = F.ln(far) - 1 / (2 * far) - 1 / (12 * far**2) + 1 / (120 * far**4) - 1 / (252 * far**6)
    steps = F.lit(0.0)
    for i in range(8):
        steps = steps + 1 / (n + i)
    return series - steps


def _points(df: DataFrame, key: Sequence[str], target: str, features: Sequence[str]) -> DataFrame:
    """Distinct points (x, y) of each feature, each column over its deviation, with
    their number of rows. Rows with a missing value are left out."""
    rows = cut_lineage(df.dropna(subset=[target, *features]).select(*key, *[F.col(c).cast("double").alias(c) for c in [target, *features]]))
    rows = rows.unpivot([*key, target], list(features), "feature", "_x").withColumnRenamed(target, "_y")
    by = [*key, "feature"]
    spread = rows.groupBy(*by).agg(F.stddev_pop("_x").alias("_sx"), F.stddev_pop("_y").alias("_sy"))
    unit = lambda c, s: F.col(c) / F.when(F.col(s) > 0, F.col(s)).otherwise(F.lit(1.0))
    points = match(rows, spread, by).select(*by, unit("_x", "_sx").alias("x"), unit("_y", "_sy").alias("y"))
    return cut_lineage(points.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("w")))


def _placed(points: DataFrame, by: Sequence[str], tile: int) -> tuple[DataFrame, DataFrame]:
    """Points with their strips ``a`` and ``b``, and the strips' bounds per group."""
    shares = F.lit(np.arange(1, FINE) / FINE)
    fine = points.groupBy(*by).agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("_points"),
                                   F.percentile_approx("x", shares, 4096).alias("_x"), F.percentile_approx("y", shares, 4096).alias("_y"))
    strips = F.least(F.ceil(F.sqrt(F.col("_points") / F.lit(tile))), F.lit(FINE)).cast("int")
    picked = lambda c: F.when(F.col("_k") > 1, F.transform(F.sequence(F.lit(1), F.col("_k") - 1), lambda i: F.get(c, F.floor(i * F.lit(FINE) / F.col("_k")).cast("int") - 1))).otherwise(F.array().cast("array<double>"))
    # Equal bounds would make empty strips.
    bounds = fine.withColumn("_k", strips).select(*by, "n", F.array_distinct(picked("_x")).alias("_bx"), F.array_distinct(picked("_y")).alias("_by"))
    bounds = cut_lineage(bounds)
    placed = match(points, bounds, by).select(*by, "x", "y", "w", _strip(F.col("x"), F.col("_bx")).alias("a"), _strip(F.col("y"), F.col("_by")).alias("b"))
    return cut_lineage(placed), bounds


def _searched(queries: DataFrame, points: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Queries (x, y and ``_cells``: the tiles to look at) with ``eps``, the k-th
    distance among the points of those tiles, the point itself left out."""
    cell = F.explode("_cells").alias("_c")
    left = queries.select(F.struct(*by, "x", "y").alias("_q"), F.col("x").alias("_qx"), F.col("y").alias("_qy"), *by, cell)
    left = left.select(F.struct(*by, F.col("_c.a").alias("a"), F.col("_c.b").alias("b")).alias("_at"), "_q", "_qx", "_qy")
    # Beyond k + 1 rows of one point, more of them change no distance.
    copies = F.explode(F.array_repeat(F.lit(1), F.least("w", F.lit(k + 1)).cast("int")))
    right = points.select(F.struct(*by, "a", "b").alias("_to"), F.col("x").alias("_px"), F.col("y").alias("_py"), copies.alias("_one")).drop("_one")

    def nearest(q: pa.Table, p: pa.Table) -> pa.Table:
        at = lambda t, c: t.column(c).to_numpy()
        qx, qy, px, py = at(q, "_qx"), at(q, "_qy"), at(p, "_px"), at(p, "_py")
        found = nearest_distances(qx, qy, px, py, k + 1)
        return pa.table({"_q": q.column("_q").combine_chunks(), "d": pa.array(list(found), pa.list_(pa.float64()))})

    schema = f"_q {left.schema['_q'].dataType.simpleString()}, d array<double>"
    lists = left.groupBy("_at").cogroup(right.groupBy("_to")).applyInArrow(nearest, schema)
    merged = lists.groupBy("_q").agg(F.collect_list("d").alias("d"))  # a list a tile
    eps = F.get(F.sort_array(F.flatten("d")), F.lit(k))  # the first is the point itself
    return merged.select("_q.*", F.coalesce(eps, F.lit(float("inf"))).alias("eps"))


def _distances(points: DataFrame, bounds: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Each point with ``eps``, the exact distance to its k-th neighbour."""
    grid = lambda a1, a2, b1, b2: F.flatten(F.transform(F.sequence(a1, a2), lambda a: F.transform(F.sequence(b1, b2), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    sides = match(points, bounds, by)
    last_a, last_b = F.size("_bx"), F.size("_by")
    todo, done, ring = sides.withColumn("eps", F.lit(float("inf"))), None, 1
    while True:
        low = lambda c: F.greatest(F.col(c) - ring, F.lit(0))
        high = lambda c, last: F.least(F.col(c) + ring, last)
        around = grid(low("a"), high("a", last_a), low("b"), high("b", last_b))
        # With a distance at hand, the tiles that its square touches are enough.
        touched = grid(_strip(F.col("x") - F.col("eps"), F.col("_bx")), _strip(F.col("x") + F.col("eps"), F.col("_bx")),
                       _strip(F.col("y") - F.col("eps"), F.col("_by")), _strip(F.col("y") + F.col("eps"), F.col("_by")))
        whole = F.col("eps") < float("inf")
        asked = todo.withColumn("_cells", F.when(whole, touched).otherwise(around)).withColumn("_whole", whole)
        found = match(asked.drop("eps", "_cells"), _searched(asked, points, by, k), [*by, "x", "y"])
        inf = F.lit(float("inf"))
        reach = F.least(F.when(F.col("a") + ring < last_a, F.get("_bx", F.col("a") + ring) - F.col("x")).otherwise(inf),
                        F.when(F.col("a") - ring > 0, F.col("x") - F.get("_bx", F.col("a") - ring - 1)).otherwise(inf),
                        F.when(F.col("b") + ring < last_b, F.get("_by", F.col("b") + ring) - F.col("y")).otherwise(inf),
                        F.when(F.col("b") - ring > 0, F.col("y") - F.get("_by", F.col("b") - ring - 1)).otherwise(inf))
        found = cut_lineage(found.withColumn("_sure", F.col("_whole") | (F.col("eps") <= reach)))
        sure = found.where("_sure").select(*by, "x", "y", "w", "eps")
        done = sure if done is None else done.unionByName(sure)
        todo = found.where("not _sure").drop("_sure", "_whole")
        if todo.isEmpty():
            return done
        ring *= 4


def _closer(points: DataFrame, found: DataFrame, by: Sequence[str], bounds: DataFrame, value: str, strip: str, edge: str) -> DataFrame:
    """How many rows are closer to each point than its ``eps`` in one column.

    Interval ends and values are one order of rows; sums of a strip's rows before
    it, and within the strip, count the values below an end. Equal values are
    one row. Ends that include an equal value come after it, others before.
    """
    values = points.groupBy(*by, value, strip).agg(F.sum("w").alias("_n"))
    per_strip = values.groupBy(*by, strip).agg(F.sum("_n").alias("_s"))
    before = F.sum("_s").over(W.partitionBy(*by).orderBy(strip)) - F.col("_s")  # at most FINE rows
    bases = cut_lineage(per_strip.select(*by, F.col(strip).alias("_strip"), before.alias("_base"), F.col("_s")))
    radius, none = F.col("eps") * (1 - SLACK), F.col("eps") == 0
    ends = F.array(F.struct((F.col(value) - radius).alias("v"), F.when(none, 0).otherwise(2).alias("o"), F.lit(-1).alias("sign")),
                   F.struct((F.col(value) + radius).alias("v"), F.when(none, 2).otherwise(0).alias("o"), F.lit(1).alias("sign")))
    asked = match(found, bounds, by).select(*by, "x", "y", F.explode(ends).alias("_e"), F.col(edge).alias("_bounds"), F.col("n").alias("_all"))
    asked = asked.select(*by, "x", "y", _strip(F.col("_e.v"), F.col("_bounds")).alias("_strip"), F.col("_e.v").alias("_v"), F.col("_e.o").alias("_o"), F.col("_e.sign").alias("_sign"), F.lit(0).cast("bigint").alias("_n"), "_all")
    rows = values.select(*by, F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.col(strip).alias("_strip"), F.col(value).alias("_v"), F.lit(1).alias("_o"), F.lit(0).alias("_sign"), "_n", F.lit(None).cast("bigint").alias("_all"))
    inside = F.sum("_n").over(W.partitionBy(*by, "_strip").orderBy("_v", "_o").rowsBetween(W.unboundedPreceding, 0))
    counted = rows.unionByName(asked).withColumn("_in", inside).where("_sign <> 0")
    # A bound is a value of its strip, so only the strip above all bounds may be empty.
    counted = match(counted, bases, [*by, "_strip"], "left").withColumn("_below", F.col("_in") + F.coalesce("_base", "_all"))
    return counted.groupBy(*by, "x", "y").agg(F.sum(F.col("_sign") * F.col("_below")).alias(f"n_{value}"))


def mutual_information_knn(df: DataFrame, *, key: Sequence[str], target: str, features: Sequence[str], k: int = 3, tile: int = TILE) -> DataFrame:
    """Mutual information (nats) of each feature with the target from the ``k``
    nearest neighbours; not below 0. Columns are divided by their deviation first.

    Rows with a missing value in any column are left out. A value that many rows
    share counts with all of them; points with k copies have distance 0, and their
    neighbours are the rows of equal values. A series of k rows or fewer has NULL.
    """
    by = [*key, "feature"]
    points, bounds = _placed(_points(df, key, target, features), by, tile)
    found = _distances(points, bounds, by, k)  # of written steps
    both = match(_closer(points, found, by, bounds, "x", "a", "_bx"), _closer(points, found, by, bounds, "y", "b", "_by"), [*by, "x", "y"])
    sums = match(match(found, both, [*by, "x", "y"]), bounds.select(*by, "n"), by).groupBy(*by).agg(
        F.first("n").alias("n"), F.sum(F.col("w") * (_digamma(F.col("n_x")) + _digamma(F.col("n_y")))).alias("_s"))
    mi = _digamma(F.col("n")) + _digamma(F.lit(k)) - F.col("_s") / F.col("n")
    return sums.select(*by, F.when(F.col("n") > k, F.greatest(mi, F.lit(0.0))).alias("mi"))
