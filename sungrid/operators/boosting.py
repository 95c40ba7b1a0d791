"""Boosted regression trees per series, grown from gradient histograms.

Every series gets its own model. Features become bins once. A level of a tree is
one pass over the rows: sums of gradients per (series, node, feature, bin), added
up in each task, are all that is shuffled, so a series may have any share of the
rows. Models are a small table, one row per series, and the rows are never
written again: a pass derives predictions and nodes from the models it joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .keys import match

#: Gradients are whole multiples of 1 / UNIT: their sums do not depend on the
#: order of rows, so neither does the choice between equally good splits.
UNIT = 1_000_000


def _codes(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin of each feature, equally wide between the ends; beyond them the end bins."""
    def code(v: Column, i: Column) -> Column:
        a, b = F.get(low, i), F.get(high, i)
        at = F.floor(F.try_divide(v - a, b - a) * bins)
        return F.coalesce(F.greatest(F.least(at, F.lit(bins - 1)), F.lit(0)), F.lit(0)).cast("int")
    return F.transform(x, code)


def _node(codes: Column, splits: Column, levels: int) -> Column:
    """The node that a row reaches after ``levels`` steps, numbered within its level."""
    at = F.lit(0)  # in heap order
    for _ in range(levels):
        split = F.get(splits, at)
        at = at * 2 + 1 + (F.get(codes, split["feature"]) > split["bin"]).cast("int")
    return at - ((1 << levels) - 1)


def _prediction(codes: Column, base: Column, trees: Column, depth: int) -> Column:
    return F.aggregate(trees, base, lambda f, t: f + F.get(t["leaves"], _node(codes, t["splits"], depth)))


_SPLIT = "struct<feature:int,bin:int>"
_TREES = f"array<struct<splits:array<{_SPLIT}>,leaves:array<double>>>"


def _complete(rows: DataFrame, x: str, y: str | None) -> DataFrame:
    rows = rows.where(F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull()))
    return rows if y is None else rows.where(F.col(y).isNotNull())


def fit(rows: DataFrame, *, key: Sequence[str], x: str, y: str, width: int, rounds: int = 20, depth: int = 3, bins: int = 32,
        rate: float = 0.3, penalty: float = 1.0, least: int = 5) -> DataFrame:
    """A model per series: ``low`` and ``high`` (ends of the bins), ``base`` (the
    mean of ``y``) and ``trees``.

    ``x`` is an array of ``width`` doubles. Rows without a target, or with a
    missing feature, are left out; a missing key is a series. Loss is squared. A
    node is split where G_left^2 / (n_left + penalty) + G_right^2 / (n_right +
    penalty) is largest, with at least ``least`` rows on both sides; of equally
    good splits the first feature's is taken, then the lowest. A node without a
    split that beats none sends all its rows to the left. A leaf adds
    rate * G / (n + penalty).
    """
    key = list(key)
    known = _complete(rows.select(*key, F.col(x).cast("array<double>").alias("_x"), F.col(y).cast("double").alias("_y")), "_x", "_y")
    known = cut_lineage(known)  # read by each level
    features = range(width)
    models = known.groupBy(*key).agg(
        F.array(*[F.min(F.get("_x", F.lit(i))) for i in features]).alias("low"),
        F.array(*[F.max(F.get("_x", F.lit(i))) for i in features]).alias("high"),
        F.round(F.avg("_y"), 6).alias("base"))
    models = cut_lineage(models.withColumn("trees", F.array().cast(_TREES)))
    codes = _codes(F.col("_x"), F.col("low"), F.col("high"), bins)
    coded = cut_lineage(match(known, models, key).select(*key, codes.alias("_codes"), "_y"))

    def gradients(grown: DataFrame, levels: int) -> DataFrame:
        """Rows with their node in the tree that grows, and their gradient."""
        gap = F.col("_y") - _prediction(F.col("_codes"), F.col("base"), F.col("trees"), depth)
        return match(coded, grown, key).select(*key, "_codes", _node(F.col("_codes"), F.col("splits"), levels).alias("_node"), F.round(gap * UNIT).cast("bigint").alias("_g"))

    score = lambda g, n: g * g / (n + penalty)
    for _ in range(rounds):
        grown = models.withColumn("splits", F.array().cast(f"array<{_SPLIT}>"))
        for level in range(depth):
            at = gradients(grown, level).select(*key, "_node", F.posexplode("_codes").alias("_feature", "_bin"), "_g")
            sums = at.groupBy(*key, "_node", "_feature", "_bin").agg(F.sum("_g").alias("_g"), F.count(F.lit(1)).alias("_n"))
            line = W.partitionBy(*key, "_node", "_feature")  # at most ``bins`` rows
            left = line.orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
            sums = sums.select(*key, "_node", "_feature", "_bin", F.sum("_g").over(left).alias("_gl"), F.sum("_n").over(left).alias("_nl"),
                               F.sum("_g").over(line).alias("_ga"), F.sum("_n").over(line).alias("_na"))
            part = lambda c: F.col(c).cast("double") / (UNIT if c[1] == "g" else 1)
            gl, nl, ga, na = part("_gl"), part("_nl"), part("_ga"), part("_na")
            gain = score(gl, nl) + score(ga - gl, na - nl) - score(ga, na)
            good = sums.withColumn("_gain", gain).where((F.col("_nl") >= least) & (F.col("_na") - F.col("_nl") >= least) & (F.col("_gain") > 0))
            best = F.max(F.struct("_gain", (-F.col("_feature")).alias("f"), (-F.col("_bin")).alias("b"))).alias("_b")
            chosen = good.groupBy(*key, "_node").agg(best).groupBy(*key).agg(
                F.map_from_entries(F.collect_list(F.struct("_node", F.struct((-F.col("_b.f")).cast("int").alias("feature"), (-F.col("_b.b")).cast("int").alias("bin"))))).alias("_chosen"))
            # Without a split: no code is above this bin.
            none = F.struct(F.lit(0).alias("feature"), F.lit(bins).alias("bin"))
            new = F.transform(F.sequence(F.lit(0), F.lit((1 << level) - 1)), lambda i: F.coalesce(F.try_element_at("_chosen", i), none))
            grown = match(grown, chosen, key, "left").withColumn("splits", F.concat("splits", new)).drop("_chosen")
            grown = cut_lineage(grown)
        leaf = gradients(grown, depth).groupBy(*key, "_node").agg(F.sum("_g").alias("_g"), F.count(F.lit(1)).alias("_n"))
        value = F.lit(rate) * (F.col("_g").cast("double") / UNIT) / (F.col("_n") + penalty)
        leaves = leaf.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_node", value))).alias("_leaves"))
        all_ = F.transform(F.sequence(F.lit(0), F.lit((1 << depth) - 1)), lambda i: F.coalesce(F.try_element_at("_leaves", i), F.lit(0.0)))
        tree = F.array(F.struct("splits", all_.alias("leaves")))
        models = cut_lineage(match(grown, leaves, key).select(*key, "low", "high", "base", F.concat("trees", tree).cast(_TREES).alias("trees")))
    return models


def predict(rows: DataFrame, models: DataFrame, *, key: Sequence[str], x: str, name: str, depth: int, bins: int) -> DataFrame:
    """Rows with the prediction of their series; NULL where a feature is missing or
    the series has no model."""
    flat = F.col(x).cast("array<double>")
    joined = match(rows, models.withColumnsRenamed({c: f"_{c}" for c in ("low", "high", "base", "trees")}), key, "left")
    whole = flat.isNotNull() & ~F.exists(flat, lambda v: v.isNull())
    made = _prediction(F.col("_codes"), F.col("_base"), F.col("_trees"), depth)
    joined = joined.withColumn("_codes", F.when(whole, _codes(flat, F.col("_low"), F.col("_high"), bins)))
    return joined.withColumn(name, F.when(F.col("_codes").isNotNull(), made)).drop("_codes", "_low", "_high", "_base", "_trees")
