"""Connected components of a graph of any size, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: the neighbours of each node link to the smallest of them.

    Large: neighbours above the node; small: the node and those below it. The
    minimum is an aggregate with partial sums on the map side, so a node with
    very many neighbours costs one row a task; the join back is one that Spark
    can split where such a node makes it uneven.
    """
    around = edges.select(F.col("a").alias("n"), F.col("b").alias("v")).where("n <> v")
    if large:
        around = around.union(around.select("v", "n"))
    else:
        around = around.select(F.greatest("n", "v").alias("n"), F.least("n", "v").alias("v"))
    least = around.groupBy("n").agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
    linked = around.join(least, "n")
    if large:
        out = linked.where("v > n").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("n", "m"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link to another; root is the smallest
    node of the component.

    Alternating large-star and small-star steps (Kiveris et al. 2014) until the
    edges form stars. Each round is written to the shared folder, so a lost
    executor costs a re-read. Null ends and links of a node to itself are left
    out; repeated links count once; no links give no rows.
    """
    now = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, now = seen, cut_lineage(_step(_step(now, True), False))
