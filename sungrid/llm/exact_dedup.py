"""Exact duplicates by digest, combined in salted stages that compare full content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import table

SALTS = 32


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every row of ``docs`` as (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical; null counts as empty. Of equal texts the row
    with the largest id stays (a null id is smaller than all others); of rows
    that also share the id exactly one stays. An empty table gives no rows, and
    other columns are not read, whatever their names.

    A text whose digest no other row has is alone. The rest is combined in three
    stages, each grouping by digest and full text, so that texts with equal
    digests never merge unless they are identical: on the map side within each
    task, then by (digest, text, salt), then the winners of the salts. A text
    that a third of all rows share reaches a task as one row of each map task.
    Rows are found by (digest, salt), and find their winner by it: each salt that
    a digest has rows in gets a copy of the winner.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    src = src.withColumn("digest", digest(F.col("text")))
    src = src.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    parts = cut_lineage(src.groupBy("digest", "salt").agg(F.count("*").alias("n"), F.max("doc_id").alias("doc_id")))
    counted = cut_lineage(parts.groupBy("digest").agg(F.sum("n").alias("n"), F.max("doc_id").alias("doc_id")))
    # Merge hints keep the plans of a large table for a small one too: the
    # repeated digests never go to every task.
    repeated = cut_lineage(parts.join(counted.where("n > 1").select("digest").hint("merge"), "digest", "left_semi").select("digest", "salt"))
    rows = src.join(repeated.hint("merge"), ["digest", "salt"], "left_semi").withColumn("uid", F.monotonically_increasing_id())
    rows = cut_lineage(rows.withColumn("salt", F.pmod("uid", F.lit(salts))))

    best = F.max(F.struct("doc_id", "uid")).alias("best")
    salted = rows.groupBy("digest", "text", "salt").agg(best, F.count("*").alias("n"))
    winners = salted.groupBy("digest", "text").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    winners = cut_lineage(winners)
    variants = winners.groupBy("digest").agg(F.count("*").alias("variants"))
    winners = winners.join(variants, "digest")
    result = ["doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "digest", "text_sha256"]
    # One text for a digest, as compared above: its rows find their winner by
    # the digest and their salt. Where texts collide, by the text.
    sole = winners.where("variants = 1").select("digest", "best", "group_size", sha256(F.col("text")).alias("text_sha256"))
    sole = cut_lineage(rows.select("digest", "salt").distinct().join(sole.hint("merge"), "digest"))
    one = rows.drop("text").join(sole.hint("merge"), ["digest", "salt"])
    more = rows.join(winners.where("variants > 1").select("digest", "text", "best", "group_size"), ["digest", "text"]).withColumn("text_sha256", sha256(F.col("text")))
    if digest is sha256:  # a digest counted once came with the id of its only row
        alone = counted.where("n = 1").withColumn("text_sha256", F.col("digest"))
    else:
        alone = src.join(repeated, ["digest", "salt"], "left_anti").withColumn("text_sha256", sha256(F.col("text")))
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    both = one.select(*result).union(more.select(*result)).drop("digest")
    return alone.unionByName(both).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_exact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Works as ``exact_groups`` does and drops the rest; of rows equal in id and
    text one stays, whatever its other columns hold.
    """
    lost = cut_lineage(exact_groups(docs, doc_id=doc_id, text=text).where("not kept").select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("m"), F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("tie")))
    mark = sha256(F.coalesce(F.col(text), F.lit("")))
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col(doc_id).alias("di"), mark.alias("dm"))
    on = F.col("i").eqNullSafe(F.col("di")) & (F.col("m") == F.col("dm"))
    left = src.join(lost.where("not tie").select("i", "m").distinct().hint("merge"), on, "left_anti")
    ties = lost.where("tie").select("i", "m").distinct()
    if not ties.isEmpty():
        one = left.join(ties, on, "left_semi").groupBy("di", "dm").agg(F.first("r").alias("r"))
        left = left.join(ties, on, "left_anti").select("r").unionByName(one.select("r"))
    return left.select("r.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
