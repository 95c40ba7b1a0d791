"""Temperature mixing of sources, realised as budgeted permutations of blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from ..session import cut_lineage
from .common import table

ENTROPY_SHARE = 0.95
MAX_EPOCHS = 4.0
BLOCK_ROWS = 1000
SEED = 17
#: The exponent's interval is cut into SECTIONS parts in each of ROUNDS passes.
SECTIONS, ROUNDS = 64, 8


def _hash(*parts: Column | str) -> Column:
    """60 bits of an MD5, as a long; the parts are joined as text."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _narrow(shares: DataFrame, value, holds) -> float:
    """The smallest exponent in [0, 1] for which ``holds(value)``, which is false
    below it and true above; 1 where it never holds.

    ``value(a, z, d, r)`` sees the sums of p^a and of p^a ln p and the largest
    p^a / p. Each pass is one aggregate over the sources for all sections.
    """
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)]
        sums = []
        for i, a in enumerate(grid):
            q = F.pow("p", F.lit(a))
            sums += [F.sum(q).alias(f"z{i}"), F.sum(q * F.ln("p")).alias(f"d{i}"), F.max(q / F.col("p")).alias(f"r{i}")]
        row = shares.agg(*sums).first()
        ok = [holds(value(a, row[f"z{i}"], row[f"d{i}"], row[f"r{i}"])) for i, a in enumerate(grid)]
        if ok[0]:
            return grid[0]
        if True not in ok:
            return grid[-1]
        at = ok.index(True)
        lo, hi = grid[at - 1], grid[at]
    return hi


def temperature(sources: DataFrame, budget: int, *, entropy_share: float = ENTROPY_SHARE, max_epochs: float = MAX_EPOCHS) -> float:
    """The exponent for shares of ``tokens``: the one whose weights reach
    ``entropy_share`` of the largest entropy, or, where that repeats a source
    more than ``max_epochs`` times, the smallest that does not."""
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    shares = cut_lineage(sources.select((F.col("tokens") / F.lit(float(total))).alias("p")))
    goal = entropy_share * math.log(n)

    def entropy(a: float, z: float, d: float, r: float) -> float:
        return math.log(z) - a * d / z

    def epochs(a: float, z: float, d: float, r: float) -> float:
        return budget / total * r / z

    # Entropy falls as the exponent grows: take the largest that still reaches the goal.
    flat = _narrow(shares, entropy, lambda h: h <= goal + 1e-12)
    return max(flat, _narrow(shares, epochs, lambda e: e <= max_epochs))


OUTPUTS = ("mix_source", "mix_tokens", "mix_epoch", "mix_at", "mix_order")


def _names(columns: list[str]) -> dict[str, str]:
    """Output names of the input columns: those of a result column get ``_in``
    appended, as often as it takes."""
    taken, out = {*OUTPUTS, *[c.lower() for c in columns]}, {}
    for c in columns:
        name = c
        if c.lower() in OUTPUTS:
            while name.lower() in taken:
                name += "_in"
            taken.add(name.lower())
        out[c] = name
    return out


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", columns: list[str] | None = None, budget: int | None = None,
        entropy_share: float = ENTROPY_SHARE, max_epochs: float = MAX_EPOCHS, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """Rows of the mixture: the ``columns`` of docs, then mix_source, mix_tokens,
    mix_epoch, mix_at (where in the whole mixture the row's block starts, from 0
    to 1) and mix_order (the row's place in its block, as a sort key).

    Weights are shares of whitespace-separated tokens, raised to the exponent of
    ``temperature`` and normalised; the budget (all tokens of ``docs`` unless
    given) is split by them. A source's rows are dealt into blocks by a hash of
    id and text; each epoch permutes the blocks, and the rows in a block, anew.
    A source emits whole epochs, then blocks of the next one, then rows of one
    last block for as long as they end within its budget.

    A null source is a source. A source without tokens has no weight and no rows.
    Rows without tokens come with their block; null texts have none. Repeated
    rows count each. No rows, or no tokens at all, give no rows. An input column
    with the name of one of the five comes out with ``_in`` appended.

    Only counts per source and block are shuffled and sorted; rows meet them in
    a join that needs no order, and one block a source is looked at row by row.
    """
    columns = docs.columns if columns is None else columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("r") if columns else F.struct(F.lit(1)).alias("r"),
        F.col(source).cast("string").alias("s"), n_tokens(F.col(text)).alias("mix_tokens"),
        F.col(doc_id).cast("string").alias("i"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("m"))
    slim = cut_lineage(rows.select("s", "mix_tokens", "i", "m"))
    sources = slim.groupBy("s").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("n")).where("tokens > 0")
    sources = cut_lineage(sources)
    total = sources.agg(F.sum("tokens")).first()[0]
    budget = total if budget is None else budget
    a = temperature(sources, budget, entropy_share=entropy_share, max_epochs=max_epochs) if total else 1.0
    z = sources.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a)))).first()[0] or 1.0
    weight = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a)) / F.lit(z)
    sources = sources.select("s", "tokens", F.ceil(F.col("n") / F.lit(block_rows)).cast("long").alias("blocks"), F.floor(weight * F.lit(budget or 0) + 0.5).cast("long").alias("budget"))
    sources = cut_lineage(sources)

    def dealt(df: DataFrame) -> DataFrame:
        by_source = sources.select(F.col("s").alias("s2"), F.col("blocks"))
        return df.join(by_source, F.col("s").eqNullSafe(F.col("s2"))).withColumn("block", _hash(str(seed), F.col("i"), F.col("m")) % F.col("blocks")).drop("s2", "blocks")

    blocks = dealt(slim).groupBy("s", "block").agg(F.sum("mix_tokens").alias("block_tokens"))
    by_source = sources.select(F.col("s").alias("s2"), "tokens", "budget")
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("budget") / F.col("tokens")).cast("long") - 1)).alias("mix_epoch")
    blocks = blocks.join(by_source, F.col("s").eqNullSafe(F.col("s2"))).where("budget > 0").select("s", "block", "block_tokens", "tokens", "budget", runs)
    order = W.partitionBy("s", "mix_epoch").orderBy(_hash(str(seed), F.col("mix_epoch"), F.col("s"), F.col("block")), "block")
    before = F.coalesce(F.sum("block_tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("start", F.col("mix_epoch") * F.col("tokens") + before).where("start < budget")
    blocks = blocks.withColumn("mix_at", F.col("start") / F.col("budget")).withColumn("room", F.col("budget") - F.col("start"))
    blocks = cut_lineage(blocks.select(F.col("s").alias("s2"), F.col("block").alias("block2"), "block_tokens", "room", "mix_epoch", "mix_at"))

    met = F.col("s").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("block2"))
    placed = dealt(rows)
    out = [*[F.col(f"r.`{c}`").alias(name) for c, name in _names(columns).items()], F.col("s").alias("mix_source"), "mix_tokens", "mix_epoch", "mix_at", "mix_order"]
    key = _hash(str(seed), F.col("mix_epoch"), F.col("i"), F.col("m"))
    whole = placed.join(blocks.where("block_tokens <= room"), met).withColumn("mix_order", key)
    # The block that a budget ends in: a running sum over its rows, one block a source.
    last = placed.join(blocks.where("block_tokens > room"), met).withColumn("mix_order", key)
    within = W.partitionBy("s", "block", "mix_epoch").orderBy("mix_order", "i", "m").rowsBetween(W.unboundedPreceding, 0)
    last = last.withColumn("upto", F.sum("mix_tokens").over(within)).where("upto <= room")
    return whole.select(*out).unionByName(last.select(*out))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), columns=["doc_id"]).select("doc_id", "mix_source", "mix_tokens", "mix_epoch", F.round("mix_at", 9).alias("mix_at"), "mix_order")


SQL = f"""
WITH RECURSIVE slim AS (
  SELECT doc_id, source AS s, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS mix_tokens, CAST(doc_id AS VARCHAR) AS i, md5(coalesce(text, '')) AS m
  FROM documents),
src AS (SELECT s, sum(mix_tokens)::BIGINT AS tokens, count(*) AS n FROM slim GROUP BY s HAVING sum(mix_tokens) > 0),
tot AS (SELECT list(tokens / t ORDER BY tokens, s) AS p, any_value(t) AS t, {ENTROPY_SHARE} * ln(count(*)) AS goal FROM (SELECT *, (sum(tokens) OVER ())::DOUBLE AS t FROM src)),
bis AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2 FROM tot
  UNION ALL
  SELECT step + 1, CASE WHEN flat THEN lo ELSE mid END, CASE WHEN flat THEN mid ELSE hi END, CASE WHEN few THEN lo2 ELSE mid2 END, CASE WHEN few THEN mid2 ELSE hi2 END
  FROM (SELECT step, lo, hi, lo2, hi2, mid, mid2,
          ln(list_sum([pow(x, mid) for x in p])) - mid * list_sum([pow(x, mid) * ln(x) for x in p]) / list_sum([pow(x, mid) for x in p]) <= goal AS flat,
          list_max([pow(x, mid2) / x for x in p]) / list_sum([pow(x, mid2) for x in p]) <= {MAX_EPOCHS} AS few
        FROM (SELECT *, (lo + hi) / 2 AS mid, (lo2 + hi2) / 2 AS mid2 FROM bis), tot)
  WHERE step < 60),
alpha AS (SELECT greatest(
    CASE WHEN ln(len(p)) <= goal THEN 0.0 ELSE (SELECT hi FROM bis WHERE step = 60) END,
    CASE WHEN list_max([1 / x for x in p]) / len(p) <= {MAX_EPOCHS} THEN 0.0 ELSE (SELECT hi2 FROM bis WHERE step = 60) END) AS a FROM tot),
q AS (SELECT s, tokens, n, pow(tokens / t, a) AS q, t FROM src, tot, alpha),
bud AS (SELECT s, tokens, ceil(n / {float(BLOCK_ROWS)})::BIGINT AS blocks, floor(q / sum(q) OVER () * t + 0.5)::BIGINT AS budget FROM q),
dealt AS (SELECT slim.*, tokens, budget, ('0x' || substr(md5('{SEED}|' || i || '|' || m), 1, 15))::BIGINT % blocks AS block FROM slim JOIN bud ON slim.s IS NOT DISTINCT FROM bud.s),
blk AS (SELECT s, block, tokens, budget, sum(mix_tokens)::BIGINT AS block_tokens FROM dealt GROUP BY ALL),
run AS (SELECT *, unnest(range(ceil(budget / tokens)::BIGINT)) AS mix_epoch FROM blk WHERE budget > 0),
pos AS (SELECT *, mix_epoch * tokens + (coalesce(sum(block_tokens) OVER (PARTITION BY s, mix_epoch
          ORDER BY ('0x' || substr(md5('{SEED}|' || mix_epoch || '|' || coalesce(s, '') || '|' || block), 1, 15))::BIGINT, block
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM run),
place AS (SELECT *, budget - start AS room FROM pos WHERE start < budget),
rows AS (SELECT d.doc_id, d.s, d.block, d.mix_tokens, d.i, d.m, p.mix_epoch, p.block_tokens, p.room, p.start / p.budget AS mix_at,
          ('0x' || substr(md5('{SEED}|' || mix_epoch || '|' || d.i || '|' || d.m), 1, 15))::BIGINT AS mix_order
        FROM dealt d JOIN place p ON d.s IS NOT DISTINCT FROM p.s AND d.block = p.block)
SELECT doc_id, s AS mix_source, mix_tokens, mix_epoch, round(mix_at, 9) AS mix_at, mix_order
FROM (SELECT *, sum(mix_tokens) OVER (PARTITION BY s, block, mix_epoch ORDER BY mix_order, i, m ROWS UNBOUNDED PRECEDING) AS upto FROM rows)
WHERE block_tokens <= room OR upto <= room
"""
