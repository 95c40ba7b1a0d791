"""Window functions over long series, computed block by block.

One series may hold a large share of all rows, so no window here spans a whole
series. A series is cut into blocks (spans of time, or runs of row numbers);
what earlier or later blocks contribute is

* an aggregate per block (``row_index``, ``running_sum``, ``neighbours``),
  which is pre-aggregated on the map side and has one row per block, or
* a copy of the few rows next to the border (``with_halo``), for windows that
  reach over a fixed number of rows.

Rows are then shuffled once, by (key, block), and a task never holds more than
some blocks. Results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from ..functions.timecols import SECOND, micros

DAY = 86_400
BLOCK = "_block"


def with_block(df: DataFrame, key: Sequence[str], ts: str, block_s: int) -> DataFrame:
    """Add the time block of each row: its series and a number, in one struct.

    Structs with equal fields are equal, missing ones included. Rows without a
    series form a series, and rows without a time a block before all others.
    """
    m, width = micros(F.col(ts)), F.lit(block_s * SECOND)
    number = ((m - F.pmod(m, width)) / width).cast("long")
    return df.withColumn(BLOCK, F.struct(*key, number.alias("_number")))


def _per_block(blocked: DataFrame, key: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """One row per block, with the columns of its series."""
    return blocked.groupBy(BLOCK).agg(*aggs).select("*", *[F.col(f"{BLOCK}.`{k}`").alias(k) for k in key])


def _over_blocks(key: Sequence[str]) -> WindowSpec:
    # One row per block of a series, not one per reading.
    return W.partitionBy(*key).orderBy(BLOCK)


def _local(order: Sequence[str | Column]) -> WindowSpec:
    return W.partitionBy(BLOCK).orderBy(*order)


# A frame that ends at the last row is computed anew for each row. Walking the
# other way, the same rows come before the current one and one pass is enough.
def _from_end(parts: Sequence[str], order: str, *more: Column) -> WindowSpec:
    return W.partitionBy(*parts).orderBy(F.desc(order), *more)


def block_seconds(df: DataFrame, *, key: Sequence[str], ts: str, rows: int = 1_000_000, longest: int = 30 * DAY) -> int:
    """Block width at which the densest stretch of any series has about ``rows`` rows.

    For readings at irregular times, whose density is not known beforehand: one
    aggregate over (key, minute), of which one number reaches the driver.
    """
    minute = F.floor(micros(F.col(ts)) / F.lit(60 * SECOND)).alias("_piece")
    counts = df.where(F.col(ts).isNotNull()).groupBy(*key, minute).agg(F.count(F.lit(1)).alias("_n"))
    densest = counts.agg(F.max("_n").alias("n")).first()["n"]
    return longest if densest is None else int(min(longest, max(1, 60 * rows // densest)))


def row_index(df: DataFrame, *, key: Sequence[str], ts: str, tie: Sequence[str] = (), block_s: int = DAY,
              name: str = "rn", total: str | None = None) -> DataFrame:
    """Chronological row number from 0 within each series, and its row count."""
    blocked = with_block(df, key, ts, block_s)
    counts = _per_block(blocked, key, [F.count(F.lit(1)).alias("_n")])
    w = _over_blocks(key)
    before = F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1))
    whole = F.sum("_n").over(W.partitionBy(*key))
    offsets = counts.select(BLOCK, F.coalesce(before, F.lit(0)).alias("_base"), whole.alias("_total"))
    local = F.row_number().over(_local([ts, *tie])) - 1
    out = blocked.join(offsets, BLOCK).withColumn(name, F.col("_base") + local)
    if total:
        out = out.withColumnRenamed("_total", total)
    return out.drop(BLOCK, "_base", "_total")


def running_sum(df: DataFrame, *, key: Sequence[str], ts: str, cols: dict[str, str], block_s: int = DAY) -> DataFrame:
    """Running totals from the start of each series; ``cols`` maps column to result."""
    blocked = with_block(df, key, ts, block_s)
    sums = _per_block(blocked, key, [F.sum(c).alias(f"_s_{c}") for c in cols])
    past = _over_blocks(key).rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(BLOCK, *[F.coalesce(F.sum(f"_s_{c}").over(past), F.lit(0)).alias(f"_b_{c}") for c in cols])
    local = _local([ts]).rowsBetween(W.unboundedPreceding, 0)
    out = blocked.join(bases, BLOCK)
    out = out.withColumns({name: F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(local), F.lit(0)) for c, name in cols.items()})
    return out.drop(BLOCK, *[f"_b_{c}" for c in cols])


def previous_row(df: DataFrame, *, key: Sequence[str], ts: str, cols: dict[str, str], block_s: int = DAY) -> DataFrame:
    """Values of the row before, in time; ``cols`` maps column to result.

    Times of a series are unique. The first row of a series gets NULL.
    """
    blocked = with_block(df, key, ts, block_s)
    lasts = _per_block(blocked, key, [F.max_by(c, ts).alias(f"_l_{c}") for c in cols])
    w = _over_blocks(key)
    carried = lasts.select(BLOCK, *[F.lag(f"_l_{c}", 1).over(w).alias(f"_c_{c}") for c in cols])
    local = _local([ts])
    first = F.row_number().over(local) == 1
    out = blocked.join(carried, BLOCK).withColumns(
        {name: F.when(first, F.col(f"_c_{c}")).otherwise(F.lag(c, 1).over(local)) for c, name in cols.items()})
    return out.drop(BLOCK, *[f"_c_{c}" for c in cols])


def neighbours(df: DataFrame, *, key: Sequence[str], ts: str, cols: Sequence[str], block_s: int = DAY,
               mark: str | None = None) -> DataFrame:
    """Nearest known value at or before, and at or after, each row.

    Adds ``prev_<c>``, ``prev_<c>_ts``, ``next_<c>`` and ``next_<c>_ts`` for each
    column, reaching over gaps of any length. Rows of a series need unique times;
    with ``mark``, a row that has this column set may share the time of one that
    does not, and sees its value from both sides.
    """
    blocked = with_block(df, key, ts, block_s)

    def seen_at(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.col(ts))

    aggs = []
    for c in cols:
        aggs += [
            F.max_by(c, seen_at(c)).alias(f"_lv_{c}"), F.max(seen_at(c)).alias(f"_lt_{c}"),
            F.min_by(c, seen_at(c)).alias(f"_fv_{c}"), F.min(seen_at(c)).alias(f"_ft_{c}"),
        ]
    edges = _per_block(blocked, key, aggs)
    past = _over_blocks(key).rowsBetween(W.unboundedPreceding, -1)
    future = _from_end(key, BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = []
    for c in cols:
        carried += [F.last(f"_l{x}_{c}", ignorenulls=True).over(past).alias(f"_p{x}_{c}") for x in "vt"]
        carried += [F.last(f"_f{x}_{c}", ignorenulls=True).over(future).alias(f"_n{x}_{c}") for x in "vt"]
    edges = edges.select(BLOCK, *carried)

    unmarked_first = [F.col(mark).asc_nulls_first()] if mark else []
    up_to = _local([ts, *unmarked_first]).rowsBetween(W.unboundedPreceding, 0)
    from_here = _from_end([BLOCK], ts, *unmarked_first).rowsBetween(W.unboundedPreceding, 0)
    out = blocked.join(edges, BLOCK)
    found = {}
    for c in cols:
        found[f"prev_{c}"] = F.coalesce(F.last(c, ignorenulls=True).over(up_to), F.col(f"_pv_{c}"))
        found[f"prev_{c}_ts"] = F.coalesce(F.last(seen_at(c), ignorenulls=True).over(up_to), F.col(f"_pt_{c}"))
        found[f"next_{c}"] = F.coalesce(F.last(c, ignorenulls=True).over(from_here), F.col(f"_nv_{c}"))
        found[f"next_{c}_ts"] = F.coalesce(F.last(seen_at(c), ignorenulls=True).over(from_here), F.col(f"_nt_{c}"))
    return out.withColumns(found).drop(BLOCK, *[f"_{d}{x}_{c}" for c in cols for d in "pn" for x in "vt"])


def with_halo(df: DataFrame, *, index: str, before: int = 0, after: int = 0, rows: int = 4096) -> DataFrame:
    """Copy the rows near a block border into the neighbouring block.

    ``index`` numbers the rows of a series consecutively. Adds ``_block`` and
    ``_own``; a window over (key, _block) sees ``before`` rows of the previous
    and ``after`` rows of the next block, and ``_own`` marks the rows to keep.
    """
    rows = max(rows, before, after)  # a window reaches into the next block at most
    own = F.floor(F.col(index) / F.lit(rows)).cast("long")
    place = F.pmod(F.col(index), F.lit(rows))
    targets = [own]
    if before:
        targets.append(F.when(place >= rows - before, own + 1))
    if after:
        targets.append(F.when(place < after, own - 1))
    out = df.withColumn(BLOCK, F.explode(F.array_compact(F.array(*targets))))
    return out.withColumn("_own", F.col(BLOCK) == own)


def over_rows(df: DataFrame, *, key: Sequence[str], index: str, exprs: Callable[[WindowSpec], dict[str, Column]],
              before: int = 0, after: int = 0, rows: int = 4096) -> DataFrame:
    """Add window expressions that reach ``before`` rows back and ``after`` ahead.

    ``exprs`` receives the window ordered by ``index`` and gives the new columns.
    """
    copied = with_halo(df, index=index, before=before, after=after, rows=rows)
    return copied.withColumns(exprs(W.partitionBy(*key, BLOCK).orderBy(index))).where("_own").drop(BLOCK, "_own")


def running_parts(copied: DataFrame, *, key: Sequence[str], index: str, n: int, parts: dict[str, Column]) -> DataFrame:
    """Aggregates over the ``n`` rows that end at each row, as two parts to be joined.

    The rows of a series are cut into pieces of ``n``. A window is the end of one
    piece and the start of the next, so two running aggregates give both parts,
    ``_tail`` and ``_head`` (structs of ``parts``, single aggregates; ``_tail`` is
    NULL where the window is a piece). Each row is read twice, however long the window, and
    nothing is subtracted, so no digits are lost. ``copied`` comes from ``with_halo``.
    """
    both = copied.repartition(*key, BLOCK)  # one shuffle for the three windows
    piece = W.partitionBy(*key, BLOCK, F.floor(F.col(index) / F.lit(n)))
    running = lambda order: piece.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    struct = lambda w: F.struct(*[c.over(w).alias(name) for name, c in parts.items()])
    both = both.withColumn("_head", struct(running(F.col(index)))).withColumn("_tail", struct(running(F.desc(index))))
    along = W.partitionBy(*key, BLOCK).orderBy(index)
    return both.withColumn("_tail", F.when(F.pmod(F.col(index), F.lit(n)) != n - 1, F.lag("_tail", n - 1).over(along)))


def block_arrays(df: DataFrame, *, key: Sequence[str], index: str, cols: Sequence[str | Column], before: int = 0, after: int = 0,
                 rows: int = 4096, name: str = "rows") -> DataFrame:
    """One row per block: the rows of the block and of its halo as an array of
    structs (index, own, cols...) in index order. Windows and lags are slices of
    it. A block has ``rows`` rows of its own, so no array grows with the series."""
    copied = with_halo(df, index=index, before=before, after=after, rows=rows)
    cells = F.sort_array(F.collect_list(F.struct(F.col(index).alias("index"), F.col("_own").alias("own"), *cols)))
    return copied.groupBy(*key, BLOCK).agg(cells.alias(name))
