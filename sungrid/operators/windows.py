"""Row windows on regular grids: rolling statistics, lags, sliding sequences.

All take ``index``, a row number that is consecutive within a series: the step
index of a regular grid (``timecols.step_index``) or ``blocks.row_index``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .blocks import BLOCK, block_arrays, previous_row, running_parts, with_halo


def _two(f: str) -> tuple[Column, Column]:
    return F.col(f"_tail.{f}"), F.col(f"_head.{f}")


def _count() -> Column:
    tail, head = _two("n")
    return head + F.coalesce(tail, F.lit(0))


def _joined(a: str, b: str, cross: str) -> Column:
    """The sum of products of deviations of both parts, around their common means."""
    (n1, n2), (a1, a2), (b1, b2), (c1, c2) = _two("n"), _two(a), _two(b), _two(cross)
    return F.when(F.coalesce(n1, F.lit(0)) == 0, c2 * n2).when(n2 == 0, c1 * n1).otherwise(c1 * n1 + c2 * n2 + (a2 - a1) * (b2 - b1) * (n1 * n2 / (n1 + n2)))


def _range(a: str) -> tuple[Column, Column]:
    return F.least(*_two(f"{a}_min")), F.greatest(*_two(f"{a}_max"))


def rolling(df: DataFrame, *, key: Sequence[str], index: str, col: str, n: int, rows: int = 4096) -> DataFrame:
    """Rolling mean and standard deviation over ``n`` rows; NULL until full.

    A window is put together from two running parts, whatever its length; a
    window of equal values has exactly that mean, and no deviation.
    """
    v = F.col(col).cast("double")
    parts = {"n": F.count(v), "v": F.avg(v), "v_dev": F.var_pop(v), "v_min": F.min(v), "v_max": F.max(v)}
    both = running_parts(with_halo(df, index=index, before=n - 1, rows=rows), key=key, index=index, n=n, parts=parts).where("_own")
    full, (low, high), (n1, n2), (m1, m2) = _count() == n, _range("v"), _two("n"), _two("v")
    mean = F.when(low == high, low).when(F.coalesce(n1, F.lit(0)) == 0, m2).when(n2 == 0, m1).otherwise((m1 * n1 + m2 * n2) / n)
    deviation = F.sqrt(F.when(low == high, 0.0).otherwise(_joined("v", "v", "v_dev")) / F.lit(float(n - 1) or None))
    return both.withColumns({f"{col}_mean": F.when(full, mean), f"{col}_std": F.when(full, deviation)}).drop(BLOCK, "_own", "_head", "_tail")


def rolling_corr(df: DataFrame, *, key: Sequence[str], index: str, a: str, b: str, n: int, name: str = "corr",
                 rows: int = 4096) -> DataFrame:
    """Rolling correlation of two columns over ``n`` rows where both are known;
    NULL where a column does not vary. From two running parts, as ``rolling``."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
    parts = {"n": F.count(x), "x": F.avg(x), "y": F.avg(y), "xx": F.var_pop(x), "yy": F.var_pop(y), "xy": F.covar_pop(x, y),
             "x_min": F.min(x), "x_max": F.max(x), "y_min": F.min(y), "y_max": F.max(y)}
    out = running_parts(with_halo(df, index=index, before=n - 1, rows=rows), key=key, index=index, n=n, parts=parts).where("_own")
    (x_low, x_high), (y_low, y_high) = _range("x"), _range("y")
    varies = (_count() == n) & (x_high > x_low) & (y_high > y_low)
    r = _joined("x", "y", "xy") / F.sqrt(_joined("x", "x", "xx") * _joined("y", "y", "yy"))
    return out.withColumn(name, F.when(varies, r)).drop(BLOCK, "_own", "_head", "_tail")


def difference(df: DataFrame, *, key: Sequence[str], ts: str, col: str, name: str, block_s: int) -> DataFrame:
    before = previous_row(df, key=key, ts=ts, cols={col: "_before"}, block_s=block_s)
    return before.withColumn(name, F.col(col) - F.col("_before")).drop("_before")


def deaccumulate(df: DataFrame, *, key: Sequence[str], ts: str, col: str, name: str, block_s: int,
                 seconds: float = 3600.0) -> DataFrame:
    """Rate from an accumulated quantity; the first value has no rate and is 0."""
    out = difference(df, key=key, ts=ts, col=col, name=name, block_s=block_s)
    return out.withColumn(name, F.coalesce(F.col(name) / seconds, F.lit(0.0)))


def sequences(df: DataFrame, *, key: Sequence[str], index: str, ts: str, features: Sequence[str], target: str | None,
              n: int, next_step: bool, keep_short: bool = False, rows: int = 4096) -> DataFrame:
    """One row per sliding window of ``n`` rows.

    ``x`` holds the feature structs in time order. With ``next_step`` the target
    and ``target_ts`` are those of the row after the window, else of its last
    row. Without a target, ``keep_short`` gives NULL for the first n-1 rows.

    A block and its border rows are one array, and a window is a slice of it.
    """
    ahead = 1 if next_step else 0
    cells = [F.struct(*features).alias("x"), F.col(ts).alias("ts"), F.col(target).alias("y") if target else F.lit(None).alias("y")]
    blocks = block_arrays(df, key=key, index=index, cols=cells, before=n - 1, after=ahead, rows=rows)
    ends = F.filter(F.sequence(F.lit(1), F.size("rows")), lambda i: F.get("rows", i - 1)["own"])
    window = blocks.select(*key, "rows", F.explode(ends).alias("_end"))
    last, goal = F.get("rows", F.col("_end") - 1), F.get("rows", F.col("_end") - 1 + ahead)
    x = F.when(F.col("_end") >= n, F.transform(F.slice("rows", F.col("_end") - n + 1, F.lit(n)), lambda r: r["x"]))
    windows = window.select(*key, last["index"].alias(index), goal["ts"].alias("target_ts"), x.alias("x"), *([goal["y"].alias("y")] if target else []))
    if not keep_short:
        windows = windows.where(F.col("x").isNotNull())
    if next_step:
        windows = windows.where(F.col("target_ts").isNotNull())
    return windows


def flatten(x: str, features: Sequence[str]) -> Column:
    """The window as one array of doubles, step after step."""
    return F.flatten(F.transform(x, lambda s: F.array(*[s[f].cast("double") for f in features])))


def first_per_slot(df: DataFrame, *, key: Sequence[str], ts: str, values: Sequence[str]) -> DataFrame:
    """The earliest row at each (hour, minute) of each series."""
    row = F.struct(F.col(ts), *values)
    slots = df.groupBy(*key, F.hour(ts).cast("long").alias("hour"), F.minute(ts).cast("long").alias("minute"))
    return slots.agg(F.min(row).alias("_r")).select(*key, "hour", "minute", *[F.col(f"_r.{c}").alias(c) for c in [ts, *values]])
