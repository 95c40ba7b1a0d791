"""Aggregate expressions that stay defined where a column does not vary."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F


def correlation(a: Column, b: Column, *, over: WindowSpec | None = None, complete: bool = False) -> Column:
    """Pearson correlation; NULL where a side does not vary.

    The built-in ``corr`` divides by zero there, which is an error in ANSI mode.
    With ``complete`` both sides are known to have no missing values, and the
    spread of a column is computed once for all its pairs.
    """
    x, y = (a, b) if complete else (F.when(b.isNotNull(), a), F.when(a.isNotNull(), b))
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    return F.try_divide(parts[0], parts[1] * parts[2])
