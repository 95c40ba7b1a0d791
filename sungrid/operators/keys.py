"""Joins on keys that may be missing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def match(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, where a missing value equals a missing value, as in
    ``groupBy``: a series without a name keeps its rows. Key columns come once."""
    on = [on] if isinstance(on, str) else list(on)
    right = other.withColumnsRenamed({c: f"_m_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_m_{c}`")) for c in on])
    return df.join(right, same, how).drop(*[f"_m_{c}" for c in on])
