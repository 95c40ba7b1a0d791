"""Power spectra of regular series by averaged, overlapping segments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .keys import match


def _segment_power(n: int, fs: float):
    """Vectorised periodogram of a batch of segments, for use inside tasks."""
    taper = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / n)
    weight = np.full(n // 2 + 1, 2.0)
    weight[0] = 1.0
    if n % 2 == 0:
        weight[-1] = 1.0
    scale = weight / (fs * float((taper**2).sum()))

    @F.pandas_udf("array<double>")
    def power(segments: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(s, dtype=float) for s in segments])
        x = (x - x.mean(axis=1, keepdims=True)) * taper
        return pd.Series(list(np.abs(np.fft.rfft(x, axis=1)) ** 2 * scale))

    return power


def welch(df: DataFrame, *, key: Sequence[str], index: str, value: str, n: int, fs: float) -> DataFrame:
    """Welch spectrum: half-overlapping Hann segments of ``n`` rows, mean removed.

    ``index`` is consecutive within a series and starts anywhere. A group is one
    segment of n rows; segments spread over the cluster and their powers are
    averaged by partial sums. Rows after the last full segment are not used.
    """
    hop = n // 2
    starts = cut_lineage(df.groupBy(*key).agg(F.min(index).alias("_first")))
    placed = match(df, starts, key).select(*key, value, (F.col(index) - F.col("_first")).alias("_at"))
    last = F.floor(F.col("_at") / F.lit(hop))
    segments = placed.withColumn("_segment", F.explode(F.array(*[last - back for back in range(2 + n % 2)]))).where("_segment >= 0")
    # For odd n, two hops are one row less than a segment, so a row may be in three.
    segments = segments.where(F.col("_at") - F.col("_segment") * hop < n)
    rows = F.sort_array(F.collect_list(F.struct("_at", value)))  # n rows at most
    arrays = segments.groupBy(*key, "_segment").agg(rows.alias("_rows")).where(F.size("_rows") == n)
    arrays = arrays.select(*key, F.transform("_rows", lambda r: r[value]).alias("_x"))
    powers = arrays.select(*key, F.posexplode(_segment_power(n, fs)("_x")).alias("bin", "_p"))
    return powers.groupBy(*key, F.col("bin").cast("long").alias("bin")).agg(
        F.avg("_p").alias("psd"), F.count(F.lit(1)).alias("n_segments")
    ).withColumn("frequency", F.col("bin") * (fs / n))
