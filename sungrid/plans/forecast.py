"""The forecast run as one flow: documents in, power per time out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import clip
from ..operators import scaling
from ..operators.blocks import DAY, over_rows, row_index
from ..sources.readers import forecast_rows


def forecast_flow(documents: DataFrame, stored: DataFrame, *, document: Column, params: Sequence[str], key: Sequence[str], features: dict[str, Column], target: str,
                  n: int, score: Callable[[Column], Column], ts: str = "ts", block_s: int = 30 * DAY, rows: int = 4096) -> DataFrame:
    """Forecast documents to power: key, ts, the raw ``params``, the scaled features
    (``<name>_scaled``), and ``target``.

    ``features`` makes each feature from the parameters; ``stored`` holds the saved
    versions of scaling parameters (see ``scaling.save``), of which the newest of
    each series counts. ``score`` sees an array with the last ``n`` rows of scaled
    features and gives the scaled target, which is scaled back and not below zero.
    The first n - 1 rows of a series have no full window, and NULL.
    """
    made = forecast_rows(documents, document=document, params=params, keep=key, ts=ts).withColumns(features)
    fitted = scaling.latest(stored, key=key)
    scaled = scaling.transform(made, fitted, list(features), key=key, suffix="_scaled")
    placed = row_index(scaled, key=key, ts=ts, block_s=block_s, name="_i")
    row = F.struct(*[F.col(f"{c}_scaled").alias(c) for c in features])
    window = over_rows(placed, key=key, index="_i", before=n - 1, rows=rows, exprs=lambda w: {
        "_x": F.collect_list(row).over(w.rowsBetween(-(n - 1), 0)), "_c": F.count(F.lit(1)).over(w.rowsBetween(-(n - 1), 0))})
    scored = window.withColumn(target, F.when(F.col("_c") == n, score(F.col("_x"))))
    back = scaling.transform(scored, fitted, [target], key=key, inverse=True)
    return back.withColumn(target, clip(F.col(target), low=0.0)).select(*key, ts, *params, *[f"{c}_scaled" for c in features], target)
