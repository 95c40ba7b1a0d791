"""Feature scaling with a parameters table: (key, feature, method, center, scale).

scaled = (x - center) / scale, where a feature that does not vary has scale 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .keys import match
from .ranks import long_form
from .selection import quantiles


def fit(df: DataFrame, methods: dict[str, str], *, key: Sequence[str]) -> DataFrame:
    """Fit ``methods`` (feature to minmax, standard, robust or none) per series."""
    tables = []
    simple = {c: m for c, m in methods.items() if m != "robust"}
    if simple:
        tables.append(_fit_simple(df, simple, key))
    robust = [c for c, m in methods.items() if m == "robust"]
    if robust:
        tables.append(_fit_robust(df, robust, key))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.withColumn("scale", F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale")))


def _fit_simple(df: DataFrame, methods: dict[str, str], key: Sequence[str]) -> DataFrame:
    def params(c: str, how: str) -> tuple[Column, Column]:
        if how == "minmax":
            return F.min(c), F.max(c) - F.min(c)
        if how == "standard":
            return F.avg(c), F.stddev_pop(c)
        if how == "none":
            return F.lit(0.0), F.lit(1.0)
        raise ValueError(f"unknown scaling {how!r} of {c!r}")

    wide = df.groupBy(*key).agg(*[
        F.struct(F.lit(c).alias("feature"), F.lit(m).alias("method"),
                 params(c, m)[0].cast("double").alias("center"), params(c, m)[1].cast("double").alias("scale")).alias(f"_{c}")
        for c, m in methods.items()])
    return wide.select(*key, F.inline(F.array(*[F.col(f"_{c}") for c in methods])))


def _fit_robust(df: DataFrame, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    rows = long_form(df.select(*key, *cols), ids=key, cols=cols)
    q = quantiles(rows, value="value", group=[*key, "feature"], probs={"_lo": 0.25, "center": 0.5, "_hi": 0.75})
    return q.select(*key, "feature", F.lit("robust").alias("method"), "center", (F.col("_hi") - F.col("_lo")).alias("scale"))


def _wide(params: DataFrame, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    cells = []
    for c in cols:
        mine = F.col("feature") == c
        cells += [F.max(F.when(mine, F.col("center"))).alias(f"_c_{c}"), F.max(F.when(mine, F.col("scale"))).alias(f"_s_{c}")]
    return params.groupBy(*key).agg(*cells)


def transform(df: DataFrame, params: DataFrame, cols: Sequence[str], *, key: Sequence[str], inverse: bool = False,
              suffix: str = "") -> DataFrame:
    """Scale ``cols`` (or undo it) by the parameters of the row's series.

    One row of parameters per series joins the data by its key; it is written
    first, so that Spark knows its size (see ``cut_lineage``). A series without
    fitted parameters keeps its rows, with NULL values.
    """
    joined = match(df, cut_lineage(_wide(params, cols, key)), key, "left")

    def value(c: str) -> Column:
        center, scale = F.col(f"_c_{c}"), F.col(f"_s_{c}")
        return F.col(c) * scale + center if inverse else (F.col(c) - center) / scale

    out = joined.withColumns({f"{c}{suffix}": value(c) for c in cols})
    return out.drop(*[f"_{x}_{c}" for c in cols for x in "cs"])


def save(params: DataFrame, path: str, version: str) -> None:
    """Keep a fitted table under its version; older versions stay."""
    params.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)


def latest(params: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """The newest version of each series and feature."""
    row = F.struct("version", "method", "center", "scale")
    return params.groupBy(*key, "feature").agg(F.max(row).alias("_r")).select(*key, "feature", "_r.*")
